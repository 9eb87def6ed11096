"""Corpus pipeline: quality filter, exact and near deduplication, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), calls one operator of ``quillnest.llm`` and returns a DataFrame that is
written as Parquet and reread as the next stage's docs. All but the last return the columns of documents.

In every stage further columns pass through, whatever their names; an empty table stays empty; whole texts of any length
are read; a null text is empty. What becomes of null ids, ties and repeated rows is stated at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillnest.llm.common import Scratch, fresh, quoted, table
from quillnest.llm.decontaminate import WINDOW, decontaminate
from quillnest.llm.exact_dedup import deduplicate
from quillnest.llm.jaccard_join import keep_one
from quillnest.llm.mixing import TARGETS, label_domains, mix
from quillnest.llm.quality import classify

#: Tokens to read, as a multiple of the tokens that reach the last stage: wanted domains are read once or more.
EPOCHS = 1.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject; an unlabelled corpus stays whole.

    Rows without id are scored like others; repeated rows stay or go together.
    """
    (name,) = fresh(docs, "quality")
    out = classify(docs, table(spark, sf_dir, "labels"))
    return out.where(~quoted(name)["rejected"]).select(*map(quoted, docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id.

    A row without id stays only where its whole group has none; of repeated rows one stays.
    """
    return deduplicate(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest id, of each connected group of near duplicates.

    Rows without id or words all stay, and so do rows that repeat the id that stays.
    """
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    A document goes if WINDOW or more of its consecutive words lie in windows of items, as in any occurrence of a whole
    window does, or if a twentieth of its words lie in windows, which items shorter than a window can reach. Ids play
    no part; repeated rows stay or go together.
    """
    (name,) = fresh(docs, "hits")
    hits = quoted(name)
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), WINDOW)
    return out.where((hits["longest"] < WINDOW) & ~hits["contaminated"]).select(*map(quoted, docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to read at least once, with n_tokens, rate and copies (after underscores where docs has such a column);
    a row stands for all its copies.

    Fractions of copies are rounded by the id, so repeated rows have equal copies; a null id rounds like any other.
    """
    (name,) = fresh(docs, "mix")
    got = quoted(name)
    out = mix(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS, epochs=EPOCHS)
    more = zip(("n_tokens", "rate", "copies"), fresh(docs, "n_tokens", "rate", "copies"), strict=True)
    return out.where(got["copies"] > 0).select(*map(quoted, docs.columns), *(got[c].alias(n) for c, n in more))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: Classifiers, connected groups and projected gradients have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = done
    return docs
