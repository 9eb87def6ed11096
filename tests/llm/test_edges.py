"""Every operator and stage with clashing columns, nulls, empty tables, repeated rows and very long texts."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillnest.llm import chat_format, decontaminate, exact_dedup, jaccard_join, line_dedup, lm_score, mixing, quality, queries, secret_scan, token_counts

#: Names that operators use inside, or for what they add.
CLASHES = ["_id", "id", "_keep", "_sha", "keep", "sha", "own_digest", "_drop", "drop_from", "hits", "quality", "mix", "n_tokens", "rate", "copies", "secrets", "dropped_lines", "digest", "component", "label", "y"]
PROSE = "the quick brown fox jumps over the lazy dog near the quiet river bank while seven grey geese fly south over cold hills"
ROWS = [
    (1, PROSE), (1, PROSE), (2, PROSE.upper()), (3, None), (4, ""), (None, PROSE + " again"), (None, None), (5, "token = 'q9Zx7Lk2Pv8Rt4Ws6Yb1Nd3'"),
    (6, PROSE.replace("quick", "slow")), (7, "\n".join([PROSE] * 3)), (8, "unlike all others here is one more short text of its own"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHES)).coalesce(1)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, "unlike all others here is"), (None, "no words in common"), (1, None)], "item_id long, text string").coalesce(1).write.parquet(f"{base}/benchmark.parquet")
    return base


def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


OPERATORS = {
    "mixing": lambda d, s, sf: mixing.mix(d, mixing.label_domains(labels(s, sf))),
    "jaccard": lambda d, s, sf: jaccard_join.keep_one(d),
    "tokens": lambda d, s, sf: token_counts.document_token_counts(d),
    "secrets": lambda d, s, sf: secret_scan.scan_secrets(d),
    "quality": lambda d, s, sf: quality.classify(d, labels(s, sf)),
    "lm": lambda d, s, sf: lm_score.score_texts(d),
    "decontaminate": lambda d, s, sf: decontaminate.decontaminate(d, s.read.parquet(f"{sf}/benchmark.parquet")),
    "exact": lambda d, s, sf: exact_dedup.deduplicate(d),
    "lines": lambda d, s, sf: line_dedup.deduplicate_lines(d),
}

@pytest.mark.parametrize("name", OPERATORS)
def test_clashes_nulls_repeats_and_empty_tables(spark, docs, sf, name):
    out = OPERATORS[name](docs, spark, sf)
    rows = out.collect()
    if name == "jaccard":  # of copies and near copies those of the smallest id stay, both of them
        assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "1", "3", "4", "None", "None", "5", "8"])
    elif name == "exact":
        assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "3", "None", "5", "6", "7", "8"])
    else:
        assert len(rows) == len(ROWS)
    if len(out.columns) > 10:  # the table's own columns are what they were
        assert set(docs.columns) <= set(out.columns) and all(r[c] == 7 for r in rows for c in CLASHES)
    assert OPERATORS[name](docs.where("false"), spark, sf).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_clashes_and_empty_tables(spark, docs, sf, stage):
    out = stage(spark, docs, sf)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert all(r[c] == 7 for r in out.collect() for c in CLASHES)
    assert stage(spark, docs.where("false"), sf).count() == 0


def test_chat_with_further_columns(spark):
    df = spark.createDataFrame([(1, 1, "user", "a", 7), (1, 1, "user", "a", 7), (1, 2, None, None, 7)], "conv_id long, turn long, role string, text string, ts long")
    got = chat_format.format_conversations(df.withColumn("formatted", F.lit(1)).withColumn("t", F.lit(1))).first()
    assert got.formatted == "<turn>user\na<next>a</turn>\n<turn>\n</turn>\n" and got.loss_spans == []


def test_very_long_texts(spark):
    letters = "ab" * 5000 + "12345678"
    words = " ".join(f"w{i % 977}" for i in range(300_000))
    df = spark.createDataFrame([(1, letters), (2, words), (3, words + " end")], "doc_id long, text string").coalesce(1)
    assert secret_scan.scan_secrets(df).where("doc_id > 1 AND size(secrets) > 0").count() == 0
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 2}
    got = {r.doc_id: r for r in lm_score.score_texts(df).collect()}
    assert got[2].n_tokens == 300_001 and np.isfinite(got[2].score)
    assert {r.doc_id for r in line_dedup.repeated_lines(df).collect()} == {3}
    bench = spark.createDataFrame([(1, words[-80:])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminate(df, bench).where("hits.n_hit > 0").collect()} == {2, 3}


def test_scoring_again_gives_the_same_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = ({r.doc_id: r.score for r in lm_score.score_texts(df.repartition(n)).collect()} for n in (3, 5))
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) / abs(one[k]) for k in one) < 1e-4


def test_spoilt_samples_are_bounded(spark):
    """An id that a third of all rows have counts once in the labelled sample."""
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    dom = spark.createDataFrame([(1, "x"), (2, "y"), (4, "x")], "doc_id long, domain string")
    assert mixing.mix(df, dom, {"x": 0.5, "y": 0.5}).count() == 300
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert quality.classify(df, lab).count() == 300


def test_registered_queries():
    assert [n for n in queries.queries()] == [f"op{k}_{n}" for k, n in enumerate(("mixing", "jaccard_join", "token_counts", "secret_scan", "quality", "lm_score", "decontaminate", "exact_dedup", "line_dedup", "chat_format"), 1)]
