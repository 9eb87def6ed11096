"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Digests are SHA-256 of the text without ASCII white space. A Misra-Gries summary (Spark's frequent-items
sketch) names the digests that may be frequent: every digest with more than 3.5 / ``tracked`` of all rows is
among them. Their groups are counted exactly, with partial aggregation where the rows are, and the verified
winners (at most ``tracked`` rows) are broadcast, so the copies of a frequent text never meet in one task. All other
digests, whose groups are small by the sketch's guarantee, are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, quoted, select_ids

#: Items of the sketch: bounds both its memory and what is broadcast.
TRACKED = 8192
WHITE = r"[\x20\x09-\x0D]"


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, digest (hex) and code points of every row; a null text counts as empty."""
    whole = F.coalesce(quoted(text), F.lit(""))
    return docs.select(
        quoted(key).alias("doc_id"),
        F.sha2(F.encode(F.regexp_replace(whole, WHITE, ""), "UTF-8"), 256).alias("digest"),
        F.char_length(whole).cast("long").alias("chars"),
    )


def _winners(rows: DataFrame) -> DataFrame:
    # The longest text wins, then the smallest doc_id; a null doc_id comes after all others.
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.id").alias("keep_id"), "group_size"
    )


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", tracked: int = TRACKED) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Nulls: a null text is an empty one; a null doc_id stays only if its whole group has none. Repeated rows with
    the winner's doc_id are all marked kept here (they are one document); ``deduplicate`` leaves one of them.
    An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(digests(docs, text, key))
    sketch = rows.agg(F.expr(f"approx_top_k(digest, {tracked // 2}, {tracked})").alias("top"))
    likely = sketch.select(F.explode("top.item").alias("digest")).where("digest IS NOT NULL")
    likely = scratch.keep(likely)  # at most tracked / 2 rows
    frequent = _winners(rows.join(F.broadcast(likely), "digest", "left_semi")).where("group_size > 1")
    heavy = scratch.keep(frequent)  # verified: counted exactly, groups of one are none
    hot = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    cold = rest.join(_winners(rest), "digest")
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", tracked: int = TRACKED) -> DataFrame:
    """docs with one row of each group of equal texts, all columns unchanged.

    Rows that repeat the winner's doc_id are reduced to one, whichever comes first. Nulls and ties as in
    ``exact_groups``; further columns of any name pass through; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    groups = scratch.keep(exact_groups(docs, text, key, tracked))
    kept = groups.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = scratch.keep(kept)
    lost = scratch.keep(groups.where("NOT kept").select("doc_id"))
    if not kept.where("n > 1").limit(1).count() and not lost.join(kept, lost["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").limit(1).count():
        return select_ids(docs, lost.withColumnRenamed("doc_id", key), "left_anti", key)  # ids are unique, as usual: texts are not shuffled
    own, keep, sha = fresh(docs, "own_digest", "keep", "sha")
    whole = docs.withColumn(own, F.sha2(F.encode(F.regexp_replace(F.coalesce(quoted(text), F.lit("")), WHITE, ""), "UTF-8"), 256))
    keeps = groups.where("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(sha)).distinct()
    whole = whole.join(keeps, quoted(key).eqNullSafe(quoted(keep)) & (quoted(own) == quoted(sha)), "left_semi")
    return whole.dropDuplicates([key, own]).drop(own)
