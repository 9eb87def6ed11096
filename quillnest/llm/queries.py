"""The queries of this subpackage and their DuckDB counterparts: each thin, around one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_conversations, masked, parse
from .common import table
from .decontaminate import decontaminate
from .exact_dedup import exact_groups
from .jaccard_join import near_duplicates
from .line_dedup import deduplicate_lines
from .lm_score import score_texts
from .mixing import label_domains, mix
from .quality import classify
from .secret_scan import scan_secrets
from .token_counts import document_token_counts

CHAT_TRICK = r"\### Assistant: </turn> ok"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mix(docs, label_domains(table(spark, sf_dir, "labels")))
    p = F.col("mix.posterior")
    return out.select(
        "doc_id", F.col("mix.n_tokens").alias("n_tokens"), p[0].alias("p_clean"), p[1].alias("p_toxic"), p[2].alias("p_low"),
        F.col("mix.rate").alias("rate"), F.col("mix.copies").alias("copies"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spell = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(F.encode(spell(base), "UTF-8"), 256).alias("base_sha256"), spell(F.col("secrets")).alias("spans"),
        n("random").alias("n_random"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "quality.content", "quality.metadata", "quality.score", "quality.rejected")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return h.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("hits.items", ","), "UTF-8"), 256).alias("items_sha256"),
        F.col("hits.contaminated").alias("contaminated"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deduplicate_lines(docs, least=1)
    n_dropped = F.coalesce(F.size("dropped_lines"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", n_dropped.alias("n_dropped"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trick = spark.range(1).select(
        F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CHAT_TRICK).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("r")
    ).select("r.*")
    out = format_conversations(turns.unionByName(trick))
    back = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    spelt = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(spelt, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_jaccard_join, op3_token_counts, op4_secret_scan, op5_quality, op6_lm_score, op7_decontaminate, op8_exact_dedup, op9_line_dedup, op10_chat_format)}


SQL = {
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS kept, text_sha256 FROM d""",
    "op10_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(i)),
e AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS new,
length(replace(replace(text, chr(92), '\b'), '<', '\l')) AS n, length(replace(replace(replace(role, chr(92), '\b'), '<', '\l'), chr(10), '\n')) AS m FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(n + CASE WHEN new THEN length('<turn>') + m + 1 + length('</turn>') + 1 ELSE length('<next>') END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
