r"""Chat formatting in Spark expressions: turns are collected, sorted, merged, escaped and concatenated.

Template of a conversation, one block per run of adjacent turns with one role::

    <turn>role
    text<next>text</turn>

Inside roles and texts ``\`` becomes ``\b`` and ``<`` becomes ``\l``, in roles also a line feed ``\n``; so no mark can
come from a text and ``parse`` restores every turn exactly, the turns inside a merged block included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role whose texts are under the loss mask.
LEARNED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id: formatted (the text) and loss_spans, array<struct<start, length>> of code points in it.

    turns: conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, ties by role, then
    text; a null turn comes first, a null role or text is empty, rows without conv_id form one conversation.
    Adjacent turns of one role share a block. An empty table gives no rows. A conversation is one value of the result,
    so it has to fit one row.
    """
    t = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def output(ps: Column) -> Column:
        at = running(F.transform(ps, lambda p: length(p["head"]) + length(p["body"]) + length(p["tail"])))
        learned = F.filter(F.arrays_zip(ps.alias("p"), at.alias("at")), lambda z: z["p"]["role"] == LEARNED)
        return F.struct(
            F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
            F.transform(learned, lambda z: F.struct((z["at"] + length(z["p"]["head"])).alias("start"), length(z["p"]["body"]).alias("length"))).alias("loss_spans"),
        )

    made = convs.select("conv_id", bound(F.col("ts"), lambda ts: bound(pieces(ts), output)).alias("o"))
    return made.select("conv_id", "o.formatted", "o.loss_spans")


def length(c: Column) -> Column:
    return F.char_length(c).cast("long")


def pieces(ts: Column) -> Column:
    """What each turn adds to the output: the head of a run of turns with its role, the escaped text, the mark after it.

    Runs end where a neighbour's role differs, so adjacent turns of one role merge without copying what came before.
    """

    def piece(x: Column, i: Column) -> Column:
        same = lambda k: F.get(ts, k)["role"].eqNullSafe(x["role"])
        head = F.concat(F.lit("<turn>"), F.replace(escape(x["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
        return F.struct(
            x["role"].alias("role"), F.when(same(i - 1), F.lit("")).otherwise(head).alias("head"),
            escape(x["text"]).alias("body"), F.when(same(i + 1), F.lit("<next>")).otherwise(F.lit("</turn>\n")).alias("tail"),
        )

    return F.transform(ts, piece)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value worked out once: an expression inside a lambda would be worked out for each element."""
    return F.transform(F.array(value), f)[0]


def running(values: Column) -> Column:
    """Sums of all values before each: array aggregations over chunks of about the root of their number, so that
    neither a long array is copied for each value nor all before it added up."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda x, y: x + y)

    def sums(v: Column) -> Column:
        k = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / k).cast("int")), lambda c: F.slice(v, c * k + 1, k))

        def inner(cs: Column, totals: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                before = total(F.slice(totals, F.lit(1), i))
                return bound(before, lambda b: F.transform(c, lambda _, j: b + total(F.slice(c, F.lit(1), j))))

            return F.flatten(F.transform(cs, one))

        return bound(chunks, lambda cs: bound(F.transform(cs, total), lambda totals: inner(cs, totals)))

    return bound(values, sums)


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of the original turns, read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.substring(block, F.lit(7), F.char_length(block))
        cut = F.instr(body, F.lit("\n"))
        role = unescape(F.replace(F.substring(body, F.lit(1), cut - 1), F.lit("\\n"), F.lit("\n")))
        texts = F.split(F.substring(body, cut + 1, F.char_length(body)), "<next>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


#: Code points of the segments that a formatted text is cut into: a span is looked up in its own segments only.
SEGMENT = 2048


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    segments = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))

    def cut(found: Column) -> Column:
        def text(s: Column) -> Column:
            first, last = F.floor(s["start"] / SEGMENT), F.floor((s["start"] + s["length"]) / SEGMENT)
            near = F.array_join(F.slice(found, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
            return unescape(F.substring(near, (s["start"] - first * SEGMENT + 1).cast("int"), s["length"].cast("int")))

        return F.array_join(F.transform(spans, text), "")

    return bound(segments, cut)
