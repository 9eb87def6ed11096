"""Physical layout of column chunks as DataFrame expressions: runs, deltas, dictionaries, byte streams, bit widths.

``by`` names the columns of one chunk (a row group), ``order`` a total order within it; windows never span chunks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELTA_BLOCK, MINIBLOCK = 128, 32
#: Bytes of distinct values up to which a chunk keeps its dictionary.
DICTIONARY_BYTES = 1 << 20


def _within(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def bit_width(c: Column) -> Column:
    """Bits of a nonnegative long."""
    return F.when(c == 0, 0).otherwise(F.length(F.bin(c)))


def runs(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Runs of equal values (nulls are equal): by, run (from 0), value, length."""
    w = _within(by, order)
    row = F.row_number().over(w)
    same = F.col(value).eqNullSafe(F.lag(value).over(w)) & (row > 1)
    marked = df.select(*by, *[o for o in order if o not in by], F.col(value).alias("value"), (~same).cast("long").alias("new"))
    numbered = marked.select(*by, "value", (F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("run"))
    return numbered.groupBy(*by, "run", "value").agg(F.count(F.lit(1)).alias("length"))


def deltas(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Delta blocks of whole numbers: by, block (of 128 deltas), miniblock (of 32), first value of the chunk, least delta of the
    block and the bit width of the miniblock's deltas less that. Deltas wrap around at 64 bits."""
    w = _within(by, order)
    prev = F.lag(value).over(w)
    wrapped = F.when(prev.isNotNull(), F.col(value).cast("decimal(20,0)") - prev.cast("decimal(20,0)"))
    two64, two63 = (F.lit(str(1 << k)).cast("decimal(21,0)") for k in (64, 63))
    wrapped = F.when(wrapped >= two63, wrapped - two64).when(wrapped < -two63, wrapped + two64).otherwise(wrapped).cast("long")
    rows = df.select(*by, wrapped.alias("delta"), (F.row_number().over(w) - 2).cast("long").alias("at"), F.first(value).over(w).alias("first"))
    rows = rows.where("at >= 0").withColumn("block", F.expr(f"at DIV {DELTA_BLOCK}")).withColumn("miniblock", F.expr(f"at % {DELTA_BLOCK} DIV {MINIBLOCK}"))
    parts = rows.groupBy(*by, "block", "miniblock", "first").agg(F.max("delta").alias("most"), F.min("delta").alias("least"))
    least = F.min("least").over(Window.partitionBy(*by, "block")).alias("min_delta")  # of four rows at most
    parts = parts.select(*by, "block", "miniblock", "first", "most", least)
    spread = F.col("most").cast("decimal(20,0)") - F.col("min_delta").cast("decimal(20,0)")
    width = F.length(F.conv(spread.cast("string"), 10, 2))
    return parts.select(*by, "block", "miniblock", "first", "min_delta", F.when(spread == 0, 0).otherwise(width).cast("long").alias("bit_width"))


def dictionary(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Distinct non-null values of each chunk by first appearance: by, value, index (from 0), count, index_bits."""
    w = _within(by, order)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("value"), F.row_number().over(w).alias("at"))
    distinct = rows.groupBy(*by, "value").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("count"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    index = (F.row_number().over(Window.partitionBy(*by).orderBy("first")) - 1).cast("long").alias("index")
    return distinct.select(*by, "value", index, "count", F.greatest(F.lit(1), bit_width(n - 1)).cast("long").alias("index_bits"))


def plain_size(c: Column, t: T.DataType) -> Column:
    """Bytes of a value in PLAIN encoding."""
    wide = {T.IntegerType: 4, T.ShortType: 4, T.ByteType: 4, T.FloatType: 4, T.DateType: 4}
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.octet_length(c).cast("long") + 4
    return F.lit(wide.get(type(t), 8)).cast("long")


def dictionary_fits(df: DataFrame, columns: list[str], by: list[str], limit: int = DICTIONARY_BYTES) -> DataFrame:
    """Whether each column's distinct values of a chunk stay in a dictionary page: by, column, n_distinct, bytes, fits."""
    out = None
    for c in columns:
        d = df.where(F.col(c).isNotNull()).select(*by, F.lit(c).alias("column"), F.col(c).alias("v")).distinct()
        one = d.groupBy(*by, "column").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum(plain_size(F.col("v"), df.schema[c].dataType)).alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("fits", F.col("bytes") <= limit)


def byte_streams(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Byte stream split: keys, stream (from 0, least significant byte first) and byte of each double or float.

    Spark has no expression for a number's bits; they come from Arrow batches as they are.
    """
    kind = "<f4" if isinstance(df.schema[value].dataType, T.FloatType) else "<f8"

    def stored(v: pd.Series) -> pd.Series:
        data, wide = v.to_numpy().astype(kind).tobytes(), int(kind[2:])
        return pd.Series([data[at : at + wide] for at in range(0, len(data), wide)])

    stored.__annotations__ = {"v": pd.Series, "return": pd.Series}
    bits = df.where(F.col(value).isNotNull()).select(*keys, F.pandas_udf(stored, T.BinaryType())(value).alias("b"))
    width = int(kind[2:])
    byte = lambda k: F.conv(F.hex(F.substring("b", F.lit(k + 1), F.lit(1))), 16, 10).cast("int")
    streams = F.array(*(F.struct(F.lit(k).alias("stream"), byte(k).alias("byte")) for k in range(width)))
    return bits.select(*keys, F.explode(streams).alias("s")).select(*keys, "s.stream", "s.byte")


def epoch_units(c: Column, t: T.DataType) -> dict[str, Column]:
    """Stored integers of a date (days) or timestamp (ms, us)."""
    if isinstance(t, T.DateType):
        return {"days": F.unix_date(c).cast("long")}
    us = F.unix_micros(c.cast("timestamp"))
    return {"days": F.unix_date(c.cast("date")).cast("long"), "ms": F.floor(us / 1000).cast("long"), "us": us}
