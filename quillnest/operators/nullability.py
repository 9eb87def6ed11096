"""Exact nullability: a node admits null only if one occurs in the data. One aggregate pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tests(c: Column, t: T.DataType, key: str) -> list[tuple[str, Column]]:
    """(path, whether the row holds a null there); list items are path[], map sides path.key and path.value.

    A member is null wherever its struct is; items are looked at only where there are any.
    """
    out = [(key, c.isNull())]
    if isinstance(t, T.StructType):
        for f in t:
            out += _tests(c.getField(f.name), f.dataType, f"{key}.{f.name}")
    elif isinstance(t, T.ArrayType):
        out += _inside(c, t.elementType, f"{key}[]")
    elif isinstance(t, T.MapType):
        out += _inside(F.map_keys(c), t.keyType, f"{key}.key") + _inside(F.map_values(c), t.valueType, f"{key}.value")
    return out


def _inside(items: Column, t: T.DataType, key: str) -> list[tuple[str, Column]]:
    found = _tests(F.col("x"), t, key)
    nth = lambda i: lambda x: _tests(x, t, key)[i][1]  # noqa: E731  the test as a function of the item
    return [(k, F.exists(items, nth(i))) for i, (k, _) in enumerate(found)]


def nullability(df: DataFrame) -> DataFrame:
    """One row for each node: node and admits_null. No rows admit none."""
    tests = [x for f in df.schema for x in _tests(F.col(f"`{f.name}`"), f.dataType, f.name)]
    wide = df.agg(*(F.coalesce(F.max(F.coalesce(t, F.lit(False))), F.lit(False)).alias(str(i)) for i, (_, t) in enumerate(tests)))
    pairs = F.array(*(F.struct(F.lit(k).alias("node"), F.col(f"`{i}`").alias("admits_null")) for i, (k, _) in enumerate(tests)))
    return wide.select(F.explode(pairs).alias("r")).select("r.node", "r.admits_null")


def tightened(df: DataFrame) -> T.StructType:
    """The schema with nullability as observed. Reads the data once."""
    seen = {r.node: r.admits_null for r in nullability(df).collect()}  # one row for each node of the schema

    def fit(t: T.DataType, key: str) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, fit(f.dataType, f"{key}.{f.name}" if key else f.name), seen[f"{key}.{f.name}" if key else f.name], f.metadata) for f in t])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(fit(t.elementType, f"{key}[]"), seen[f"{key}[]"])
        if isinstance(t, T.MapType):
            return T.MapType(fit(t.keyType, f"{key}.key"), fit(t.valueType, f"{key}.value"), seen[f"{key}.value"])
        return t

    return fit(df.schema, "")
