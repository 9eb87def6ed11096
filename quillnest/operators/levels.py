"""Record shredding and assembly with repetition and definition levels, as DataFrame operations.

Levels follow the writer's layout: every field, list, element and map value is optional, map keys are required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _steps(t: T.DataType, names: list[str], path: str) -> list[tuple[str, str | None]]:
    """How to reach a leaf from its column: (member, name), (list, None), (required member, key)."""
    if isinstance(t, T.ArrayType):
        return [("list", None), ("optional", None), *_steps(t.elementType, names, path)]
    if isinstance(t, T.MapType):
        if not names or names[0] not in ("key", "value"):
            raise ValueError(f"{path!r} must name key or value")
        own = t.keyType if names[0] == "key" else t.valueType
        return [("map", names[0]), ("required" if names[0] == "key" else "optional", None), *_steps(own, names[1:], path)]
    if isinstance(t, T.StructType):
        if not names or names[0] not in t.names:
            raise ValueError(f"{path!r} does not name a leaf")
        return [("member", names[0]), ("optional", None), *_steps(t[names[0]].dataType, names[1:], path)]
    if names:
        raise ValueError(f"{path!r} goes beyond a leaf")
    return []


def shred(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """One row for each level entry of a leaf: the keys, positions p1.. in each list level (0 where there is no
    item), rep, def and value. An entry without a value stands for a null, an empty list or a null above.

    keys: columns that identify a row; entries in (keys, p1, ...) order are the leaf's column.
    """
    names = path.split(".")
    steps = [("optional", None), *_steps(df.schema[names[0]].dataType, names[1:], path)]
    cur = df.select(*keys, F.col(f"`{names[0]}`").alias("cur"), F.lit(0).alias("rep"), F.lit(0).alias("def"), F.lit(True).alias("alive"))
    carried, depth = list(keys), 0
    for kind, name in steps:
        here = F.col("alive") & F.col("cur").isNotNull()
        if kind in ("optional", "required"):
            step = here.cast("int") if kind == "optional" else F.lit(0)
            cur = cur.select(*carried, "cur", "rep", (F.col("def") + step).alias("def"), here.alias("alive"))
        elif kind == "member":
            cur = cur.select(*carried, F.col("cur").getField(name).alias("cur"), "rep", "def", "alive")
        else:
            depth += 1
            items = F.col("cur") if kind == "list" else F.map_keys("cur") if name == "key" else F.map_values("cur")
            some = F.col("alive") & (F.size(items) > 0)
            # The outer explode keeps null and empty lists, which def has told apart already.
            out = cur.select(*carried, "rep", "def", F.coalesce(some, F.lit(False)).alias("some"), F.posexplode_outer(F.when(some, items)).alias("pos", "cur"))
            rep = F.when(F.col("some") & (F.col("pos") > 0), depth).otherwise(F.col("rep"))
            pos = F.coalesce("pos", F.lit(0)).alias(f"p{depth}")
            cur = out.select(*carried, pos, "cur", rep.alias("rep"), (F.col("def") + F.col("some").cast("int")).alias("def"), F.col("some").alias("alive"))
            carried.append(f"p{depth}")
    return cur.select(*carried, "rep", "def", F.when(F.col("alive"), F.col("cur")).alias("value"))


def max_definition(schema: T.StructType, path: str) -> int:
    names = path.split(".")
    return 1 + sum(k in ("optional", "list", "map") for k, _ in _steps(schema[names[0]].dataType, names[1:], path))


def record_starts(levels: DataFrame) -> DataFrame:
    """The entry at which each record begins."""
    return levels.where("rep = 0")


def null_count(df: DataFrame, path: str) -> DataFrame:
    """One row (leaf, null_count): entries without a value. A fixed-width leaf under a struct in a list
    counts existing items only, as a common writer does."""
    names = path.split(".")
    steps = [("optional", None), *_steps(df.schema[names[0]].dataType, names[1:], path)]
    level, item, in_struct = 0, 0, False
    for kind, _ in steps:
        level += kind in ("optional", "list", "map")
        if kind in ("list", "map"):
            item, in_struct = level, False
        in_struct |= kind == "member" and item > 0
    leaf = df.schema[names[0]].dataType
    for n in names[1:]:
        while isinstance(leaf, T.ArrayType):
            leaf = leaf.elementType
        leaf = (leaf.keyType if n == "key" else leaf.valueType) if isinstance(leaf, T.MapType) else leaf[n].dataType
    while isinstance(leaf, T.ArrayType):
        leaf = leaf.elementType
    wide = not isinstance(leaf, (T.StringType, T.BinaryType))
    least = item if in_struct and wide else 0
    none = F.col("value").isNull() & (F.col("def") >= least)
    return shred(df.select(F.col(f"`{names[0]}`")), path, []).agg(F.count(F.when(none, 1)).alias("null_count")).select(F.lit(path).alias("leaf"), "null_count")


def assemble(levels: DataFrame, by: list[str], order: list[str], depth: int = 1, rep: str = "rep", definition: str = "def", value: str = "value") -> DataFrame:
    """Lists from level entries, the inverse of shred for a column of lists of primitives: by, record and values.

    by: columns of one column chunk (a file's row group, or a row's key); records are numbered from 0 in each, so no
    window spans the table. depth: list levels, 1 or 2. Null list, empty list and null element come out as they were.
    """
    if depth not in (1, 2):
        raise ValueError("depth must be 1 or 2")
    d, r = F.col(definition), F.col(rep)
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    record = (F.sum((r == 0).cast("long")).over(run) - 1).alias("record")
    inner = F.sum((r < depth).cast("long")).over(run).alias("inner")
    rows = levels.select(*by, *order, d.alias("d"), F.col(value).alias("v"), record, inner)
    at = 2 * depth - 1  # definition of an innermost list that is there but has no item; items are one more
    entry = F.struct(*order, F.col("d").alias("d"), F.col("v").alias("v"))
    lists = rows.groupBy(*by, "record", "inner").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    items = F.transform(F.filter("e", lambda x: x["d"] > at), lambda x: x["v"])
    top = F.col("e")[0]["d"]
    lists = lists.select(*by, "record", "inner", top.alias("top"), F.when(top < at, None).otherwise(items).alias("values"))
    if depth == 1:
        return lists.select(*by, "record", "values")
    outer = lists.groupBy(*by, "record").agg(F.sort_array(F.collect_list(F.struct("inner", "top", "values"))).alias("e"))
    first = F.col("e")[0]["top"]
    whole = F.transform(F.filter("e", lambda x: x["top"] > 1), lambda x: x["values"])
    return outer.select(*by, "record", F.when(first < 1, None).otherwise(whole).alias("values"))
