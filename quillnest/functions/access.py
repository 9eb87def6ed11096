"""Access to nested values: members at any depth, maps with duplicate keys, fixed-size lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def member(df: DataFrame, path: str) -> Column:
    """The value at a dotted path for every row: through structs as they are, through lists as ragged lists, and
    ``key`` and ``value`` of a map as all its keys or values. A member is null where its struct is."""
    names = path.split(".")
    field = next((f for f in df.schema if f.name == names[0]), None)
    if field is None:
        raise ValueError(f"no column {names[0]!r}; columns: {', '.join(df.columns)}")
    return _member(F.col(f"`{names[0]}`"), field.dataType, names[1:], path)


def _member(c: Column, t: T.DataType, names: list[str], path: str) -> Column:
    if not names:
        return c
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, T.StructType) and len(names) == 1 and names[0] in t.elementType.names:
            return c.getField(names[0])  # this form prunes the scan
        return F.transform(c, lambda x: _member(x, t.elementType, names, path))
    if isinstance(t, T.MapType) and names[0] in ("key", "value"):
        side, of = (F.map_keys(c), t.keyType) if names[0] == "key" else (F.map_values(c), t.valueType)
        return side if len(names) == 1 else F.transform(side, lambda x: _member(x, of, names[1:], path))
    if isinstance(t, T.StructType) and names[0] in t.names:
        return _member(c.getField(names[0]), t[names[0]].dataType, names[1:], path)
    raise ValueError(f"{path!r}: no member {names[0]!r} in {t.simpleString()}")


def member_names(df: DataFrame, path: str) -> list[str]:
    """Names of the members at a path: of a struct, of the structs in a list, key and value of a map."""
    t = df.select(member(df, path)).schema[0].dataType
    while isinstance(t, T.ArrayType):
        t = t.elementType
    return t.fieldNames() if isinstance(t, T.StructType) else ["key", "value"] if isinstance(t, T.MapType) else []


def map_size(m: Column) -> Column:
    """Stored entries, duplicates counted; null for a null map."""
    return F.when(m.isNotNull(), F.size(m))


def map_get(m: Column, key: Column, default: Column | None = None) -> Column:
    """Value of the last entry with the key; the default (null) only where there is no such entry or no map."""
    found = F.filter(F.map_entries(m), lambda e: e["key"] == key)
    value = F.try_element_at(found, F.lit(-1))["value"]
    return value if default is None else F.when(map_has(m, key), value).otherwise(default)


def map_at(m: Column, key: Column) -> Column:
    """As map_get, but a missing key is an error; a null map is null."""
    missing = F.raise_error(F.concat(F.lit("key not found: "), key.cast("string")))
    return F.when(m.isNull(), None).when(map_has(m, key), map_get(m, key)).otherwise(missing)


def map_has(m: Column, key: Column) -> Column:
    return F.coalesce(F.exists(F.map_keys(m), lambda k: k == key), F.lit(False))


def map_last_wins(m: Column) -> Column:
    """The map with one entry for each key, the last stored one, in the order of those entries."""
    back = F.reverse(F.map_entries(m))
    # array_distinct keeps first places, and array_position finds them; both hash or scan once for each distinct key.
    keys = F.transform(back, lambda e: e["key"])
    last = F.transform(F.array_distinct(keys), lambda k: F.element_at(back, F.array_position(keys, k).cast("int")))
    return F.map_from_entries(F.reverse(last))


def show_map(m: Column) -> Column:
    """Entries as text in stored order: {k => v, ...}."""
    shown = F.transform(F.map_entries(m), lambda e: F.concat(e["key"].cast("string"), F.lit(" => "), F.coalesce(e["value"].cast("string"), F.lit("missing"))))
    return F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}"))


def fixed(c: Column, size: int, name: str = "") -> Column:
    """The list, or an error where a non-null list does not have this size."""
    says = f"a list of {name or 'a column'} declared fixed_size_list[{size}] has another size"
    return F.when(c.isNull() | (F.size(c) == size), c).otherwise(F.raise_error(F.lit(says)))


def wrong_size(c: Column, size: int) -> Column:
    """Whether a non-null list does not have this size."""
    return F.coalesce(F.size(c) != size, F.lit(False)) & c.isNotNull()


def element(c: Column, j: int | Column) -> Column:
    """Element of a fixed-size list, from 1; null for a null element or list."""
    return F.element_at(c, j)


def fixed_from_flat(df: DataFrame, size: int, position: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Lists of ``size`` from a flat buffer: rows (position from 0, value) become (row, values). by: columns that
    name separate buffers. A buffer whose length is not a multiple of the size is an error when it is read."""
    if size < 1:
        raise ValueError("a fixed size must be 1 or more")
    row = F.floor(F.col(position) / size).cast("long").alias("row")
    got = df.groupBy(*(by or []), row).agg(F.sort_array(F.collect_list(F.struct(position, value))).alias("v"))
    return got.select(*(by or []), "row", fixed(F.transform("v", lambda x: x[value]), size, value).alias("values"))


def fixed_from_vectors(c: Column, size: int) -> Column:
    """Values of a column of ML vectors as a checked fixed-size list; a null vector is a null list."""
    from pyspark.ml.functions import vector_to_array

    return fixed(F.when(c.isNotNull(), vector_to_array(c)), size)


def declare_fixed(df: DataFrame, name: str, size: int) -> DataFrame:
    """df whose column is marked as a fixed-size list for writing, and checked."""
    at = dict(df.schema[name].metadata or {}) | {"fixed_size": size}
    return df.withColumn(name, fixed(F.col(f"`{name}`"), size, name).alias(name, metadata=at))


