"""Spark types by user key: lists add nothing to a key, map sides are key and value."""

from __future__ import annotations

from pyspark.sql import types as T


def loosened(t: T.DataType) -> T.DataType:
    """The type with everything nullable but map keys."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, loosened(f.dataType), True, f.metadata) for f in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(loosened(t.elementType), True)
    if isinstance(t, T.MapType):
        return T.MapType(loosened(t.keyType), loosened(t.valueType), True)
    return t


def type_leaves(t: T.DataType, above: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """(keys, type) of the leaves of a Spark type, in schema order; the last of the keys is the leaf's own, the others
    are those of what it is part of."""
    if isinstance(t, T.ArrayType):
        return type_leaves(t.elementType, above)
    inner = {f.name: f.dataType for f in t} if isinstance(t, T.StructType) else {"key": t.keyType, "value": t.valueType} if isinstance(t, T.MapType) else None
    if inner is None:
        return [(above, t)]
    base = f"{above[-1]}." if above else ""
    return [x for name, own in inner.items() for x in type_leaves(own, (*above, base + name))]


def resolve(schema: T.StructType, wanted: dict[str, str]) -> dict[str, str]:
    """For each leaf key the value that wanted gives the leaf or the nearest thing it is part of."""
    out, used = {}, set()
    for keys, _ in type_leaves(schema):
        used.update(wanted.keys() & set(keys))
        if named := [k for k in keys if k in wanted]:
            out[keys[-1]] = wanted[named[-1]]
    if lost := [k for k in wanted if k not in used]:
        raise ValueError(f"not in this table: {', '.join(map(repr, lost))}. Its columns are {', '.join(schema.fieldNames())}")
    return out
