"""Stored columns of a file as a table: one row for each leaf, with the steps that lead from the table to its values.

A leaf's steps say how a user reaches it: ``member`` of the table or a struct, ``item`` of a list, ``key`` or ``value`` of a
map. Nested types, user keys and pruning all follow from the rows: a selection is a filter of rows, and a Spark type is
what rows with common first steps fold into. Steps come from the chain of schema elements above the leaf.
"""

from __future__ import annotations

import base64
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

from ..sources.footer import logical_name


@dataclass(frozen=True)
class Element:
    """A stored schema element under its parent. Levels are sums over the chain below the root."""

    raw: dict
    parent: Element | None
    place: int  # among its siblings
    definition: int
    repetition: int

    @property
    def name(self) -> str:
        return self.raw["name"]

    @property
    def width(self) -> int:
        return self.raw.get("num_children") or 0

    @property
    def repeated(self) -> bool:
        return self.raw.get("repetition_type") == "REPEATED"

    @property
    def annotation(self) -> str:
        return logical_name(self.raw) or self.raw.get("converted_type") or ""

    @property
    def chain(self) -> list[Element]:
        """The elements from below the root to this one."""
        return [] if self.parent is None else [*self.parent.chain, self]


@dataclass(frozen=True)
class Step:
    kind: str  # member, item, key, value
    name: str = ""
    definition: int = 0  # level from which an item exists


@dataclass(frozen=True)
class Leaf:
    steps: tuple[Step, ...]
    element: Element
    fixed_size: int | None = None
    meta: dict = field(default_factory=dict)  # of the top-level field

    @property
    def path(self) -> tuple[str, ...]:
        """The stored path."""
        return tuple(e.name for e in self.element.chain)

    @property
    def names(self) -> list[str]:
        return [s.name or s.kind for s in self.steps if s.kind != "item"]

    @property
    def prefixes(self) -> list[str]:
        """User keys of the leaf and of all that it is part of, shortest first."""
        own = self.names
        return [".".join(own[: k + 1]) for k in range(len(own))]

    @property
    def key(self) -> str:
        return ".".join(self.names)

    @property
    def column(self) -> str:
        return self.steps[0].name


def elements(footer: dict) -> Iterator[Element]:
    """All schema elements in stored order; the first is the root, whose own repetition does not count."""
    above: list[tuple[Element, list[int]]] = []  # elements whose children follow, and how many have come
    for raw in footer["schema"]:
        while above and above[-1][1][0] == above[-1][0].width:
            above.pop()
        if not above:
            e = Element(raw, None, 0, 0, 0)
        else:
            up, seen = above[-1]
            kind = raw.get("repetition_type", "REQUIRED")
            e = Element(raw, up, seen[0], up.definition + (kind != "REQUIRED"), up.repetition + (kind == "REPEATED"))
            seen[0] += 1
        yield e
        above.append((e, [0]))


# Names of a LIST's repeated group that is itself the item; fixed by the Parquet format, which also names <list>_tuple.
_ITEM_GROUP = "array"


def steps_of(chain: list[Element]) -> tuple[Step, ...]:
    """Steps along a chain, by the format's rules for lists and maps.

    A repeated element is a list of its own unless the LIST or MAP group above it takes it as its entries. Those
    groups, their entries and a single item in the entries have no name for the user.
    """
    out: list[Step] = []
    rest = list(chain)
    named, entries = True, False
    while rest:
        e, *rest = rest
        if named:
            out.append(Step("member", e.name))
        if e.repeated and not entries:
            out.append(Step("item", definition=e.definition))
        named, entries = True, False
        note = e.annotation.split("(")[0]
        if note not in ("LIST", "MAP", "MAP_KEY_VALUE") or e.width != 1 or not rest or not rest[0].repeated:
            continue
        group, named = rest[0], False
        if note == "LIST":
            whole = group.width != 1 or group.name in (_ITEM_GROUP, f"{e.name}_tuple")
        else:
            whole = group.width not in (1, 2)  # keys without values are a list of keys
        if note != "LIST" and group.width == 2:
            out.append(Step(("key", "value")[rest[1].place]))
        else:
            out.append(Step("item", definition=group.definition))
        if whole:
            entries = True
        else:
            rest = rest[1:]
    return tuple(out)


def keys_only(x: Leaf) -> bool:
    """Whether a map without values leads to the leaf: it is a list of its keys."""
    c = x.element.chain
    return any(e.annotation.startswith("MAP") and e.width == 1 and group.repeated and group.width == 1 for e, group in zip(c, c[1:], strict=False))


def leaf_table(footer: dict, arrow: pa.Schema | None = None) -> tuple[Leaf, ...]:
    """Leaves in stored order; an Arrow schema adds fixed sizes and the metadata of top-level fields."""
    out = []
    for e in elements(footer):
        if e.parent is not None and not e.width:
            steps = steps_of(e.chain)
            at = -1 if arrow is None else arrow.get_field_index(steps[0].name)
            if at < 0:
                out.append(Leaf(steps, e))
            else:
                own = arrow.field(at)
                out.append(Leaf(steps, e, _declared(own.type, steps[1:]) if fixed_width(e) else None, _text(own.metadata)))
    return tuple(out)


def _text(meta: dict | None) -> dict:
    return {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in (meta or {}).items() if not k.startswith(b"PARQUET:")}


def _declared(t: pa.DataType, steps: tuple[Step, ...]) -> int | None:
    """The size of the list whose items the leaf's values are, where an Arrow type declares one there."""
    size = None
    for s in steps:
        size = None
        if s.kind == "member" and pa.types.is_struct(t) and t.get_field_index(s.name) >= 0:
            t = t.field(s.name).type
        elif s.kind in ("key", "value") and pa.types.is_map(t):
            t = t.key_type if s.kind == "key" else t.item_type
        elif s.kind == "item" and (pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t)):
            size = t.list_size if pa.types.is_fixed_size_list(t) else None
            t = t.value_type
        else:
            return None  # the types do not line up
    return size


def fixed_width(e: Element) -> bool:
    return e.raw["type"] in ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE") and not e.annotation.startswith("DECIMAL")


def arrow_schema(footer: dict) -> pa.Schema | None:
    """The writer's Arrow schema, if the file has one that can be read; a malformed one is a warning."""
    for kv in footer.get("key_value_metadata") or ():
        if kv["key"] == "ARROW:schema":
            try:
                return pa.ipc.read_schema(pa.BufferReader(base64.b64decode(kv["value"])))
            except Exception as e:  # whatever the bytes hold, the file stays readable without it
                warnings.warn(f"malformed ARROW:schema: {e}", stacklevel=2)
    return None


def selected(table: tuple[Leaf, ...], columns: list[str] | None) -> tuple[Leaf, ...]:
    """Rows under any of the keys (all for None), in stored order. A key that leads to no leaf is a ValueError."""
    if columns is None:
        return table
    wanted = dict.fromkeys(columns)
    out = [x for x in table if not wanted.keys().isdisjoint(x.prefixes)]
    found = {p for x in out for p in x.prefixes}
    if lost := [c for c in wanted if c not in found]:
        raise ValueError(f"not in this file: {', '.join(map(repr, lost))}. Its columns are {', '.join(dict.fromkeys(x.column for x in table))}; parts have dotted keys, map sides end in key or value")
    return tuple(out)


def parts(rows: tuple[Leaf, ...], depth: int) -> list[tuple[Step, tuple[Leaf, ...]]]:
    """Rows by their step at a depth. Rows in stored order have equal steps side by side."""
    return [(s, tuple(own)) for s, own in groupby(rows, lambda x: x.steps[depth])]


def sides(rows: tuple[Leaf, ...], depth: int) -> list[str]:
    """Map sides at a depth, none where there is no map."""
    return [s.kind for s, _ in parts(rows, depth) if s.kind in ("key", "value")]


def with_whole_maps(rows: tuple[Leaf, ...], table: tuple[Leaf, ...]) -> tuple[Leaf, ...]:
    """The rows, and for every map with one side only the first leaf of the other: what a scan has to read."""
    have = {x.steps: x for x in rows}
    first: dict[tuple, dict[str, Leaf]] = {}
    for x in table:
        for d, s in enumerate(x.steps):
            if s.kind in ("key", "value"):
                first.setdefault(x.steps[:d], {}).setdefault(s.kind, x)
    for x in rows:
        for d, s in enumerate(x.steps):
            if s.kind in ("key", "value"):
                other = "value" if s.kind == "key" else "key"
                if not any(y[: d + 1] == (*x.steps[:d], Step(other)) for y in have):
                    spare = first[x.steps[:d]][other]
                    have[spare.steps] = spare
    if len(have) == len(rows):
        return rows
    return with_whole_maps(tuple(x for x in table if x.steps in have), table)


# Spark types of physical types and annotations.
_PLAIN = {
    "BOOLEAN": T.BooleanType(), "INT32": T.IntegerType(), "INT64": T.LongType(), "INT96": T.TimestampType(), "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(), "BYTE_ARRAY": T.BinaryType(), "FIXED_LEN_BYTE_ARRAY": T.BinaryType(),
}
_NOTED = {
    "STRING": T.StringType(), "UTF8": T.StringType(), "ENUM": T.StringType(), "JSON": T.StringType(), "DATE": T.DateType(),
    "INTEGER(8,SIGNED)": T.ByteType(), "INTEGER(16,SIGNED)": T.ShortType(), "INTEGER(8,UNSIGNED)": T.ShortType(), "INTEGER(16,UNSIGNED)": T.IntegerType(),
    "INTEGER(32,UNSIGNED)": T.LongType(), "INTEGER(64,UNSIGNED)": T.DecimalType(20, 0), "INT_8": T.ByteType(), "INT_16": T.ShortType(),
    "UINT_8": T.ShortType(), "UINT_16": T.IntegerType(), "UINT_32": T.LongType(), "UINT_64": T.DecimalType(20, 0),
    "TIMESTAMP_MILLIS": T.TimestampType(), "TIMESTAMP_MICROS": T.TimestampType(),
}


def leaf_type(e: Element) -> T.DataType:
    """Spark type of a leaf. What Spark has no type for stays as stored: nanoseconds, times, half floats."""
    note = e.annotation
    if note.startswith("TIMESTAMP(") and "NANOS" not in note:
        return T.TimestampType() if note.endswith("UTC)") else T.TimestampNTZType()
    if note.startswith("DECIMAL"):
        return T.DecimalType(e.raw.get("precision") or 10, e.raw.get("scale") or 0)
    return _NOTED.get(note, _PLAIN[e.raw["type"]])


def folded(rows: tuple[Leaf, ...], depth: int, leaf: Callable[[Leaf], T.DataType]) -> T.DataType:
    """Spark type of what the rows have below their common first steps; half a map is a list of one-member structs."""
    if len(rows[0].steps) == depth:
        return leaf(rows[0])
    below = [(s, folded(own, depth + 1, leaf)) for s, own in parts(rows, depth)]
    kinds = [s.kind for s, _ in below]
    if kinds == ["key", "value"]:
        return T.MapType(below[0][1], below[1][1])
    if kinds == ["item"]:
        return T.ArrayType(below[0][1])
    made = T.StructType([T.StructField(s.name or s.kind, t) for s, t in below])
    return made if kinds[0] == "member" else T.ArrayType(made)


def stored_note(e: Element) -> str | None:
    """Annotation that Spark's type does not show, kept in field metadata for writing back."""
    note = e.annotation
    if "SIGNED" in note and "UNSIGNED" not in note or note.startswith("TIMESTAMP") and "MICROS" in note:
        return None
    return note if note.startswith(("INTEGER", "UINT", "TIME", "FLOAT16", "UUID")) else None


def field_metadata(rows: tuple[Leaf, ...]) -> dict[str, Any]:
    """Metadata of a top-level field: the file's own, fixed_size(s) and stored annotations by user key."""
    out: dict[str, Any] = dict(rows[0].meta)
    # A size of the column itself is fixed_size; sizes of lists further in are told by their keys.
    sizes = {x.key: x.fixed_size for x in rows if x.fixed_size}
    if len(rows[0].steps) == 2 and rows[0].fixed_size:
        out["fixed_size"] = sizes.pop(rows[0].key)
    if sizes:
        out["fixed_sizes"] = sizes
    if notes := {x.key: note for x in rows if (note := stored_note(x.element))}:
        out["stored"] = notes
    return out


def spark_schema(rows: tuple[Leaf, ...]) -> T.StructType:
    return T.StructType([T.StructField(s.name, folded(own, 1, lambda x: leaf_type(x.element)), True, field_metadata(own)) for s, own in parts(rows, 0)])


#: Columns of a read plan as a table.
PLAN = "key string, type string, repetition long, definition long, item_definitions array<long>, fixed_size long, path string"


def plan_rows(rows: tuple[Leaf, ...]) -> list[tuple]:
    """The read plan: for each leaf its key, Spark type, levels, the level from which the items of each list exist, and path."""
    return [
        (x.key, leaf_type(x.element).simpleString(), x.element.repetition, x.element.definition, [s.definition for s in x.steps if s.kind == "item"], x.fixed_size, ".".join(x.path))
        for x in rows
    ]


def message(footer: dict) -> str:
    """The stored schema as a message definition, in the notation of the Parquet format's own tools."""
    out: list[str] = []
    depth = 0
    for e in elements(footer):
        while depth > len(e.chain):
            depth -= 1
            out.append(f"{'  ' * depth}}}")
        if e.parent is None:
            head = f"message {e.name}"
        else:
            size = f"({e.raw['type_length']})" if e.raw.get("type") == "FIXED_LEN_BYTE_ARRAY" else ""
            note = f" ({e.annotation})" if e.annotation else ""
            head = f"{'  ' * depth}{e.raw.get('repetition_type', 'REQUIRED').lower()} {'group' if e.width else e.raw['type'].lower() + size} {e.name}{note}"
        out.append(f"{head} {{" if e.width or e.parent is None else f"{head};")
        depth += bool(e.width or e.parent is None)
    while depth:
        depth -= 1
        out.append(f"{'  ' * depth}}}")
    return "\n".join(out)
