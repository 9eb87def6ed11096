"""Reading: a pruned user schema for Spark's Parquet reader, or the Arrow source where Spark cannot decode.

The plan comes from the footer, keys are resolved against it, and the scan gets exactly the selected members, so
that pruning does not depend on how later expressions are written. Paths may be a file or a folder of part files;
the first file's footer gives the schema.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import leaves
from ..plans.leaves import Leaf
from . import metadata
from .files import data_files, read_range
from .footer import footer_of


#: What sends a chunk to the Arrow source.
HARD_CODECS, HARD_ENCODING = ("BROTLI", "LZ4"), "BYTE_STREAM_SPLIT"


class ColumnReadError(RuntimeError):
    """A column cannot be decoded. Read the others with ``columns=``."""

    def __init__(self, column: str, cause: BaseException):
        super().__init__(f"cannot read column {column!r}: {cause}; pass columns= without it to read the rest")
        self.column, self.cause = column, cause


class ParquetFile:
    """Handle of a Parquet file or folder: footer facts without a scan, and reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.files = data_files(spark, path)
        if not self.files:
            raise FileNotFoundError(f"{path} has no data files")

    def footer_at(self, k: int) -> dict:
        file, length = self.files[k]
        return footer_of(lambda start, n: read_range(self.spark, file, start, n), length)

    @cached_property
    def footer(self) -> dict:
        return self.footer_at(0)

    @cached_property
    def few(self) -> list[dict] | None:
        """The footers of all files, where there are few."""
        if len(self.files) > metadata.DRIVER_FILES:
            return None
        return [self.footer, *(self.footer_at(k) for k in range(1, len(self.files)))]

    @cached_property
    def plan(self) -> tuple[Leaf, ...]:
        return leaves.leaf_table(self.footer, leaves.arrow_schema(self.footer))

    @cached_property
    def facts(self) -> list[tuple[str, int, int]]:
        """(file, rows, row groups) of every file; the footers of many files are read by executors."""
        if self.few is not None:
            return [(file, f["num_rows"], len(f.get("row_groups") or ())) for (file, _), f in zip(self.files, self.few, strict=True)]
        rows = metadata.file_facts(self.spark, self.path).select("file", "num_rows", "num_row_groups").collect()
        return sorted(map(tuple, rows))

    @property
    def num_rows(self) -> int:
        return sum(n for _, n, _ in self.facts)

    @property
    def num_row_groups(self) -> int:
        return sum(n for *_, n in self.facts)

    @property
    def schema(self) -> T.StructType:
        return leaves.spark_schema(self.plan)

    @property
    def column_names(self) -> list[str]:
        return list(dict.fromkeys(x.column for x in self.plan))

    @property
    def metadata(self) -> dict:
        return self.footer

    def schema_string(self) -> str:
        return leaves.message(self.footer)

    def read_plan(self, columns: list[str] | None = None) -> DataFrame:
        """The leaves that a read of the columns decodes, with their levels."""
        return self.spark.createDataFrame(leaves.plan_rows(leaves.selected(self.plan, columns)), leaves.PLAN)

    def close(self) -> None:
        """Nothing stays open."""

    def __enter__(self) -> ParquetFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def open_parquet(spark: SparkSession, path: str) -> ParquetFile:
    """A handle; a missing file is a FileNotFoundError and nothing is created."""
    return ParquetFile(spark, path)


def read_parquet(
    source: ParquetFile | str, columns: list[str] | None = None, spark: SparkSession | None = None, stored: bool = False, check_sizes: bool = True
) -> DataFrame:
    """The file's columns, or the selected parts of them, in schema order.

    columns: dotted user keys; ``wf.t0`` gives ``wf`` as a struct of t0, ``l.x`` a list of structs of x, ``m.key`` a list
    of structs of key. stored: decimals as unscaled integers (bytes for those stored as bytes). check_sizes: a list
    that is not as long as its declared fixed size is an error when it is read.
    """
    pf = source if isinstance(source, ParquetFile) else open_parquet(spark or SparkSession.active(), source)
    rows = leaves.selected(pf.plan, columns)
    scanned = leaves.with_whole_maps(rows, pf.plan)
    kind = lambda x: _scan_type(x, stored)
    physical = T.StructType([T.StructField(s.name, leaves.folded(own, 1, kind)) for s, own in leaves.parts(scanned, 0)])
    if needs_arrow(pf, scanned):
        groups = {file: n for file, _, n in pf.facts}
        options = {"files": "\n".join(groups), "groups": " ".join(map(str, groups.values())), "columns": "\n".join(dict.fromkeys(".".join(x.path) for x in scanned))}
        df = pf.spark.read.format(arrow_source(pf.spark)).schema(physical).options(path=pf.path, **options).load()
    else:
        df = pf.spark.read.schema(physical).parquet(pf.path)
    shape = _Shape(stored, check_sizes)
    return df.select(*(shape.of(F.col(f"`{s.name}`"), own, 1).alias(s.name, metadata=leaves.field_metadata(own)) for s, own in leaves.parts(rows, 0)))


def arrow_source(spark: SparkSession) -> str:
    from .arrow_io import ArrowParquet

    spark.dataSource.register(ArrowParquet)
    return ArrowParquet.name()


def needs_arrow(pf: ParquetFile, rows: tuple[Leaf, ...]) -> bool:
    """Whether a chunk of these leaves, in any file, is one that Spark may not decode: Brotli, byte stream split
    (vectorised reader), the deprecated LZ4 codec, which has two framings, or a map that stores keys only."""
    if any(leaves.keys_only(x) for x in rows):
        return True
    own = {".".join(x.path) for x in rows}
    if pf.few is not None:
        chunks = (c["meta"] for f in pf.few for g in f.get("row_groups") or () for c in g["columns"])
        return any(".".join(m["path"]) in own and (m["codec"] in HARD_CODECS or HARD_ENCODING in m["encodings"]) for m in chunks)
    c = metadata.column_chunks(pf.spark, pf.path)
    hard = F.col("codec").isin(*HARD_CODECS) | F.col("encodings").contains(HARD_ENCODING)
    return not c.where(hard & F.col("path").isin(list(own))).isEmpty()


def _scan_type(x: Leaf, stored: bool) -> T.DataType:
    t = leaves.leaf_type(x.element)
    return T.BinaryType() if stored and isinstance(t, T.DecimalType) and x.element.raw["type"] == "FIXED_LEN_BYTE_ARRAY" else t


class _Shape:
    """From scanned values to results. A value in which nothing differs is left alone, so that the plan stays prunable."""

    def __init__(self, stored: bool, check: bool):
        self.stored, self.check = stored, check

    def unscaled(self, x: Leaf) -> bool:
        return self.stored and isinstance(leaves.leaf_type(x.element), T.DecimalType) and x.element.raw["type"] in ("INT32", "INT64")

    def differs(self, rows: tuple[Leaf, ...], depth: int) -> bool:
        if any(self.unscaled(x) or self.check and x.fixed_size and len(x.steps) > depth for x in rows):
            return True
        return any(len(leaves.sides(own, d)) == 1 for d in range(depth, max(len(x.steps) for x in rows)) for own in _together(rows, d))

    def of(self, c: Column, rows: tuple[Leaf, ...], depth: int) -> Column:
        if not self.differs(rows, depth):
            return c
        if len(rows[0].steps) == depth:
            t = leaves.leaf_type(rows[0].element)
            whole = c * F.lit(10**t.scale).cast(T.DecimalType(min(38, t.scale + 1), 0))
            return whole.cast("int" if rows[0].element.raw["type"] == "INT32" else "long")
        below = leaves.parts(rows, depth)
        step, own = below[0]
        if step.kind == "item":
            out = F.transform(c, lambda x: self.of(x, own, depth + 1)) if self.differs(own, depth + 1) else c
            size = own[0].fixed_size if self.check and len(own[0].steps) == depth + 1 else None
            if size:
                says = f"column {own[0].key} has a list that is not as long as fixed_size_list[{size}] says"
                out = F.when(c.isNull() | (F.size(c) == size), out).otherwise(F.raise_error(says))
            return out
        if step.kind == "member":
            made = F.struct(*(self.of(c.getField(s.name), part, depth + 1).alias(s.name) for s, part in below))
            return F.when(c.isNotNull(), made)
        if len(below) == 2:
            return F.transform_values(c, lambda _, v: self.of(v, below[1][1], depth + 1))
        return F.transform(F.map_keys(c) if step.kind == "key" else F.map_values(c), lambda x: F.struct(self.of(x, own, depth + 1).alias(step.kind)))


def _together(rows: tuple[Leaf, ...], depth: int) -> list[tuple[Leaf, ...]]:
    """Rows with common steps above a depth that have one there."""
    by: dict[tuple, list[Leaf]] = {}
    for x in rows:
        if len(x.steps) > depth:
            by.setdefault(x.steps[:depth], []).append(x)
    return [tuple(v) for v in by.values()]


def check_columns(source: ParquetFile | str, columns: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Decode every selected leaf on its own; the first that fails is a ColumnReadError that names it."""
    pf = source if isinstance(source, ParquetFile) else open_parquet(spark or SparkSession.active(), source)
    for key in dict.fromkeys(x.key for x in leaves.selected(pf.plan, columns)):
        try:
            read_parquet(pf, [key]).write.format("noop").mode("overwrite").save()
        except Exception as e:
            raise ColumnReadError(key, e) from e
