"""Arrow-based source and sink for what Spark's own Parquet reader and writer lack, and Arrow IPC export.

Source: byte stream split and Brotli chunks, one task for each row group. Sink: delta, delta-length and byte-stream-split encodings,
Brotli, fixed-size lists, unsigned and nanosecond types; one file for each task, committed by the driver.
"""

from __future__ import annotations

import base64
import contextlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema


def _fs(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


@dataclass
class Group(InputPartition):
    file: str
    group: int


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class ArrowParquet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillnest_arrow"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        files, groups = self.options["files"].split("\n"), map(int, self.options["groups"].split())
        return _Reader(schema, [Group(f, k) for f, n in zip(files, groups, strict=True) for k in range(n)], self.options["columns"].split("\n"))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, dict(self.options), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, groups: list[Group], columns: list[str]):
        self.schema, self.groups, self.columns = schema, groups, columns

    def partitions(self) -> list[Group]:
        return self.groups

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        target = to_arrow_schema(self.schema)
        fs, path = _fs(_uri(partition.file))
        with fs.open_input_file(path) as f:
            pf = pq.ParquetFile(f)
            for batch in pf.iter_batches(16_384, [partition.group], self.columns):
                yield pa.RecordBatch.from_arrays([fitted(batch.column(x.name), x.type) for x in target], schema=target)


def fitted(a: pa.Array, t: pa.DataType) -> pa.Array:
    """The array in Spark's type: times and nanoseconds as integers, half floats as bytes, fixed sizes as lists."""
    if isinstance(a, pa.ExtensionArray):
        a = a.storage
    s = a.type
    if s.equals(t):
        return a
    if pa.types.is_struct(t) and pa.types.is_struct(s):
        return pa.StructArray.from_arrays([fitted(pa.compute.struct_field(a, [f.name]), f.type) for f in t], fields=list(t), mask=a.is_null())
    if pa.types.is_list(t) and (pa.types.is_list(s) or pa.types.is_large_list(s) or pa.types.is_fixed_size_list(s)):
        if not pa.types.is_list(s):
            a = a.cast(pa.list_(s.value_type))
        offsets = a.offsets
        base = offsets[0].as_py() if len(offsets) else 0
        items = fitted(a.values.slice(base, offsets[-1].as_py() - base), t.value_type)
        return pa.ListArray.from_arrays(pa.compute.subtract(offsets, pa.scalar(base, pa.int32())), items, type=t, mask=a.is_null())
    if pa.types.is_map(t) and pa.types.is_map(s):
        base, end = a.offsets[0].as_py(), a.offsets[-1].as_py()
        keys, items = fitted(a.keys.slice(base, end - base), t.key_type), fitted(a.items.slice(base, end - base), t.item_type)
        offsets = pa.compute.subtract(a.offsets, pa.scalar(base, pa.int32()))
        made = pa.MapArray.from_arrays(offsets, keys, items)
        return pa.MapArray.from_buffers(t, len(a), [_validity(a), made.buffers()[1]], children=[pa.StructArray.from_arrays([keys, items], fields=[pa.field(t.key_field.name, t.key_type, False), t.item_field])]) if a.null_count else made.cast(t)
    if pa.types.is_integer(t) and (pa.types.is_timestamp(s) or pa.types.is_time(s) or pa.types.is_duration(s)):
        return a.view(pa.int32() if s.bit_width == 32 else pa.int64()).cast(t)
    if pa.types.is_binary(t) and pa.types.is_float16(s):
        return a.view(pa.binary(2)).cast(t)
    return a.cast(t)


def _validity(a: pa.Array) -> pa.Buffer | None:
    bits = a.is_valid()
    return (pa.concat_arrays([bits]) if bits.offset else bits).buffers()[1]


#: Arrow types of stored annotations that Spark's types do not show.
def _stored_type(note: str, t: pa.DataType) -> pa.DataType:
    plain = {"INTEGER(8,UNSIGNED)": pa.uint8(), "UINT_8": pa.uint8(), "INTEGER(16,UNSIGNED)": pa.uint16(), "UINT_16": pa.uint16(),
             "INTEGER(32,UNSIGNED)": pa.uint32(), "UINT_32": pa.uint32(), "INTEGER(64,UNSIGNED)": pa.uint64(), "UINT_64": pa.uint64()}
    if note in plain:
        return plain[note]
    kind, _, rest = note.partition("(")
    unit = {"MILLIS": "ms", "MICROS": "us", "NANOS": "ns"}.get(rest.split(",")[0].rstrip(")"))
    if kind == "TIMESTAMP" and unit:
        return pa.timestamp(unit, "UTC" if rest.endswith("UTC)") else None)
    if kind == "TIME" and unit:
        return pa.time32("ms") if unit == "ms" else pa.time64(unit)
    return t


def sink_schema(schema: T.StructType, fixed: bool = True) -> pa.Schema:
    """Arrow schema to write: Spark's, with stored annotations and, if fixed, fixed sizes of the field metadata."""

    def typed(t: pa.DataType, key: str, sizes: dict, notes: dict) -> pa.DataType:
        if pa.types.is_struct(t):
            return pa.struct([pa.field(f.name, typed(f.type, f"{key}.{f.name}" if key else f.name, sizes, notes)) for f in t])
        if pa.types.is_map(t):
            return pa.map_(typed(t.key_type, f"{key}.key", sizes, notes), typed(t.item_type, f"{key}.value", sizes, notes))
        if pa.types.is_list(t):
            inner = typed(t.value_type, key, sizes, notes)
            size = None if pa.types.is_nested(t.value_type) else sizes.get(key)
            return pa.list_(inner, size) if size and fixed else pa.list_(inner)
        if pa.types.is_timestamp(t) and key not in notes:
            return pa.timestamp("us", "UTC" if t.tz else None)
        return _stored_type(notes[key], t) if key in notes else t

    out = []
    for f, a in zip(schema, to_arrow_schema(schema), strict=True):
        meta = f.metadata or {}
        sizes = dict(meta.get("fixed_sizes") or {})
        if meta.get("fixed_size"):
            sizes[f.name] = meta["fixed_size"]
        own = {k: v for k, v in meta.items() if k not in ("fixed_size", "fixed_sizes", "stored") and isinstance(v, str)}
        out.append(pa.field(f.name, typed(a.type, f.name, sizes, dict(meta.get("stored") or {})), True, own or None))
    return pa.schema(out)


def lifted(a: pa.Array, t: pa.DataType) -> pa.Array:
    """The array in the sink's type; integers become the times they stand for, whatever they are nested in."""
    s = a.type
    if s.equals(t):
        return a
    if pa.types.is_integer(s) and pa.types.is_temporal(t):
        return a.cast(pa.int32() if t.bit_width == 32 else pa.int64()).view(t)
    if pa.types.is_struct(t):
        return pa.StructArray.from_arrays([lifted(pa.compute.struct_field(a, [f.name]), f.type) for f in t], fields=list(t), mask=a.is_null())
    if pa.types.is_list(t):
        base, end = a.offsets[0].as_py(), a.offsets[-1].as_py()
        items = lifted(a.values.slice(base, end - base), t.value_type)
        return pa.ListArray.from_arrays(pa.compute.subtract(a.offsets, pa.scalar(base, pa.int32())), items, type=t, mask=a.is_null())
    return a.cast(t)


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.options, self.overwrite = schema, options, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        import pyarrow.parquet as pq

        o = self.options
        spark_schema = T.StructType.fromJson(json.loads(o["spark_schema"]))
        # Lists are stored as plain lists, so that a fixed-size list may be null; the entry declares their sizes.
        target, declared = sink_schema(spark_schema, False), sink_schema(spark_schema)
        encodings = json.loads(o.get("encodings", "{}"))
        groups = int(o.get("rowgroup_size", 0)) or None
        plain = {k: v for k, v in encodings.items() if v != "RLE_DICTIONARY"}
        fs, folder = self._pending()
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{uuid.uuid4().hex}.parquet"
        limit, rows, load = groups or 1_000_000, 0, 0
        held: list[pa.RecordBatch] = []
        writer: pq.ParquetWriter | None = None

        def flush() -> None:
            nonlocal writer, held, load
            if writer is None:
                writer = pq.ParquetWriter(
                    fs.open_output_stream(name), target, compression=o.get("compression", "snappy"), column_encoding=plain or None,
                    use_dictionary=[k for k, v in encodings.items() if v == "RLE_DICTIONARY"], store_schema=False,
                )
                writer.add_key_value_metadata({"ARROW:schema": base64.b64encode(declared.serialize().to_pybytes()).decode()})
            writer.write_table(pa.Table.from_batches(held, target), row_group_size=limit)
            held, load = [], 0

        try:
            for batch in iterator:
                own = pa.RecordBatch.from_arrays([lifted(c, f.type) for c, f in zip(batch.columns, target, strict=True)], schema=target)
                while own.num_rows:
                    part = own.slice(0, limit - load)
                    held.append(part)
                    load += part.num_rows
                    rows += part.num_rows
                    own = own.slice(part.num_rows)
                    if load == limit:
                        flush()
            if held or not rows and TaskContext.get().partitionId() == 0:  # a table without rows has one file
                flush()
        finally:
            if writer is not None:
                writer.close()
        return Written(name if writer is not None else "", rows)

    def _pending(self) -> tuple:
        """File system and the job's own folder, which readers of the table pass over: of a task that was lost, or that ran
        twice, nothing gets further than here."""
        fs, folder = _fs(_uri(self.options["path"]))
        return fs, f"{folder}/_temporary/{self.options['job']}"

    def commit(self, messages: list[Written | None]) -> None:
        """The files that finished tasks named move into the table. One without rows stays only if no other has any."""
        fs, pending = self._pending()
        done = [m for m in messages if m and m.file]
        some = any(m.rows for m in done)
        for m in done:
            if m.rows or not some:
                fs.move(m.file, m.file.replace(f"/_temporary/{self.options['job']}/", "/"))
        self._clean(fs, pending)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*self._pending())

    def _clean(self, fs, pending: str) -> None:
        from pyarrow.fs import FileSelector

        fs.delete_dir_contents(pending, missing_dir_ok=True)
        for folder in (pending, pending.rsplit("/", 1)[0]):
            if not fs.get_file_info(FileSelector(folder, allow_not_found=True)):
                with contextlib.suppress(FileNotFoundError):
                    fs.delete_dir(folder)


def write_ipc(df: DataFrame, folder: str, rows: int = 65_536) -> DataFrame:
    """Arrow IPC export: one stream file for each task in the folder; returns file and rows. Batches have at most ``rows`` rows."""
    target = sink_schema(df.schema, False)

    def export(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = _fs(_uri(folder))
        fs.create_dir(base, recursive=True)
        name, n = f"{base}/part-{uuid.uuid4().hex}.arrows", 0
        with fs.open_output_stream(name) as f, pa.ipc.new_stream(f, target) as w:
            for batch in batches:
                own = pa.RecordBatch.from_arrays([lifted(c, x.type) for c, x in zip(batch.columns, target, strict=True)], schema=target)
                for at in range(0, own.num_rows, rows):
                    w.write_batch(own.slice(at, rows))
                n += own.num_rows
        yield pa.RecordBatch.from_pydict({"file": [name], "rows": [n]})

    return df.mapInArrow(export, "file string, rows long")


def read_ipc(files: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of exported files (column file), in the Spark schema they were exported with."""
    target = to_arrow_schema(schema)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                fs, path = _fs(name)
                with fs.open_input_file(path) as f, pa.ipc.open_stream(f) as r:
                    for own in r:
                        yield pa.RecordBatch.from_arrays([fitted(own.column(x.name), x.type) for x in target], schema=target)

    return files.select("file").mapInArrow(load, schema)
