"""Footers and page headers as DataFrames: no data is decoded and no scan is launched.

Few files are read through Hadoop on the driver; with more, executors read them by range, one task for many files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans.leaves import elements
from . import footer as ft
from .files import data_files, read_range

#: Files up to which the driver reads footers itself.
DRIVER_FILES = 32

SCHEMA_ELEMENTS = "file string, ordinal long, name string, path string, type string, type_length long, repetition string, num_children long, converted_type string, logical_type string, scale long, precision long, field_id long"
ROW_GROUPS = "file string, row_group long, num_rows long, total_byte_size long, total_compressed_size long, num_columns long"
COLUMN_CHUNKS = (
    "file string, row_group long, column long, path string, type string, codec string, encodings string, num_values long, "
    "compressed_size long, uncompressed_size long, first_page_offset long, null_count long, min_value binary, max_value binary"
)
KEY_VALUES = "file string, key string, value string"
FILES = "file string, version long, num_rows long, num_row_groups long, created_by string"
PAGES = (
    "file string, row_group long, column long, path string, page long, type string, encoding string, num_values long, num_nulls long, "
    "num_rows long, header_size long, compressed_size long, uncompressed_size long, offset long"
)

Read = Callable[[int, int], bytes]


def _schema_rows(file: str, f: dict, _: Read) -> Iterator[tuple]:
    for i, x in enumerate(elements(f)):
        e = x.raw
        yield (
            file, i, x.name, ".".join(y.name for y in x.chain), e.get("type"), e.get("type_length"), e.get("repetition_type"), e.get("num_children"),
            e.get("converted_type"), ft.logical_name(e), e.get("scale"), e.get("precision"), e.get("field_id"),
        )


def _group_rows(file: str, f: dict, _: Read) -> Iterator[tuple]:
    for k, g in enumerate(f.get("row_groups") or ()):
        yield file, k, g["num_rows"], g["total_byte_size"], g.get("total_compressed_size"), len(g["columns"])


def _chunk_rows(file: str, f: dict, _: Read) -> Iterator[tuple]:
    for k, g in enumerate(f.get("row_groups") or ()):
        for j, c in enumerate(g["columns"]):
            m = c["meta"]
            s = m.get("statistics") or {}
            yield (
                file, k, j, ".".join(m["path"]), m["type"], m["codec"], ",".join(sorted(set(m["encodings"]))), m["num_values"], m["total_compressed_size"],
                m["total_uncompressed_size"], ft.chunk_start(m), s.get("null_count"), s.get("min_value"), s.get("max_value"),
            )


def _kv_rows(file: str, f: dict, _: Read) -> Iterator[tuple]:
    for kv in f.get("key_value_metadata") or ():
        yield file, kv["key"], kv.get("value")


def _file_rows(file: str, f: dict, _: Read) -> Iterator[tuple]:
    yield file, f["version"], f["num_rows"], len(f.get("row_groups") or ()), f.get("created_by")


def _page_rows(file: str, f: dict, read: Read) -> Iterator[tuple]:
    for k, g in enumerate(f.get("row_groups") or ()):
        for j, c in enumerate(g["columns"]):
            m = c["meta"]
            start = ft.chunk_start(m)
            if start is None:
                continue
            for i, h in enumerate(ft.page_headers(read, start, m["total_compressed_size"], m["num_values"])):
                d = h.get("v1") or h.get("v2") or h.get("dictionary") or {}
                yield (
                    file, k, j, ".".join(m["path"]), i, h["type"], d.get("encoding"), d.get("num_values"), d.get("num_nulls"), d.get("num_rows"),
                    h["header_size"], h["compressed_page_size"], h["uncompressed_page_size"], h["offset"],
                )


def _frame(spark: SparkSession, path: str, schema: str, rows: Callable) -> DataFrame:
    files = data_files(spark, path)
    if len(files) <= DRIVER_FILES:
        out = []
        for file, length in files:
            read = lambda start, n, file=file: read_range(spark, file, start, n)
            out += rows(file, ft.footer_of(read, length), read)
        return spark.createDataFrame(out, schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        names = [part.split()[0] for part in schema.split(", ")]
        for pdf in batches:
            for file, length in zip(pdf["file"], pdf["length"], strict=True):
                fs, p = FileSystem.from_uri(f"file://{file[5:]}" if file.startswith("file:/") and not file.startswith("file://") else file)
                with fs.open_input_file(p) as f:
                    read = lambda start, n, f=f: f.read_at(n, start)
                    yield pd.DataFrame(list(rows(file, ft.footer_of(read, length), read)), columns=names).astype(object)

    return spark.createDataFrame(files, "file string, length long").repartition(max(1, len(files) // 16)).mapInPandas(run, schema)


def schema_elements(spark: SparkSession, path: str) -> DataFrame:
    return _frame(spark, path, SCHEMA_ELEMENTS, _schema_rows)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    return _frame(spark, path, ROW_GROUPS, _group_rows)


def column_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _frame(spark, path, COLUMN_CHUNKS, _chunk_rows)


def key_values(spark: SparkSession, path: str) -> DataFrame:
    return _frame(spark, path, KEY_VALUES, _kv_rows)


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    return _frame(spark, path, FILES, _file_rows)


def pages(spark: SparkSession, path: str) -> DataFrame:
    return _frame(spark, path, PAGES, _page_rows)
