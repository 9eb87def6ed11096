"""Writing: checks first, then Spark's own writer wherever it can do what is asked, else the Arrow sink."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans.types import resolve, type_leaves
from ..session import confs, nullable
from .files import data_files, delete, exists, rename
from .reader import arrow_source

#: Codec names and what Spark calls them; None: only the Arrow sink has it.
CODECS = {"snappy": "snappy", "gzip": "gzip", "zstd": "zstd", "lz4": "lz4_raw", "uncompressed": "none", "none": "none", "brotli": None}
#: Encoding names and Parquet's.
ENCODINGS = {
    "plain": "PLAIN", "dictionary": "RLE_DICTIONARY", "delta_binary_packed": "DELTA_BINARY_PACKED", "delta_length_byte_array": "DELTA_LENGTH_BYTE_ARRAY",
    "byte_stream_split": "BYTE_STREAM_SPLIT",
}
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


def allows(encoding: str, t: T.DataType) -> bool:
    """Whether an encoding applies to a leaf type."""
    if encoding == "byte_stream_split":
        return isinstance(t, (T.FloatType, T.DoubleType))
    if encoding == "delta_binary_packed":
        return isinstance(t, _INTEGRAL)
    if encoding == "delta_length_byte_array":
        return isinstance(t, (T.StringType, T.BinaryType))
    return encoding == "plain" or not isinstance(t, T.BooleanType)


def leaf_encodings(schema: T.StructType, encoding: str | dict[str, str]) -> dict[str, str]:
    """Encoding of every leaf by user key. One name is best effort; in a dict the longest key wins and a misfit is an error."""
    names = encoding.values() if isinstance(encoding, dict) else [encoding]
    for name in names:
        if name not in ENCODINGS:
            raise ValueError(f"unknown encoding {name!r}; choose from {', '.join(ENCODINGS)}")
    own = [(keys[-1], t) for keys, t in type_leaves(schema)]
    if isinstance(encoding, str):
        return {k: encoding if allows(encoding, t) else "plain" for k, t in own}
    found = resolve(schema, encoding)
    for k, t in own:
        if k in found and not allows(found[k], t):
            raise ValueError(f"encoding {found[k]!r} does not fit column {k!r} of type {t.simpleString()}")
    return {k: found.get(k, "plain") for k, _ in own}


def stored_paths(schema: T.StructType) -> dict[str, str]:
    """User key to Parquet path, in the layout that Spark and Arrow both write."""
    out = {}

    def walk(t: T.DataType, key: str, path: str) -> None:
        if isinstance(t, T.StructType):
            for f in t:
                walk(f.dataType, f"{key}.{f.name}" if key else f.name, f"{path}.{f.name}" if path else f.name)
        elif isinstance(t, T.ArrayType):
            walk(t.elementType, key, f"{path}.list.element")
        elif isinstance(t, T.MapType):
            walk(t.keyType, f"{key}.key", f"{path}.key_value.key")
            walk(t.valueType, f"{key}.value", f"{path}.key_value.value")
        else:
            out[key] = path

    walk(schema, "", "")
    return out


def validate(df: DataFrame, compression: str, encoding: str | dict[str, str], rowgroup_size: int | None) -> dict[str, str]:
    """Everything that can be wrong before a file exists; returns the encodings of the leaves."""
    if compression not in CODECS:
        raise ValueError(f"unknown compression {compression!r}; choose from {', '.join(CODECS)}")
    if rowgroup_size is not None and rowgroup_size < 1:
        raise ValueError("rowgroup_size must be 1 or more")
    if not df.columns:
        raise ValueError("a table without columns cannot be written")
    for (*_, k), t in type_leaves(df.schema):
        if isinstance(t, (T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)):
            raise ValueError(f"column {k!r} of type {t.simpleString()} cannot be written")
    return leaf_encodings(df.schema, encoding)


def needs_sink(df: DataFrame, compression: str, encodings: dict[str, str]) -> bool:
    special = any(e not in ("plain", "dictionary") for e in encodings.values())
    return special or CODECS[compression] is None or any({"fixed_size", "fixed_sizes", "stored"} & set(f.metadata or {}) for f in df.schema)


def write_parquet(
    df: DataFrame, path: str, compression: str = "snappy", encoding: str | dict[str, str] = "plain", rowgroup_size: int | None = None,
    single_file: bool = False, mode: str = "overwrite",
) -> str:
    """Write df and return the path: a folder of files, or with single_file one file with the rows in order.

    All fields but map keys are OPTIONAL. Row groups of rowgroup_size rows start anew in each file. Wrong options are
    errors before anything is written. A failed write leaves no new file behind, and with single_file or the Arrow sink
    what was at the path before (Spark's own writer empties a folder before it overwrites it).
    """
    encodings = validate(df, compression, encoding, rowgroup_size)
    if mode not in ("overwrite", "append", "error", "errorifexists", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = df.sparkSession
    if mode in ("error", "errorifexists", "ignore") and exists(spark, path):
        if mode == "ignore":
            return path
        raise FileExistsError(path)
    if single_file and mode == "append":
        raise ValueError("a single file cannot be appended to")
    target = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}" if single_file else path  # beside it: renaming stays in one store
    rows = nullable(df)
    if single_file:
        rows = rows.coalesce(1)
    paths = stored_paths(df.schema)
    try:
        if needs_sink(df, compression, encodings):
            schema = T.StructType([T.StructField(f.name, f.dataType, True, o.metadata) for f, o in zip(rows.schema, df.schema, strict=True)])
            options = {
                "path": target if ":" in target else f"file:{target}", "compression": "none" if compression == "uncompressed" else compression,
                "encodings": json.dumps({paths[k]: ENCODINGS[e] for k, e in encodings.items() if e != "plain"}), "rowgroup_size": str(rowgroup_size or 0),
                "spark_schema": json.dumps(schema.jsonValue()), "job": uuid.uuid4().hex,
            }
            old = data_files(spark, target) if mode == "overwrite" and exists(spark, target) else []
            rows.write.format(arrow_source(spark)).mode("append").options(**options).save()
            for file, _ in old:  # only now that the new table is there
                delete(spark, file)
        else:
            options = {"compression": CODECS[compression], "parquet.enable.dictionary": "false"}
            options |= {f"parquet.enable.dictionary#{paths[k]}": "true" for k, e in encodings.items() if e == "dictionary"}
            if rowgroup_size:
                options["parquet.block.row.count.limit"] = str(rowgroup_size)
            with confs(spark, spark__sql__parquet__outputTimestampType="TIMESTAMP_MICROS"):
                rows.write.mode("append" if mode == "append" else "overwrite").options(**options).parquet(target)
        if single_file:
            files = data_files(spark, target)
            if len(files) != 1:
                raise OSError(f"expected one file in {target}, found {len(files)}")
            delete(spark, path)
            rename(spark, files[0][0], path)
    finally:
        if single_file:
            delete(spark, target)
    return path
