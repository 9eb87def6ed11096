"""Bytes of files through Hadoop's file systems, so that every store Spark reads can be introspected."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(URI, length) of the file at path, or of the data files in and below the folder, by name."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    out, walk = [], fs.listFiles(p, True)
    root = p.depth() if fs.getFileStatus(p).isDirectory() else None
    while walk.hasNext():
        s = walk.next()
        names = s.getPath().toString().split("/")
        below = names[-(s.getPath().depth() - root) :] if root is not None else []
        if not any(n.startswith(("_", ".")) for n in below):
            out.append((s.getPath().toString(), s.getLen()))
    return sorted(out)


def read_range(spark: SparkSession, path: str, start: int, length: int) -> bytes:
    fs, p = _fs(spark, path)
    f = fs.open(p)
    try:
        f.seek(start)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f, length))
    finally:
        f.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot rename {old} to {new}")
