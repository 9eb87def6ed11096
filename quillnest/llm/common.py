"""What several operators share: scratch tables, size-checked row selection, tokenizing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillnest.session import confs, scratch_path

#: Byte tables: A-Z to lower case; the same and all ASCII but letters and digits to a space.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)

#: Rows up to which a set of ids may be broadcast (16 bytes each, so at most 8 MB); more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


class Scratch:
    """Tables written under spark.checkpoint.dir, the folder that driver and executors share.

    Writing a table cuts lineage: a lost executor costs only the tasks after it. ``drop`` removes tables
    that are no longer read; the ones behind a returned DataFrame stay until the application's folder goes.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = scratch_path(spark)

    def path(self) -> str:
        return f"{self.base}/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        # Python workers get small batches: long texts are then a few MB at a time on either side.
        with confs(self.spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
            df.write.parquet(path := self.path())
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet (names are compared as Spark does, without case)."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def select_ids(df: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Rows of df whose key is (left_semi) or is not (left_anti) in ids, a table of distinct keys.

    Up to BROADCAST_IDS ids are broadcast, so that texts stay where they are; more go by shuffle.
    Null keys count as equal to null.
    """
    (name,) = fresh(df, "_id")
    ids = ids.select(quoted(key).alias(name)).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, quoted(key).eqNullSafe(quoted(name)), how)


def hash_share(df: DataFrame, most: int, key: str = "id") -> DataFrame:
    """All rows, or where there are more than ``most`` about so many, chosen by a hash of the key: no sort, and no task
    sends more than its share."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(quoted(key)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def release() -> None:
    """Give freed memory back to the system: idle Python workers live on beside the tasks of later stages."""
    import contextlib
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over batches, and its memory released when it has ended."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        release()

    return run


def tidied(f: Callable) -> Callable:
    """f of one group, and memory released after it."""

    def run(pdf):
        out = f(pdf)
        release()
        return out

    return run


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to 64-bit hash, filled as words come; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))
