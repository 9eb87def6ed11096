"""Session helpers: confs that hold for one operation, the shared scratch folder, a local session for tests."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@contextlib.contextmanager
def confs(spark: SparkSession, **values: str) -> Iterator[None]:
    """Confs (dots written as __) that are restored afterwards."""
    own = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/quillnest-{uuid.uuid4().hex}"


def nullable(df: DataFrame) -> DataFrame:
    """The same rows with every field, element and map value nullable, so that they are written OPTIONAL."""
    from .plans.types import loosened

    return df.sparkSession.createDataFrame([], loosened(df.schema)).unionByName(df)


def local_session(cores: str = "4", partitions: int = 4) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("quillnest").config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
