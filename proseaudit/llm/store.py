"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OPEN: list[Scratch] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written within a ``with`` block; all go at its end but the one that is kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _OPEN.append(self)
        return self

    def __exit__(self, *_) -> None:
        _OPEN.remove(self)
        for path in self.paths:
            drop(self.spark, path)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """Write the result, which may then be read after the block."""
        df = written(df, name)
        self.paths.pop()
        return df


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder in local mode and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and a lost executor costs a read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with own_shuffles(spark):
        df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def own_shuffles(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query ends, as its result is all that is read again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
