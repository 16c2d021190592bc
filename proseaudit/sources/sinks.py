"""Sinks. Every write is partition-parallel; nothing passes through the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the checkpoint directory that the session names; driver and executors have to share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/proseaudit/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder, so that they are computed once and stay the same."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_reports(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON line per document."""
    report.select(F.to_json(F.struct(*[F.col(c) for c in report.columns])).alias("value")).write.mode(mode).text(path)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_protection(terms: DataFrame, path: str, buckets: int = 256, writers: int = 16) -> None:
    """Cache of protected terms, in ``buckets`` folders by a hash of the document however many documents there are;
    each folder is written by up to ``writers`` tasks, so that folders do not bound the tasks."""
    (
        terms.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
        .repartition("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(writers)))
        .write.mode("append").partitionBy("bucket").parquet(path)
    )


def split_uploads(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and the quarantine."""
    return checked.where("reject_reason is null"), checked.where("reject_reason is not null")
