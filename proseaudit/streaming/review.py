"""Continuous review of arriving documents: the batch projection on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proseaudit.plans import review


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """File stream with the schema of the files already there.

    A stream wants a directory or a pattern; the pattern made here fits the path itself, be it one
    file or a directory of part files.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(pattern)


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run an append stream over everything there is now and stop."""
    (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )


def drain_batches(stream: DataFrame, make: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str) -> None:
    """Run a stream; what ``make`` gives for a batch replaces the folder of that batch, so a repeated batch leaves one copy."""
    def write(batch: DataFrame, batch_id: int) -> None:
        make(batch, batch_id).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_into(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream into a sink that takes batches and their numbers, and stop."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def review_stream(documents: DataFrame, text: str = "text") -> DataFrame:
    """Issues of arriving documents; stateless, so it needs no watermark."""
    return review.document_issues(documents, text)
