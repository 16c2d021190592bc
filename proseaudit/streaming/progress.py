"""Progress, job status and log streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import visual
from proseaudit.sources import snapshots


def stage_percent(stage: Column) -> Column:
    return visual.lookup(stage, lx.STAGE_PERCENT)


def with_progress(events: DataFrame) -> DataFrame:
    """Adds the percentage of the stage."""
    return events.withColumn("progress", stage_percent(F.col("stage")))


def partial_state(events: DataFrame, batch_id: int = 0) -> DataFrame:
    """Newest event and number of events per file of one batch."""
    newest = F.max(F.struct("ts", "progress", "stage", "message"))
    return events.groupBy("file_id").agg(newest.alias("s"), F.count(F.lit(1)).alias("n_events"))


def _merged(partial: DataFrame) -> DataFrame:
    return partial.groupBy("file_id").agg(F.max("s").alias("s"), F.sum("n_events").alias("n_events"))


def merged_state(partial: DataFrame) -> DataFrame:
    """Latest stage per file. Later time wins, then higher progress, so a late duplicate cannot undo a completed job,
    and the order of batches does not matter."""
    return _merged(partial).select(
        "file_id", F.col("s.ts").alias("ts"), F.col("s.stage").alias("stage"), F.col("s.progress").alias("progress"),
        F.col("s.message").alias("message"), "n_events",
    )


def fold_state(table: snapshots.Snapshot) -> Callable[[DataFrame, int], None]:
    """A batch sink that keeps one row per file: a batch reads and rewrites the buckets of its own files, so what is kept and read
    follows the number of files, not of batches. A batch that is sent again counts once."""
    def fold(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch_id, partial_state(batch), lambda old, new: _merged(old.unionByName(new)))

    return fold


def until_completed(events: DataFrame, order: str = "event_id") -> DataFrame:
    """What a subscriber of a file gets: its events up to the first that completes it, that one included; ties in time go by ``order``."""
    end = F.min(F.when(F.col("stage") == "completed", F.struct("ts", order))).alias("_end")
    ends = events.groupBy("file_id").agg(end).where("_end IS NOT NULL")
    return events.join(ends, "file_id", "left").where(F.col("_end").isNull() | (F.struct("ts", order) <= F.col("_end"))).drop("_end")


def latest_state(events: DataFrame) -> DataFrame:
    """Latest stage per file of a table of events."""
    return merged_state(partial_state(events))


def job_status(events: DataFrame) -> DataFrame:
    """processing / completed / error with first and last time per file."""
    newest = F.max(F.struct("ts", "progress", "stage"))["stage"]
    return events.groupBy("file_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), newest.alias("_stage")).select(
        "file_id",
        F.when(F.col("_stage") == "completed", "completed").when(F.col("_stage") == "error", "error").otherwise("processing").alias("status"),
        "started_at", "updated_at",
    )


def once_per_file(out: str) -> Callable[[DataFrame, int], DataFrame]:
    """One result per file, however late or often its events come: a batch adds the files that earlier batches under ``out`` do not have.

    Every batch reads all earlier ones, so this is for streams of few batches; ``OncePerFile`` looks up only files that may have come before.
    """
    def new_files(batch: DataFrame, batch_id: int) -> DataFrame:
        rows = batch.dropDuplicates(["file_id"])
        if not batch_id:
            return rows
        return rows.join(batch.sparkSession.read.schema(rows.schema).parquet(*[f"{out}/batch={i}" for i in range(batch_id)]), "file_id", "left_anti")

    return new_files


class OncePerFile:
    """One result per file, however late or often its events come.

    Rows go to ``out/batch=<i>/bucket=<b>`` by a hash of the file. A bit map for each bucket, of ``BITS`` bits and so of one size for ever, tells
    which files are surely new; only the others are looked up, among the files of their own buckets. ``checked`` has the buckets that were looked up, by batch.
    """

    BITS = 32_768  # what one bitmap of Spark's bitmap functions holds

    def __init__(self, spark: SparkSession, out: str, filters: str, buckets: int = 256):
        self.out, self.buckets, self.checked = out, buckets, {}
        self.filters = snapshots.Snapshot(spark, filters, ["bucket"], 1)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({
            "bucket": F.pmod(F.xxhash64("file_id"), F.lit(self.buckets)).cast("int"),
            "_at": F.pmod(F.xxhash64("file_id", F.lit("bit")), F.lit(self.BITS)).cast("int")})

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = self._placed(batch.dropDuplicates(["file_id"]))
        if batch_id:
            byte = F.expr("cast(conv(hex(substring(bits, _at div 8 + 1, 1)), 16, 10) AS bigint)")
            known = F.coalesce(F.bit_get(byte, F.pmod("_at", F.lit(8))) == 1, F.lit(False))
            rows = rows.join(F.broadcast(self.filters.read()), "bucket", "left").withColumn("_known", known).drop("bits")  # at most ``buckets`` rows of 4 KB
            look = self.checked[batch_id] = sorted(r[0] for r in rows.where("_known").select("bucket").distinct().collect())
            if look:
                before = spark.read.option("basePath", self.out).schema("file_id " + batch.schema["file_id"].dataType.simpleString() + ", batch int, bucket int").parquet(self.out)
                before = before.where((F.col("batch") < batch_id) & F.col("bucket").isin(look)).select("file_id", F.lit(True).alias("_done"))
                rows = rows.join(before.distinct(), "file_id", "left").where(~F.col("_known") | F.col("_done").isNull()).drop("_done")
            rows = rows.drop("_known")
        path = f"{self.out}/batch={batch_id}"
        rows.drop("_at").write.mode("overwrite").partitionBy("bucket").parquet(path)
        new = self._placed(batch.select("file_id").distinct()).groupBy("bucket").agg(F.bitmap_construct_agg("_at").alias("bits"))
        self.filters.apply(batch_id, new, lambda old, more: old.unionByName(more).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")))


LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def visible_logs(logs: DataFrame, minimum: str = "INFO", muted: str = "uvicorn.access") -> DataFrame:
    rank = F.coalesce(visual.lookup(F.col("level"), LEVELS), F.lit(0))
    return logs.where(~F.col("component").startswith(muted) & (rank >= LEVELS[minimum]))


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """One micro-batch frame to several sinks. Nothing is dropped: a slow sink delays the batch.

    The frame is kept while the sinks read it, so the source is read once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, batch_id)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
