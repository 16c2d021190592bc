"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A batch of changes inserts documents, deletes them or revises their counts. Its rows are turned into signed rows against what earlier batches say of the
same document and version, appended to a ledger, and summed into the batch's delta; totals are the sum of all deltas. A batch is a folder: it counts
once its delta is complete (its ``_SUCCESS`` file), a batch that is already complete is left as it is, and one that broke off is written anew from earlier batches alone. So batches can be sent
again at will, but in the order of their numbers.

Changes: ``key`` (names a document), ``op`` (``insert``, ``delete``, ``revise``), ``source``, ``lang``, ``version``, ``n_docs``, ``n_tokens``.

Defined cases: an insert of a known key and a revision of an unknown one set the count all the same; a delete of an unknown key does nothing, and needs no counts. Several changes of one key and
version in a batch are summed if they are inserts, and a delete among them wins. Null source, language or version is a value of its own; a null count is 0; rows without key or op are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from proseaudit.llm import store, text, tokens

CELL = ("source", "lang", "version")
LEDGER = "key bigint, source string, lang string, version string, n_docs bigint, n_tokens bigint"
DELTA = "source string, lang string, version string, n_docs bigint, n_tokens bigint"


class Rollup:
    """Totals under a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def committed(self) -> list[int]:
        """Numbers of the complete batches."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/delta")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        return sorted(int(n[6:]) for n in names if n.startswith("batch-") and self._exists(f"{self.path}/delta/{n}/_SUCCESS"))

    def _rows(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/batch-{b}" for b in batches])

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch; False if it was complete already."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        changes = changes.where("key IS NOT NULL AND op IS NOT NULL").groupBy("key", *CELL[2:]).agg(
            F.max((F.col("op") == "delete").cast("int")).alias("gone"), F.max("source").alias("source"), F.max("lang").alias("lang"),
            F.sum(F.coalesce("n_docs", F.lit(0))).alias("n_docs"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))
        known = self._rows("ledger", LEDGER, done).groupBy("key", *CELL).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 OR n_tokens != 0")
        named = changes.select(F.col("key").alias("k"), F.col("version").alias("v"))
        back = known.join(named, (F.col("key") == F.col("k")) & F.col("version").eqNullSafe(F.col("v")), "left_semi")
        back = back.select("key", *CELL, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
        signed = changes.where("gone = 0").select("key", *CELL, "n_docs", "n_tokens").unionByName(back)
        with store.own_shuffles(self.spark):
            signed.write.mode("overwrite").parquet(f"{self.path}/ledger/batch-{batch}")
            own = self._rows("ledger", LEDGER, [batch])
            own.groupBy(*CELL).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.mode("overwrite").parquet(f"{self.path}/delta/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens``, without cells that came to nothing."""
        rows = self._rows("delta", DELTA, self.committed())
        return rows.groupBy(*CELL).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 OR n_tokens != 0")


def counted(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``key`` (of id and text), ``doc_id, source, lang``, and counts of each text: bytes, words, tokens."""
    path = vocabulary or tokens.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(path)
        for batch, buf, offsets in text.slices(batches, "text"):
            counts = [np.diff(offsets), np.diff(text.Words(buf, offsets).first), np.diff(encoder.slice(buf, offsets)[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c.astype(np.int64)) for c in counts)], ["key", "doc_id", "source", "lang", "n_bytes", "n_words", "n_tokens"])

    slim = documents.select(
        F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "key bigint, doc_id bigint, source string, lang string, n_bytes bigint, n_words bigint, n_tokens bigint")


def changes(rows: DataFrame, op: str, counts: dict[str, str]) -> DataFrame:
    """The same change for every row and version; ``counts`` maps a version to an expression for its count."""
    versions = F.array(*[F.struct(F.lit(v).alias("version"), F.expr(c).cast("bigint").alias("n_tokens")) for v, c in counts.items()])
    return rows.select("key", F.lit(op).alias("op"), "source", "lang", F.lit(1).cast("bigint").alias("n_docs"), F.inline(versions))
