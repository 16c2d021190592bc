"""Keyed tables that change: hash buckets, of which a change set rewrites only those it touches.

Rows lie in folders ``data/<version>/_bucket=<b>``. A version is a small file that says which folder holds each bucket, which change set was
applied last, and the schema. It is written under another name and renamed when all its data are there, so readers see a version whole
or not at all, and a change set that died half-way left nothing but folders that no version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Snapshot:
    """A table in ``buckets`` buckets by a hash of its key columns; choose as many as make buckets of some 100 MB.

    The first change set is the table itself. Change sets are numbered; one whose number is not above the last applied is ignored, so a
    repeated batch counts once. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions ----------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(name) for name in self._names("versions") if name.isdigit()]

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/versions/{version:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, version: int, manifest: dict) -> None:
        """Make a version the current one."""
        draft = self._path(f"{self.path}/versions/_{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not self._fs.rename(draft, self._path(f"{self.path}/versions/{version:012d}")):
            raise RuntimeError(f"version {version} of {self.path} was written by someone else")

    def _current(self) -> dict:
        found = self.versions()
        return self._manifest(found[-1]) if found else {"applied": None, "folders": {}, "schema": None}

    # --- rows -----------------------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the current version, or those of some buckets only."""
        now = self._current()
        if now["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        schema = StructType.fromJson(now["schema"])
        wanted = [f for b, f in now["folders"].items() if buckets is None or int(b) in buckets]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in wanted])

    def apply(self, number: int, changes: DataFrame, merge: Merge) -> list[int]:
        """Rewrite the buckets that hold a key of the change set as ``merge(rows, changes)``; returns their numbers.

        ``merge`` sees whole buckets, and changes of their keys only. It must not make rows of other keys.
        """
        now = self._current()
        if now["applied"] is not None and number <= now["applied"]:
            return []
        touched, merged = [], changes
        if now["schema"] is not None:
            touched = sorted(r[0] for r in changes.select(self.bucket()).distinct().collect())  # as many as buckets at most
            merged = merge(self.read(touched), changes)
        folder = f"{number:012d}-{uuid.uuid4().hex}"
        merged.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        fresh = {name.split("=")[1]: f"{folder}/{name}" for name in self._names(f"data/{folder}") if name.startswith("_bucket=")}
        folders = {b: f for b, f in now["folders"].items() if int(b) not in touched} | fresh
        version = (self.versions() or [-1])[-1] + 1
        self._swap(version, {"applied": number, "folders": folders, "schema": merged.schema.jsonValue()})
        self._drop_unused()
        return touched or sorted(map(int, fresh))

    def _drop_unused(self) -> None:
        """Drop what neither the current version nor the one before it names, as readers may still hold that."""
        kept = self.versions()[-2:]
        named = {f for v in kept for f in self._manifest(v)["folders"].values()}
        for version in self.versions()[:-2]:
            self._fs.delete(self._path(f"{self.path}/versions/{version:012d}"), False)
        for folder in self._names("data"):
            parts = [name for name in self._names(f"data/{folder}") if name.startswith("_bucket=")]
            left = [name for name in parts if f"{folder}/{name}" in named]
            for name in [f"data/{folder}/{x}" for x in parts if x not in left] if left else [f"data/{folder}"]:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
