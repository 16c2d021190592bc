"""Running sums over a global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from proseaudit.llm import store


def running(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before each row in the order of the columns ``order``.

    Rows are dealt by range and summed within their partition; only one total for each partition goes through a single task.
    The order has to be total for the result to be determined. Null values count as 0.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(batch.schema.get_field_index(value)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = before + np.cumsum(n)
            before = int(sums[-1]) if len(sums) else before
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(sums - n)], [*batch.schema.names, "__part", out])

    spark = df.sparkSession
    schema = spark.createDataFrame([], df.schema).withColumns({"__part": F.lit(0), out: F.lit(0).cast("bigint")}).schema
    rows = store.written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(local, schema), "running")
    totals = rows.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    return rows.join(base, "__part").withColumn(out, F.col(out) + F.col("__base")).drop("__part", "__base")
