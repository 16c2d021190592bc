"""Keeping computed columns computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pass the columns through a one-row generator.

    A filter on a computed column is normally pushed below the projections that compute it, which
    repeats their expressions inside the filter, each as often as it is used. A filter on generator
    output stays above, so the expressions run once. No shuffle, no row is added or dropped.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[F.col(c) for c in columns])))).select(*df.columns)


def dealt_out(df: DataFrame, key: str) -> DataFrame:
    """Short rows that grow a lot later, in as many tasks as a shuffle has, however few the files' row groups are.

    The count is given, as adaptive execution would join the small partitions again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
