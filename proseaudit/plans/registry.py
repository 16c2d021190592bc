"""Named queries over the given tables, each with the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under a name."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, fn, sql)
        return fn

    return add
