"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from proseaudit.llm import store


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the edges ``a, b``; loops and repeated edges are allowed.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node next to it. The number of
    edges never grows, and rounds stop when the edges no longer change. Minima combine before the shuffle.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL").distinct()
    now = store.written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = store.written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now, before, seen = then, seen, _digest(then)
        if before == seen:
            break
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def united(n: int, rows: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """Within one group of a task: the smallest place connected with each of n places, given places and what each is linked to."""
    label = np.arange(n)
    for place, linked in rows:
        met = label[linked]
        low = min(label[place], met.min(initial=n))
        if label[place] != low or (met != low).any():
            label[np.isin(label, np.append(met, label[place]))] = low
    return label
