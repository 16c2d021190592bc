"""Near-duplicate vectors: small-world graphs per shard, every shard queried, links verified, components united.

Vectors are compared within a label. Equal vectors are one node with a size. A label's nodes are dealt by hash to shards of about ``shard`` nodes, and each shard
gets a graph. For every pair of a label's shards one task queries the graph of one with the nodes of the other. A query whose beam holds links only is
repeated with a wider beam. Beams are audited in every pair of shards, whether it holds links or not: ``plants`` rows of the graph's side are turned by a
random direction to cosines from the threshold to 0.04 above, and the search must lead back to the rows they came from; and ``audit`` queries are compared with the whole shard.
Beams are doubled until both audits find ``recall``; only a beam as wide as the shard is a plain comparison. Similarities within 1e-4 of the threshold are settled in double precision. A task returns link counts and a star for each of its components, never pairs.

Defined cases: a vector that is null, empty or zero, or holds a null or a number that is not finite, and one with a null label or id, links with nothing and is
kept. Vectors of different lengths are never compared. Rows with the same id are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from proseaudit.llm import components, store, text
from proseaudit.llm.jaccard_join import _groups
from proseaudit.llm.small_world import Graph

NODES = "vec_id bigint, label string, size int, node bigint, vector binary"


def vectors(embeddings: DataFrame) -> DataFrame:
    """The rows that can link: id, label, length, node (hash of label and numbers), and the numbers scaled to length 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            lists = batch.column(2)
            for i in range(batch.num_rows):
                if ids[i] is None or labels[i] is None or not lists[i].is_valid or not len(lists[i]) or lists[i].values.null_count:
                    continue
                v = lists[i].values.to_numpy(zero_copy_only=False).astype(float) + 0.0
                if not np.isfinite(v).all() or not v.any():
                    continue
                v = v / np.abs(v).max()
                v /= np.sqrt((v * v).sum())
                data = np.frombuffer(f"{labels[i]}\0".encode() + v.tobytes(), np.uint8)
                out.append((ids[i], labels[i], len(v), int(text.spans(text.byte_sums(data), np.array([0]), np.array([len(data)])).view(np.int64)[0]), v.tobytes()))
            if out:
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["vec_id", "label", "size", "node", "vector"])

    slim = embeddings.select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return slim.mapInArrow(run, NODES)


def links(nodes: DataFrame, threshold: float, shard: int, beam: int, recall: float) -> DataFrame:
    """For each linked node: how many vectors it is linked to in a pair of shards, and the pair's star."""
    groups = nodes.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    placed = nodes.join(groups, ["label", "size"]).withColumn("shard", F.pmod("node", "shards").cast("int")).withColumn("kind", F.xxhash64("label", "size"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            x = np.frombuffer(b"".join(rows.column(5).to_pylist())).reshape(rows.num_rows, -1)
            graph = Graph(x)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0)[:1], rows.column(1)[:1], rows.column(2)[:1], *(pa.array([b], pa.binary()) for b in (rows.column(3).to_numpy().tobytes(), rows.column(4).to_numpy().tobytes(), x.tobytes(), graph.dump()))],
                ["kind", "shard", "shards", "nodes", "copies", "x", "graph"])

    dealt = placed.select("kind", "shard", "shards", "node", "copies", "vector").repartition("kind", "shard").sortWithinPartitions("kind", "shard", "node")
    graphs = store.written(dealt.mapInArrow(build, "kind bigint, shard int, shards int, nodes binary, copies binary, x binary, graph binary"), "graphs")
    each = graphs.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
    pairs = each.select("kind", F.least("shard", "other").alias("a"), F.greatest("shard", "other").alias("b"), "nodes", "copies", "x", "graph", "shard")

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            sides = []
            for i in (0, rows.num_rows - 1):
                ids, size = (np.frombuffer(rows.column(c)[i].as_buffer(), np.int64) for c in (3, 4))
                sides.append((ids, size, np.frombuffer(rows.column(5)[i].as_buffer()).reshape(len(ids), -1)))
            (ids, size, x), (ids2, size2, y) = sides
            own = rows.num_rows == 1
            linked = found(Graph.load(y, rows.column(6)[rows.num_rows - 1].as_py()), x, y, threshold, beam, recall, own)
            if own:
                linked |= linked.T
                np.fill_diagonal(linked, False)
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            if own:
                name, n, left, right = ids, linked @ size, i, j
            else:
                name, n = np.concatenate([ids, ids2]), np.concatenate([linked @ size2, linked.T @ size])
                left, right = i, j + len(ids)
            root = roots(len(name), left, right)
            on = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(name[on]), pa.array(n[on].astype(np.int64)), pa.array(name[root[on]])], ["node", "links", "root"])

    pairs = pairs.repartition("kind", "a", "b").sortWithinPartitions("kind", "a", "b", "shard").select("kind", "a", "b", "nodes", "copies", "x", "graph")
    return store.written(pairs.mapInArrow(query, "node bigint, links bigint, root bigint"), "vector-links")


def found(graph: Graph, x: np.ndarray, y: np.ndarray, threshold: float, beam: int, recall: float, own: bool = False, audit: int = 128, plants: int = 256) -> np.ndarray:
    """Which rows of x and y are linked, as far as the graph of y finds them; ``own``: x is y, and a row's link to itself is none."""
    rng = np.random.default_rng(len(x))
    sample = rng.permutation(len(x))[:audit]
    truth = exact(x[sample], y, threshold)
    if own:
        truth[np.arange(len(sample)), sample] = False
    origin = rng.permutation(len(y))[:plants]
    planted = plant(y[origin], threshold, rng)
    while True:
        back = searched(graph, planted, y, threshold, beam)[np.arange(len(origin)), origin]
        hits = searched(graph, x[sample], y, threshold, beam) & truth
        if (back.mean() >= recall and hits.sum() >= recall * truth.sum()) or beam >= len(y):
            break
        beam *= 2
    linked = searched(graph, x, y, threshold, beam)
    linked[sample] |= truth
    return linked


def plant(y: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """For each row a vector of length 1 whose cosine with it lies between the threshold and 0.04 above, in a random direction."""
    if y.shape[1] == 1:  # there is no other direction
        return y
    cosine = rng.uniform(min(threshold + 1e-6, 1), min(threshold + 0.04, 1), (len(y), 1))
    away = rng.normal(size=y.shape)
    away -= (away * y).sum(1, keepdims=True) * y
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    return cosine * y + np.sqrt(1 - cosine * cosine) * away


def searched(graph: Graph, x: np.ndarray, y: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Links that the graph of y finds for x. A query whose beam holds links only is repeated with a wider one; a beam of all of y is a plain comparison."""
    linked = np.zeros((len(x), len(y)), bool)
    todo, width = np.arange(len(x)), beam
    while len(todo):
        if width >= len(y):
            for lo in range(0, len(todo), 512):
                linked[todo[lo: lo + 512]] |= exact(x[todo[lo: lo + 512]], y, threshold)
            break
        ids, sims = graph.search(x[todo], width)
        row, col = np.nonzero((sims >= threshold - 1e-4) & (ids >= 0))
        i, j = todo[row], ids[row, col]
        sure = sims[row, col] > threshold + 1e-4
        sure[~sure] = np.einsum("nd,nd->n", x[i[~sure]], y[j[~sure]]) >= threshold
        linked[i[sure], j[sure]] = True
        todo, width = todo[sims[:, -1] >= threshold - 1e-4], 4 * width
    return linked


def exact(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    return x @ y.T >= threshold


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is connected with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[left], root[right])
        np.minimum.at(root, left, least)
        np.minimum.at(root, right, least)
        root = root[root]
        if (root == before).all():
            return root


def dedup(embeddings: DataFrame, threshold: float = 0.93, shard: int = 4096, beam: int = 64, recall: float = 0.98) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id`` (smallest id reachable) and ``kept``."""
    with store.Scratch(embeddings.sparkSession) as scratch:
        rows = store.written(vectors(embeddings), "vectors")
        nodes = store.written(rows.groupBy("node").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("label").alias("label"), F.min("size").alias("size"), F.min("vector").alias("vector")), "nodes")
        near = links(nodes, threshold, shard, beam, recall)
        whole = components.connected(near.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", "component")
        counts = near.groupBy("node").agg(F.sum("links").alias("links"))
        joined = store.written(nodes.select("node", "first", "copies").join(counts, "node", "left").join(whole, "node", "left").withColumn("component", F.coalesce("component", "node")), "linked-nodes")
        least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
        verdict = joined.join(least, "component").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
        linked = rows.select("vec_id", "node").join(verdict, "node").select("vec_id", "n_links", "component_id")
        ids = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("all"))
        used = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("some"))
        rest = ids.join(used, "vec_id", "left").select("vec_id", F.explode(F.array_repeat(F.lit(0), (F.col("all") - F.coalesce("some", F.lit(0))).cast("int"))).alias("zero"))
        rest = rest.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
        return scratch.kept(linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "linked-vectors")
