"""Near-duplicate documents: a chosen-path join on five-word shingles with Jaccard similarity of 0.8 or more.

1. Each text becomes the set of hashes of its five-word windows and a min-hash vector of ``width`` places. Texts with the same
   set are one from here on.
2. Chosen path: a bucket is a path of (place, value) choices that depends on the path alone; a set goes to the children of the
   places drawn there, one or two of them with mean 1/threshold, whose value it has. Sets at the threshold so share one child
   on average. Buckets of up to ``limit`` sets (1 MB of vectors) are compared by brute force on the vectors; larger ones are split again, and
   what is still larger after ``depth`` steps, being alike throughout, is compared in blocks. No pair becomes a row:
   a bucket gives a star of links for each of its components.
3. Batches of runs with new draws are repeated until a batch adds less than 1 - ``recall`` of the links that join candidate components and
   an audit finds ``recall`` of its links inside components: sampled sets, at most ``audited`` of together at most ``AUDIT`` shingles, are
   compared exactly with all texts once, and their links are what has to be found. Runs that bring nothing new end the search, too, with a
   warning if the audit is not met. Buckets that lie in one known component are skipped.
4. Within each candidate component all pairs are compared exactly, on the shingle sets, in pairs of blocks of bounded size.
   So link counts are complete within a component, and no link rests on an estimate.

Defined cases: a text of one to four words has one shingle, all its words; a text without words (or null) links with nothing.
Rows of equal id and text are equal copies. A null id is never the class id unless all ids of the class are null.
"""

from __future__ import annotations

import itertools
import logging
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from proseaudit.llm import components, store, text

SHINGLE = 5
#: Shingles of all audited sets together, at most; sets that would pass it are left out of the sample.
AUDIT = 1 << 17
log = logging.getLogger(__name__)


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of five words, in row order, and the offset of each row's first."""
    words = text.Words(buf, offsets)
    keys, _, row = words.windows(SHINGLE)
    n = np.diff(words.first)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        whole = text.spans(text.prefix(words.hash), words.first[:-1][few], words.first[1:][few])
        order = np.argsort(np.concatenate([row, few]), kind="stable")
        keys, row = np.concatenate([keys, whole])[order], np.concatenate([row, few])[order]
    return keys, np.searchsorted(row, np.arange(len(offsets)))


def identity(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that identify a set of shingles."""
    return int(text.mix(found).sum(dtype=np.uint64)), int(text.mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _id(a: int, b: int) -> int:
    return _long((a * 0x9E3779B97F4A7C15 + b) & ((1 << 64) - 1))


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, row key, set id, number of shingles and min-hash vector of every text with a word."""
    odd = text.mix(np.arange(1, width + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in text.slices(batches, "text"):
            keys, first = shingles(buf, offsets)
            rows = np.flatnonzero(np.diff(first))
            if not len(rows):
                continue
            at = first[:-1][rows]
            least = np.empty((len(rows), width), np.uint32)
            for i in range(width):
                least[:, i] = np.minimum.reduceat((keys * odd[i]) >> np.uint64(32), at)
            sets, n = [], []
            for r in rows:
                own = np.unique(keys[first[r]: first[r + 1]])
                sets.append(_id(*identity(own)))
                n.append(len(own))
            which = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(which), batch.column(1).take(which), pa.array(sets, pa.int64()), pa.array(n, pa.int32()), pa.array([r.tobytes() for r in least], pa.binary())],
                ["doc_id", "key", "set", "n", "least"])

    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, key bigint, set bigint, n int, least binary")


def row_key():
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))


def _children(path: np.ndarray, least: np.ndarray, more: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of each set in a bucket: one drawn place, and a second one with probability ``more``; the draw is the bucket's."""
    rows, out = [], []
    for turn in range(2):
        draw = text.mix(path + np.uint64(0x632BE59BD9B4E019) * np.uint64(turn + 1))
        on = np.arange(len(path)) if turn == 0 else np.flatnonzero((draw >> np.uint64(40)) < np.uint64(more * (1 << 24)))
        place = (draw[on] % np.uint64(least.shape[1])).astype(np.int64)
        rows.append(on)
        out.append(text.mix(draw[on] ^ text.mix(least[on, place].astype(np.uint64) + np.uint64(turn + 1))))
    return np.concatenate(rows), np.concatenate(out)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _buckets(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """(path, set) rows with the size of their bucket; buckets of one set, or of one known component, are dropped."""
    if known is not None:
        rows = rows.join(known.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    else:
        rows = rows.withColumn("component", F.col("set"))
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("path", "size")
    return rows.select("path", "set").join(sizes, "path")


def candidate_edges(sets: DataFrame, known: DataFrame | None, runs: range, width: int, threshold: float, slack: float, limit: int, depth: int) -> DataFrame:
    """Stars of links between sets whose vectors agree in ``threshold - slack`` of the places, found by the given runs."""
    more, wanted = 1 / threshold - 1, int(np.ceil((threshold - slack) * width))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, ids = _matrix(batch.column(1), width), batch.column(0).to_numpy()
            for run in runs:
                row, path = _children(text.mix(np.full(len(ids), run + 1, np.uint64) << np.uint64(32)), least, more)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[row])], ["path", "set"])

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, ids = _matrix(batch.column(2), width), batch.column(1).to_numpy()
            row, path = _children(batch.column(0).to_numpy().view(np.uint64), least, more)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[row])], ["path", "set"])

    vectors = sets.select("set", "least")
    level = store.written(_buckets(vectors.mapInArrow(start, "path bigint, set bigint"), known), "paths")
    groups = level.where(F.col("size") <= limit).select("path", F.lit(0).alias("a"), F.lit(0).alias("b"), "set")
    for step in range(depth):
        large = level.where(F.col("size") > limit)
        if large.isEmpty():
            break
        if step + 1 == depth:  # alike throughout: all pairs of blocks
            n = F.ceil(F.col("size") / limit).cast("int")
            block = F.pmod(F.xxhash64("set", "path"), n).cast("int")
            pairs = large.select("path", "set", block.alias("block"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
            groups = groups.union(pairs.select("path", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "set"))
            break
        level = store.written(_buckets(large.join(vectors, "set").select("path", "set", "least").mapInArrow(deeper, "path bigint, set bigint"), known), "paths")
        groups = groups.union(level.where(F.col("size") <= limit).select("path", F.lit(0).alias("a"), F.lit(0).alias("b"), "set"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            ids, least = rows.column(3).to_numpy(), _matrix(rows.column(4), width)

            def alike() -> Iterator[tuple[int, np.ndarray]]:
                for at in range(0, len(ids), 64):
                    same = (least[at: at + 64, None, :] == least[None, :, :]).sum(2, dtype=np.uint8) >= wanted
                    yield from ((at + i, np.flatnonzero(row)) for i, row in enumerate(same))

            roots = components.united(len(ids), alike())
            own = np.flatnonzero(roots != np.arange(len(ids)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[roots[own]])], ["a", "b"])

    placed = groups.join(vectors, "set").select("path", "a", "b", "set", "least").repartition("path", "a", "b").sortWithinPartitions("path", "a", "b", "set")
    return placed.mapInArrow(compare, "a bigint, b bigint")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in the first ``keys`` integer columns, of a partition that is sorted by them; holds one run."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(values[:, a].tolist())
            if held and key != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def exact_links(documents: DataFrame, sets: DataFrame, known: DataFrame, threshold: float, weight: int = 1 << 18, most: int = 512) -> DataFrame:
    """For each set with a candidate partner: links to other sets (counted by documents) and a star edge per pair of blocks."""
    inside = store.written(known.select(F.col("node").alias("set"), "component").join(sets.select("set", "key", "n", "size"), "set"), "candidates")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in text.slices(batches, "text"):
            keys, first = shingles(buf, offsets)
            found = [np.unique(keys[first[i]: first[i + 1]]).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["key", "shingles"])

    texts = documents.select(row_key().alias("key"), F.col("text").cast("string").alias("text")).join(inside.select("key"), "key", "left_semi")
    found = store.written(texts.mapInArrow(collect, "key bigint, shingles binary"), "shingles")
    blocks = inside.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / weight), F.ceil(F.count(F.lit(1)) / most)).cast("int").alias("blocks"))
    rows = inside.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    rows = rows.select("component", "set", "key", "size", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("component", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "set", "key", "size", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            ids, at = np.unique(group.column(3).to_numpy(), return_index=True)
            size, block, data = group.column(4).to_numpy()[at], group.column(5).to_numpy()[at], group.column(6).take(pa.array(at))
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in data]
            linked = similar(own, threshold)
            if len(ids) > 1 and block.min() != block.max():  # pairs within a block are the business of the block with itself
                linked &= block[:, None] != block[None, :]
            np.fill_diagonal(linked, False)
            roots = components.united(len(ids), ((i, np.flatnonzero(linked[i])) for i in np.flatnonzero(linked.any(1)).tolist()))
            on = np.flatnonzero(linked.any(1))
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array((linked @ size)[on].astype(np.int64)), pa.array(ids[roots[on]])], ["set", "links", "root"])

    placed = rows.join(found, "key").select("component", "a", "b", "set", "size", "block", "shingles").repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "set")
    return placed.mapInArrow(compare, "set bigint, links bigint, root bigint")


def true_links(documents: DataFrame, sets: DataFrame, threshold: float, audited: int) -> DataFrame:
    """A stated sample of sets against all texts: one row per ``set`` that reaches the similarity with a sampled one, with those (``near``)."""
    chosen, keys, room = [], [], AUDIT
    for row in sets.select("set", "key", "n").orderBy(F.xxhash64("set"), "set").limit(audited).collect():
        if row.n <= room:
            room -= row.n
            chosen.append(row.set)
            keys.append(row.key)
    texts = documents.select(row_key().alias("key"), F.col("text").cast("string").alias("text"))
    rows = texts.where(F.col("key").isin(keys)).dropDuplicates(["key"]).select("text").toArrow()
    own = {}
    for _, buf, offsets in text.slices(rows.to_batches(), "text"):
        found, first = shingles(buf, offsets)
        for i in range(len(offsets) - 1):
            mine = np.unique(found[first[i]: first[i + 1]])
            own[_id(*identity(mine))] = mine
    ids = np.array(sorted(own), np.int64)
    sizes = np.array([len(own[i]) for i in ids.tolist()], np.int64)
    posted = np.concatenate([own[i] for i in ids.tolist()]) if len(ids) else np.empty(0, np.uint64)
    order = np.argsort(posted, kind="stable")
    values, begin, count = (x.astype(kind) for x, kind in zip(np.unique(posted[order], return_index=True, return_counts=True), (np.uint64, np.int32, np.int32)))
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(1 << 20, bool)
        head[values >> np.uint64(44)] = True
        for batch, buf, offsets in text.slices(batches, "text"):
            keys, first = shingles(buf, offsets)
            on = np.flatnonzero(head[keys >> np.uint64(44)])
            at = np.searchsorted(values, keys[on])
            same = values[np.minimum(at, len(values) - 1)] == keys[on] if len(values) else np.zeros(0, bool)
            hits = np.unique(np.searchsorted(first, on[same], side="right") - 1)
            out, near = [], []
            for r in hits.tolist():
                mine = np.unique(keys[first[r]: first[r + 1]])
                at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
                at = at[values[at] == mine]
                n = count[at]
                place = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                common = np.bincount(owner[place], minlength=len(ids))
                linked = ids[common * (1 + threshold) >= threshold * (len(mine) + sizes) - 1e-3]
                me = _id(*identity(mine))
                if (linked != me).any():
                    out.append(me)
                    near.append(linked[linked != me].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(near, pa.list_(pa.int64()))], ["set", "near"])

    return texts.select("text").mapInArrow(run, "set bigint, near array<bigint>").dropDuplicates(["set"])


def measured(truth: DataFrame, known: DataFrame, chosen: DataFrame) -> tuple[int, int]:
    """(audited links, those of them whose two sets are in one component)."""
    named = known.select(F.col("node").alias("set"), "component")
    seeds = named.join(F.broadcast(chosen), "set", "left_semi").select(F.col("set").alias("seed"), F.col("component").alias("of"))  # as many as are audited
    rows = truth.join(named, "set", "left").select("component", F.explode("near").alias("seed")).join(F.broadcast(seeds), "seed", "left")
    return rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("component") == F.col("of"), 1))).first()


def similar(sets: list[np.ndarray], threshold: float, width: int = 8192) -> np.ndarray:
    """Which pairs of sets reach the Jaccard similarity."""
    n = np.array([len(s) for s in sets])
    keys, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = count[which] > 1
    column, row = (np.cumsum(count > 1) - 1)[which[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), min(width, last - at)), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    return common * (1 + threshold) >= threshold * (n[:, None] + n[None, :]) - 1e-3


def classes(
    documents: DataFrame, threshold: float = 0.8, recall: float = 0.999, width: int = 64, slack: float = 0.22, runs: int = 6, limit: int = 4096,
    depth: int = 5, audited: int = 512,
) -> DataFrame:
    """One row per document: ``doc_id, key`` (of id and text), ``component`` (the class: a set id, or the key of a row without words),
    ``class_id`` (smallest id of the class, which other classes can share where ids are null or repeated) and ``n_links``."""
    with store.Scratch(documents.sparkSession) as scratch:
        signed = store.written(signatures(documents, width), "signatures")
        sets = store.written(signed.groupBy("set").agg(F.min("key").alias("key"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"), F.max("n").alias("n"), F.max("least").alias("least")), "sets")
        truth = store.written(true_links(documents, sets, threshold, audited), "audited-links")
        seeds = truth.select(F.explode("near").alias("set")).distinct()
        edges, known, merged = None, None, 0
        for batch in itertools.count():
            new = candidate_edges(sets, known, range(batch * runs, batch * runs + runs), width, threshold, slack, limit, depth)
            edges = store.written(new if edges is None else edges.union(new), "candidate-edges")
            known = store.written(components.connected(edges), "candidate-components")
            before, merged = merged, known.where("node != component").count()
            links, met = measured(truth, known, seeds)
            log.info("batch %d: %d of %d audited links found", batch, met, links)
            if batch and merged - before <= (1 - recall) * merged and (met >= recall * links or merged == before):
                if met < recall * links:
                    warnings.warn(f"only {met} of {links} audited links were found", stacklevel=2)
                break
        links = store.written(exact_links(documents, sets, known, threshold), "links")
        whole = components.connected(links.select(F.col("set").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("set"), "component")
        near = links.groupBy("set").agg(F.sum("links").alias("links"))
        sets = sets.select("set", "first", "size").join(near, "set", "left").join(whole, "set", "left").withColumn("component", F.coalesce("component", "set"))
        sets = store.written(sets, "linked-sets")
        class_id = sets.groupBy("component").agg(F.min("first").alias("class_id"))
        verdict = sets.join(class_id, "component").select("set", "component", "class_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        found = signed.select("doc_id", "key", "set").join(verdict, "set").select("doc_id", "key", "component", "class_id", "n_links")
        rest = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
        rest = rest.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        return scratch.kept(found.unionByName(rest.select("doc_id", "key", F.col("key").alias("component"), F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))), "classes")


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One document of each class stays: of those with its smallest id (a null id if it has no other) the one with the smallest key.
    Rows alike in id and text are one document and stay together. Other columns pass through, whatever their names."""
    first = classes(documents, **options).where("doc_id <=> class_id").groupBy("component").agg(F.min("key").alias("__key"))
    rows = documents.select(F.struct("*").alias("row"), row_key().alias("__key")).join(first.select("__key"), "__key", "left_semi")
    return rows.select("row.*")
