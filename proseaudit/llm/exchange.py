"""Asking, for many keys of many texts, who else has them.

Documents are put into blocks of a few MB, one row each, in a table bucketed by block. A block sends its distinct keys, packed,
to the buckets that own them, and gets one bit for each key back. It derives the same keys in the same order again when the
answer comes, so neither keys nor texts travel back, and texts are never shuffled. A key that a third of all documents hold
costs one entry for each block, and buckets are by hash, so no group is larger than the number of blocks.

Every bucket is sorted on its own, and its rows are read one by one, so it may be larger than an Arrow array. The number of buckets follows from
the bytes of text (``BUCKET_BYTES``), whatever the number of shuffle partitions. A block that asked a bucket and has no reply of the right length is an error.
Keys can be asked for in rounds, each with a part of the buckets, so that the disk holds one round at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from proseaudit.llm import store, text

LAST = np.iinfo(np.int64).max
#: Bytes of text for each bucket, at most. A narrow key takes 4 bytes and a wide one about 10, and there is at most one for each byte of text.
BUCKET_BYTES = 1 << 24
BLOCK = "block bigint, ids array<bigint>, offsets binary, data binary"


def block_table(documents: DataFrame, limit: int) -> DataFrame:
    """``block``, document ids, offsets and bytes of runs of documents of about ``limit`` bytes; a null text is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, data, sizes, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def block() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([[i for part in ids for i in part]], pa.list_(pa.int64())), pa.array([offsets.tobytes()], pa.binary()), pa.array([b"".join(data)], pa.binary())],
                ["block", "ids", "offsets", "data"])

        for batch, buf, offsets in text.slices(batches, "text", limit):
            if held and held + len(buf) > limit:
                yield block()
                at, ids, data, sizes, held = at + 1, [], [], [], 0
            ids.append(batch.column(0).to_pylist())
            data.append(buf.tobytes())
            sizes.append(np.diff(offsets))
            held += len(buf)
        if ids:
            yield block()

    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCK)
    name = f"blocks_{uuid.uuid4().hex}"
    rows.write.bucketBy(partitions_of(spark), "block").option("path", store.new_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def partitions_of(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_of(blocks: DataFrame, bucket_bytes: int) -> int:
    """One bucket for each ``bucket_bytes`` of text, and one for each shuffle partition at least."""
    total = blocks.agg(F.sum(F.octet_length("data").cast("bigint"))).first()[0] or 0
    return max(partitions_of(blocks.sparkSession), -(-total // bucket_bytes))


class Block:
    """One block as arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.number = batch.column(0)[row].as_py()
        self.ids = batch.column(1)[row].as_py()
        self.order = np.array([LAST if i is None else i for i in self.ids], np.int64)  # a null id is after all others
        self.offsets = np.frombuffer(batch.column(2)[row].as_buffer(), np.int64)
        self.buf = np.frombuffer(batch.column(3)[row].as_buffer() or b"", np.uint8)


class Keys:
    """The distinct (bucket, key) pairs among a block's occurrences, with the smallest and largest document of each."""

    def __init__(self, bucket: np.ndarray, key: np.ndarray, doc: np.ndarray, buckets: int):
        small = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        order = np.argsort(key)
        order = order[np.argsort(small[order], kind="stable")]
        bucket, key, doc = small[order], key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        start = np.flatnonzero(new)
        self.which = np.empty(len(key), np.int64)  # of each occurrence
        self.which[order] = np.cumsum(new) - 1
        self.bucket, self.key = bucket[start], key[start]
        self.first = np.minimum.reduceat(doc, start) if len(start) else doc
        self.last = np.maximum.reduceat(doc, start) if len(start) else doc

    def parts(self) -> Iterator[tuple[int, slice]]:
        cuts = [*np.flatnonzero(np.diff(self.bucket, prepend=self.bucket[:1] + 1)).tolist(), len(self.bucket)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(self.bucket[a]), slice(a, b)

    def answers(self, replies: list | None) -> np.ndarray:
        """The bits of the replies in the order of the keys; an error where a bucket that has keys sent none, or sent too few or too many."""
        bits, found = np.zeros(len(self.key), bool), {r["bucket"]: r["bits"] for r in replies or ()}
        for bucket, part in self.parts():
            n = part.stop - part.start
            if len(found.get(bucket, b"")) != (n + 7) // 8:
                raise ValueError(f"bucket {bucket} was asked for {n} keys and sent {len(found[bucket]) if bucket in found else 'no'} bytes")
            bits[part] = np.unpackbits(np.frombuffer(found[bucket], np.uint8), count=n).view(bool)
        return bits


def ask(rows: DataFrame, keys_of: Callable[[Block, list | None], Keys], wide: bool, name: str) -> DataFrame:
    """Send the keys of every block to their buckets and write the answers: block, bucket, bits.

    ``rows`` are blocks, with ``replies`` to an earlier question if there was one. Narrow keys are compared by their low 32 bits, and the
    answer is whether another block has the key too. Wide keys are compared whole, and the answer is whether a smaller document has the key.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                keys = keys_of(block, batch.column(4)[i].as_py() if batch.num_columns > 4 else None)
                out: list[tuple] = []
                for bucket, part in keys.parts():
                    if wide:
                        docs, at = np.unique(keys.first[part], return_inverse=True)
                        out.append((bucket, block.number, keys.key[part].tobytes(), docs.tobytes(), at.astype(np.uint32 if len(docs) > 1 << 16 else np.uint16).tobytes()))
                    else:
                        out.append((bucket, block.number, keys.key[part].astype(np.uint32).tobytes(), None, None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])],
                    ["bucket", "block", "keys", "docs", "at"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            key = [np.frombuffer(x.as_buffer(), np.uint64 if wide else np.uint32) for x in rows.column(2)]
            n = np.array([len(k) for k in key])
            doc = np.concatenate([_docs(a, b, m) for a, b, m in zip(rows.column(3), rows.column(4), n)]) if wide else None
            key = np.concatenate(key)
            order = np.argsort(key)
            new = np.ones(len(key), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            group = np.cumsum(new) - 1
            bits = np.empty(len(key), bool)
            if wide:
                bits[order] = np.minimum.reduceat(doc[order], np.flatnonzero(new))[group] < doc[order]
            else:
                bits[order] = np.bincount(group)[group] > 1
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [rows.column(1).combine_chunks(), rows.column(0).combine_chunks(), pa.array([np.packbits(bits[b - m: b]).tobytes() for m, b in zip(n.tolist(), ends.tolist())], pa.binary())], ["block", "bucket", "bits"])

    sent = rows.mapInArrow(send, "bucket int, block bigint, keys binary, docs binary, at binary")
    return store.written(sent.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(answer, "block bigint, bucket int, bits binary"), name)


def _docs(docs: pa.Scalar, at: pa.Scalar, n: int) -> np.ndarray:
    docs, at = np.frombuffer(docs.as_buffer(), np.int64), at.as_buffer()
    return docs[np.frombuffer(at, np.uint16 if at.size == 2 * n else np.uint32)]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """All rows of one bucket after the other, of a partition that is sorted by bucket. Chunks stay apart: joined, they can pass what a binary array holds."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else []
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != bucket[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def with_replies(blocks: DataFrame, *replies: DataFrame) -> DataFrame:
    """Blocks with the replies to each question in a column of their own."""
    for i, reply in enumerate(replies):
        own = reply.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"replies{i}"))
        blocks = blocks.join(own.hint("shuffle_hash"), "block", "left")
    return blocks


def covered(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Which of n places lie in one of the spans of a size that start at the given places."""
    steps = np.zeros(n + 1, np.int32)
    steps[: len(np.bincount(at, minlength=1))] += np.bincount(at, minlength=1).astype(np.int32)[: n + 1]
    ends = np.bincount(at + size, minlength=1).astype(np.int32)
    steps[: len(ends)] -= ends
    return np.cumsum(steps[:-1]) > 0
