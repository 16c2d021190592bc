"""Removing repeated strings of ``size`` bytes, by blockwise suffix sorting over a difference cover.

A difference cover is a set of residues such that any two positions, moved on by some common distance below the period, both fall on it. So if a
string of 50 bytes stands in two places, some of its 30-byte pieces is a cover sample in both, whatever the two positions are.

1. The cover samples of all texts are sorted by bucket and named, which here means: known to stand in another document or not.
2. Suffixes are sorted one group of buckets at a time, to bound disk and memory. Only suffixes with a shared cover sample within the period take part. Their
   buckets are by the first and last eight of their ``size`` leading bytes, and ties in a bucket are resolved by a hash of all of them: order beyond ``size`` bytes
   cannot matter for repeats of that length, so the samples' names settle which suffixes can tie, and no deeper ranks are kept.
3. A byte is removed if a suffix whose leading bytes also start in a smaller document covers it.

Defined cases: a null text is empty. Matches never cross documents. Rows with the same id never remove each other's bytes. A null id counts as larger than all others.
What is kept is bytes, as a cut can fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from proseaudit.llm import exchange, store, text

#: A difference cover of period 21: every residue is a difference of two of these.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)


class View:
    """The bytes of a block."""

    def __init__(self, block: exchange.Block):
        self.buf, self.offsets = block.buf, block.offsets
        self.sums = text.byte_sums(self.buf)
        n = np.diff(self.offsets)
        self.order, self.begin, self.end = block.order, np.repeat(self.offsets[:-1].astype(np.int32), n), np.repeat(self.offsets[1:].astype(np.int32), n)
        self.number = np.repeat(np.arange(len(n), dtype=np.int32), n)


def samples(view: View, size: int, buckets: int) -> tuple[exchange.Keys, np.ndarray]:
    """Keys of the cover samples, and where they start."""
    piece = size - PERIOD + 1
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    place = np.arange(len(view.buf), dtype=np.int32)
    at = np.flatnonzero(on[(place - view.begin) % PERIOD] & (place + piece <= view.end))
    key = text.spans(view.sums, at, at + piece)
    return exchange.Keys((key >> np.uint64(32)) % np.uint64(buckets), key & np.uint64(0xFFFFFFFF), view.order[view.number[at]], buckets), at


def near_samples(view: View, size: int, buckets: int, replies: list | None) -> np.ndarray:
    """Which suffixes have a shared cover sample within the period."""
    keys, at = samples(view, size, buckets)
    shared = (keys.answers(replies) | (keys.first != keys.last))[keys.which]
    return exchange.covered(len(view.buf), np.maximum(at[shared] - PERIOD + 1, 0), PERIOD)


def candidates(view: View, size: int, buckets: int, near: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and buckets of the suffixes that take part."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(near, np.uint8), count=len(view.buf)))
    at = at[at + size <= view.end[at]]
    if not len(at):
        return at, at
    words = np.lib.stride_tricks.sliding_window_view(view.buf, 8)
    head = np.ascontiguousarray(words[at]).view(np.uint64).ravel()
    tail = np.ascontiguousarray(words[at + size - 8]).view(np.uint64).ravel()
    return at, (text.mix(head + np.uint64(3) * text.mix(tail)) % np.uint64(buckets)).astype(np.int64)


def suffix_keys(view: View, size: int, buckets: int, at: np.ndarray, bucket: np.ndarray) -> exchange.Keys:
    return exchange.Keys(bucket, text.spans(view.sums, at, at + size), view.order[view.number[at]], buckets)


def dedup(documents: DataFrame, size: int = 50, block_bytes: int = 1 << 21, rounds: int = 4, bucket_bytes: int = exchange.BUCKET_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs) and the kept bytes, ``kept``."""
    if size - PERIOD < 8:
        raise ValueError("strings have to be longer than the period of the cover")
    blocks = exchange.block_table(documents, block_bytes)
    buckets = exchange.buckets_of(blocks, bucket_bytes)
    shared = exchange.ask(blocks, lambda b, _: samples(View(b), size, buckets)[0], False, "shared-samples")

    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                view = View(exchange.Block(batch, i))
                near = np.packbits(near_samples(view, size, buckets, batch.column(4)[i].as_py()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i: i + 1], pa.array([near.tobytes()], pa.binary())], ["block", "near"])

    near = store.written(exchange.with_replies(blocks, shared).mapInArrow(reveal, "block bigint, near binary"), "near-samples")
    marked = blocks.join(near.hint("shuffle_hash"), "block")

    def of_round(number: int):
        def keys(block: exchange.Block, near: bytes) -> exchange.Keys:
            view = View(block)
            at, bucket = candidates(view, size, buckets, near)
            mine = bucket % rounds == number
            return suffix_keys(view, size, buckets, at[mine], bucket[mine])

        return keys

    earlier = None
    for number in range(rounds):
        found = exchange.ask(marked, of_round(number), True, "earlier-suffixes")
        earlier = found if earlier is None else earlier.union(found)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = exchange.Block(batch, i)
                view = View(block)
                at, bucket = candidates(view, size, buckets, batch.column(4)[i].as_py())
                keys = suffix_keys(view, size, buckets, at, bucket)
                gone = keys.answers(batch.column(5)[i].as_py())[keys.which] | (view.order[view.number[at]] > keys.first[keys.which])
                yield _kept(block, exchange.covered(len(view.buf), at[gone], size))

    return exchange.with_replies(marked, earlier).mapInArrow(rest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def _kept(block: exchange.Block, removed: np.ndarray) -> pa.RecordBatch:
    begins = removed.copy()
    begins[1:] &= ~removed[:-1]
    full = block.offsets[:-1][block.offsets[:-1] < block.offsets[1:]]
    begins[full] = removed[full]
    offsets = np.concatenate([[0], np.cumsum(text.counted(~removed, block.offsets))]).astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(block.ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(block.buf[~removed].tobytes())])
    counts = [np.diff(block.offsets), text.counted(removed, block.offsets), text.counted(begins, block.offsets)]
    return pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), *(pa.array(c.astype(np.int64)) for c in counts), out], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
