"""Removing repeated passages of ``size`` words, by recompression.

Words are symbols. A step names runs of two equal symbols, or adjacent pairs of a left and a right symbol (by a bit of their names),
with a new symbol that is a hash of the parts; equal parts so get equal names in every document without asking anyone. What a
symbol is joined to depends on its neighbour alone, so a step can change a repeated passage only at its two edge symbols. Symbols have a
greatest length at each step; with the steps below at most 22 words at each edge of a passage are in doubt, and the symbol over
word 24 of a window of 50 is the same, at the same place, wherever the window stands. That symbol and the words around it that lie in
the window for certain (17 before its start, 26 from it) make a high-level symbol.

Round 1 finds the high-level symbols that other documents share; they reveal the windows that can be repeats. Round 2 verifies them: it asks for the
hash of the whole window, and gets back whether it starts in a smaller document. A word is removed if such a window covers it.

Defined cases: a null or empty text has no words. Rows with the same id never remove each other's words. A null id counts as larger than all
others. Texts of fewer words than a window stay whole, but for white space, which becomes one space between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from proseaudit.llm import exchange, text

#: Greatest length, in words, of a symbol after each pair step. The edges in doubt: 2 (runs), then the greatest length before each step.
LENGTHS = (3, 4, 5, 6, 8)
MARGIN = 2 + 2 + sum(LENGTHS[:-1])
PLACE, BEFORE = 24, 24 - LENGTHS[-1] + 1


def symbols(name: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of every top symbol, given the words' hashes and rows."""
    length, start = np.ones(len(name), np.int64), np.arange(len(name))
    for step, most in enumerate((2, *LENGTHS)):
        if len(name) < 2:
            break
        together = row[1:] == row[:-1]
        if step == 0:
            equal = together & (name[1:] == name[:-1])
            join = equal.copy()
            join[1:] &= ~equal[:-1]
            join[:-1] &= ~equal[1:]
        else:
            right = (text.mix(name + np.uint64(step * 0x9E3779B9)) & np.uint64(1)).astype(bool)
            join = together & ~right[:-1] & right[1:] & (length[1:] + length[:-1] <= most)
        at = np.flatnonzero(join)
        name, length = name.copy(), length.copy()
        name[at] = text.mix(name[at] * np.uint64(0x9E3779B97F4A7C15) + text.mix(name[at + 1]) + np.uint64(step))
        length[at] += length[at + 1]
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, length, start, row = name[keep], length[keep], start[keep], row[keep]
    return start, length


class View(text.Words):
    """The words of a block."""

    def __init__(self, block: exchange.Block):
        super().__init__(block.buf, block.offsets)
        self.owner = self.row
        self.doc = block.order[self.owner]
        self.sums = text.prefix(self.hash)
        self.place = np.arange(len(self.hash))


def revealed(view: View, size: int, buckets: int) -> tuple[exchange.Keys, np.ndarray, np.ndarray]:
    """Keys of the high-level symbols, and for every word the symbol over it (-1: none that counts)."""
    start, length = symbols(view.hash, view.owner)
    after = size - PLACE
    own = view.owner[start]
    inside = (start - BEFORE >= view.first[own]) & (start + after <= view.first[own + 1])
    number = np.where(inside, np.cumsum(inside) - 1, -1)
    at = start[inside]
    key = text.spans(view.sums, at - BEFORE, at + after)
    return exchange.Keys((key >> np.uint64(32)) % np.uint64(buckets), key & np.uint64(0xFFFFFFFF), view.doc[at], buckets), np.repeat(number, length), at


def candidates(view: View, size: int, buckets: int, replies: list | None) -> tuple[exchange.Keys, np.ndarray]:
    """Keys of the windows over a shared high-level symbol, and their first words."""
    keys, over, _ = revealed(view, size, buckets)
    shared = (keys.answers(replies) | (keys.first != keys.last))[keys.which]
    n = max(0, len(view.hash) - size + 1)
    at = view.place[:n][view.owner[:n] == view.owner[size - 1:][:n]]
    symbol = over[at + PLACE]
    at = at[(symbol >= 0) & np.append(shared, False)[symbol]]
    key = text.spans(view.sums, at, at + size)
    ends = text.mix(view.hash[at] + np.uint64(3) * view.hash[at + size - 1])
    return exchange.Keys(ends % np.uint64(buckets), key, view.doc[at], buckets), at


def dedup(documents: DataFrame, size: int = 50, block_bytes: int = 1 << 22, bucket_bytes: int = exchange.BUCKET_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed`` and the kept words, joined by one space, as ``text``."""
    if size - 2 * MARGIN < LENGTHS[0]:
        raise ValueError("windows have to be longer than the edges in doubt")
    blocks = exchange.block_table(documents, block_bytes)
    buckets = exchange.buckets_of(blocks, bucket_bytes)
    shared = exchange.ask(blocks, lambda b, _: revealed(View(b), size, buckets)[0], False, "shared-symbols")
    marked = exchange.with_replies(blocks, shared)
    earlier = exchange.ask(marked, lambda b, replies: candidates(View(b), size, buckets, replies)[0], True, "earlier-windows")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = exchange.Block(batch, i)
                view = View(block)
                keys, at = candidates(view, size, buckets, batch.column(4)[i].as_py())
                gone = keys.answers(batch.column(5)[i].as_py())[keys.which] | (view.doc[at] > keys.first[keys.which])
                removed = exchange.covered(len(view.hash), at[gone], size)
                yield _kept(block, view, removed)

    return exchange.with_replies(blocks, shared, earlier).mapInArrow(rest, "doc_id bigint, n_words bigint, n_removed bigint, text string")


def _kept(block: exchange.Block, view: View, removed: np.ndarray) -> pa.RecordBatch:
    """The rows of a block; a word's separator is the byte after it, turned into a space."""
    kept = np.flatnonzero(~removed)
    step = np.zeros(len(block.buf) + 1, np.int8)
    step[view.start[kept]] += 1
    step[view.stop[kept]] -= 1
    take = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    inner = kept[:-1][view.owner[kept[1:]] == view.owner[kept[:-1]]] if len(kept) else kept
    buf = block.buf.copy()
    buf[view.stop[inner]] = 0x20
    take[view.stop[inner]] = True
    offsets = np.concatenate([[0], np.cumsum(text.counted(take, block.offsets))]).astype(np.int32)
    out = pa.StringArray.from_buffers(len(block.ids), pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf[take].tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array(block.ids, pa.int64()), pa.array(np.diff(view.first).astype(np.int64)), pa.array(text.counted(removed, view.first)), out], ["doc_id", "n_words", "n_removed", "text"])
