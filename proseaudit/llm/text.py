"""Words, lines and windows of many texts at once, as numpy arrays over the bytes of an Arrow batch.

A *slice* is a run of rows whose texts lie one after the other in one byte buffer. Spans (words, lines, windows) are
``[start, stop)`` pairs into that buffer and never cross a row. Hashes are 64-bit polynomials over random byte values,
finished with a mixing step, so a span's hash depends only on its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept and enlarged as needed."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, U64(base))
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums over 64-bit values, one longer than the input."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the spans of a sequence given its running sums."""
    return mix((sums[stop] - sums[start]) * powers(len(sums))[1][start])


def windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of a fixed size."""
    n = len(sums) - size
    return mix((sums[size:] - sums[:-size]) * powers(len(sums))[1][:n]) if n > 0 else np.empty(0, U64)


def byte_sums(buf: np.ndarray) -> np.ndarray:
    return prefix(_BYTE[buf])


def counted(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each ``[offsets[i], offsets[i+1])``."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


class Words:
    """Runs of bytes that are no ASCII white space.

    ``start``, ``stop``: byte spans; ``first``: index of each row's first word, one more than rows; ``hash``.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, sums: np.ndarray | None = None):
        word = NOT_SPACE[buf]
        start, stop = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        full = offsets[:-1] < offsets[1:]
        begin, last = offsets[:-1][full], offsets[1:][full] - 1
        start[begin] = word[begin]
        stop[last] = word[last]
        self.inside = word
        self.start = np.flatnonzero(start)
        self.stop = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = spans(byte_sums(buf) if sums is None else sums, self.start, self.stop)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first word and row of every window of ``size`` words of one row."""
        ends = self.first[1:][self.row]
        n = max(0, len(self.hash) - size + 1)
        at = np.flatnonzero(np.arange(n) + size <= ends[:n])
        return windows(prefix(self.hash), size)[at], at, self.row[at]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of each batch in runs of at most ``limit`` bytes of text (at least one row): batch slice, bytes, offsets."""
    for batch in batches:
        buf, offsets = buffer_of(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), buf[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]
            at = to
