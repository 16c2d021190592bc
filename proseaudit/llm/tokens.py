"""Token ids of whole texts under a public byte-level vocabulary.

Texts are cut before a space that a visible character follows: the vocabulary's pattern never joins tokens across such a
place, so every distinct piece is encoded once and its ids are reused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from proseaudit.llm import text

#: Bytes that may follow the space at a cut: visible ASCII, and first bytes of characters that are never white space.
_AFTER = np.zeros(256, bool)
_AFTER[0x21:0x7F] = True
_AFTER[0xC3:0xF5] = True
_AFTER[[0xE1, 0xE2, 0xE3]] = False


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path of a vocabulary in ranks form; any file of that form will do."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """Encodes Arrow slices; holds at most ``keep`` distinct pieces between slices."""

    def __init__(self, path: str, keep: int = 400_000):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.keep, self.known = keep, {}

    def slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the offset of each row's first id."""
        cut = np.zeros(len(buf) + 1, bool)
        cut[: len(buf) - 1] = (buf[:-1] == 0x20) & _AFTER[buf[1:]] if len(buf) else False
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(buf))[: len(start)]
        keys, at, which = np.unique(text.spans(text.byte_sums(buf), start, stop), return_index=True, return_inverse=True)
        data, known, encode = buf.tobytes(), self.known, self.encoding.encode_ordinary
        if len(known) > self.keep:
            known.clear()
        found = []
        for key, a, b in zip(keys.tolist(), start[at].tolist(), stop[at].tolist()):
            ids = known.get(key)
            if ids is None:
                ids = known[key] = tuple(encode(data[a:b].decode()))
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(size.sum()))
        begin = np.cumsum(size) - size
        n = size[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begin[which] - (ends - n), n) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(start, offsets)].astype(np.int64)


def lengths(batches: Iterator[pa.RecordBatch], path: str, column: str = "text", out: str = "n_tokens") -> Iterator[pa.RecordBatch]:
    """Each batch with the number of tokens instead of the text."""
    encoder = Encoder(path)
    for batch, buf, offsets in text.slices(batches, column, 1 << 21):
        _, first = encoder.slice(buf, offsets)
        at = batch.schema.get_field_index(column)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.diff(first)) if i == at else c for i, c in enumerate(batch.columns)], [out if n == column else n for n in batch.schema.names])
