"""Benchmark decontamination with a positional inverted index that is split by documents.

1. Index: documents are dealt into blocks of a few MB. A block's row holds its terms (64-bit hashes of words, in order) and for each
   the list of places where it stands, numbered through the block, so that no posting is ever shuffled and a term that stands in every
   document costs each block one list. The index is a table and can be asked again without reading a text.
2. The benchmark becomes windows of ``size`` words (a shorter item is one window), in parts of about ``PART`` windows. A part is
   all that is broadcast; a benchmark of any size goes part by part.
3. The index counts the terms of a part. Each window is looked up from its rarest term: its list, moved back by the term's place in
   the window, gives the candidate starts, and the lists of the other terms, rarest first, are intersected with them one by one.
   Windows with a term that the block lacks are dropped before.
4. With a ``slop`` a term may stand up to so many words off its place, the rarest one excepted: these are the proximity matches.
   Exact phrase matches are those that pass with no slop.

Terms are told apart by 64-bit hashes; a false match needs all ten words of a window to collide.

Defined cases: A-Z count as a-z. A null or empty text has no words; an item without words is never found. Items of equal id are one
item; a null item id counts as an item but has no string in the digest. Rows of equal doc_id are documents of their own. Other
columns of either table are not looked at. A text larger than a block is a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from proseaudit.llm import store, text

BLOCK_BYTES = 1 << 22
#: Windows in a part, about 100 bytes each.
PART = 1 << 16
#: Candidate starts that are intersected at a time.
CHUNK = 1 << 20
INDEX = "block bigint, doc_ids array<bigint>, first binary, terms binary, lists binary, places binary"
FOUND = "row bigint, items array<bigint>, near array<bigint>, spans array<struct<start:bigint,stop:bigint>>"

#: Bytes as the contract sees them: A-Z as a-z, other ASCII characters but digits and letters as spaces.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def index(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The postings of all words of all documents, written as a table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch, buf, offsets in text.slices(batches, "text", block_bytes):
            words = text.Words(FOLD[buf], offsets)
            places = np.argsort(words.hash, kind="stable").astype(np.uint32)
            terms = words.hash[places]
            new = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                 *(pa.array([x.tobytes()], pa.binary()) for x in (words.first.astype(np.int64), terms[new], np.append(new, len(terms)).astype(np.uint32), places))],
                ["block", "doc_ids", "first", "terms", "lists", "places"])
            block += 1

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store.written(rows.mapInArrow(run, INDEX), "postings")


def documents_of(postings: DataFrame) -> DataFrame:
    """``row`` (unique), ``doc_id`` and ``n_words`` of every document of the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
                rows = _rows(batch.column(0)[i].as_py(), np.arange(len(first) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(1)[i].values, pa.array(np.diff(first))], ["row", "doc_id", "n_words"])

    return postings.select("block", "doc_ids", "first").mapInArrow(run, "row bigint, doc_id bigint, n_words bigint")


def _rows(block: int, place: np.ndarray) -> np.ndarray:
    """A number for each document: the partition, the block in it (22 bits) and the place in the block (22 bits)."""
    return (np.int64(block >> 32) << 44) + (np.int64(block & 0xFFFFFFFF) << 22) + place.astype(np.int64)


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """``item_id`` and ``terms`` of every distinct window of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in text.slices(batches, "text"):
            words = text.Words(FOLD[buf], offsets)
            length = np.minimum(np.diff(words.first), size)
            n = np.where(length > 0, np.diff(words.first) - length + 1, 0)
            row = np.repeat(np.arange(batch.num_rows), n)
            start = words.first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            ends = np.append(0, np.cumsum(length[row])).astype(np.int32)
            at = np.repeat(start - ends[:-1], length[row]) + np.arange(ends[-1])
            terms = pa.ListArray.from_arrays(pa.array(ends), pa.array(words.hash[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms], ["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id bigint, terms array<bigint>").distinct()


class Part:
    """Some windows of the benchmark: distinct windows as places in ``terms``, padded with -1, and the items that hold each."""

    def __init__(self, rows: pa.Table):
        lists = rows.column("terms").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy().view(np.uint64)
        self.terms, which = np.unique(flat, return_inverse=True)
        padded = np.full((len(lengths), int(lengths.max(initial=1))), -1, np.int64)
        padded[np.arange(padded.shape[1]) < lengths[:, None]] = which
        self.windows, owner = np.unique(padded, axis=0, return_inverse=True)
        order = np.argsort(owner.ravel(), kind="stable")
        self.items = rows.column("item_id").combine_chunks().take(pa.array(order))
        self.item_at = np.append(0, np.cumsum(np.bincount(owner.ravel(), minlength=len(self.windows))))
        self.length = (self.windows >= 0).sum(axis=1)
        self.order = None

    def rank(self, counts: np.ndarray) -> None:
        """Order the places of each window by how often their term stands in the corpus, padding last."""
        by = np.where(self.windows >= 0, counts[self.windows], np.iinfo(np.int64).max)
        self.order = np.argsort(by, axis=1, kind="stable")
        self.possible = (np.where(self.windows >= 0, by, 1) > 0).all(axis=1)


def counts(postings: DataFrame, part: Part) -> np.ndarray:
    """How often each term of the part stands in the corpus."""
    shared = postings.sparkSession.sparkContext.broadcast(part.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, lists = np.frombuffer(batch.column(0)[i].as_buffer(), np.uint64), np.frombuffer(batch.column(1)[i].as_buffer(), np.uint32)
                at, there = _find(terms, shared.value)
                total[there] += np.diff(lists.astype(np.int64))[at[there]]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    rows = postings.select("terms", "lists").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(part.terms), np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out


def _find(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value is in an ordered array, and whether it is there."""
    at = np.searchsorted(ordered, wanted)
    there = at < len(ordered)
    there[there] = ordered[at[there]] == wanted[there]
    return at, there


class Block:
    """The lists of one block, as one ordered array of (term, place)."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, lists: np.ndarray, places: np.ndarray):
        self.first, self.terms, self.lists, self.places = first, terms, lists.astype(np.int64), places.astype(np.int64)
        self.keys = (np.repeat(np.arange(len(terms)), np.diff(self.lists)) << 32) | self.places

    def candidates(self, part: Part) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, places of their rarest terms, term numbers here of the part's terms), so many at a time."""
        term, there = _find(self.terms, part.terms)
        held = np.append(there, True)[part.windows].all(axis=1) & part.possible
        held = np.flatnonzero(held)
        rare = term[part.windows[held, part.order[held, 0]]]
        n = self.lists[rare + 1] - self.lists[rare]
        cut = np.flatnonzero(np.diff(np.cumsum(n) // CHUNK, prepend=0)) if len(n) else []
        for a, b in zip([0, *cut], [*cut, len(held)]):
            which = np.repeat(np.arange(a, b), n[a:b])
            at = np.arange(len(which)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + self.lists[rare[which]]
            yield held[which], self.places[at], term

    def matches(self, part: Part, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, document, start) of every place where a window's terms stand up to ``slop`` words off."""
        for window, place, term in self.candidates(part):
            doc = np.searchsorted(self.first, place, side="right") - 1
            start = place - part.order[window, 0]
            for step in range(1, part.windows.shape[1]):
                offset = part.order[window, step]
                wanted = part.windows[window, offset]
                low = np.maximum(start + offset - slop, self.first[doc])
                high = np.minimum(start + offset + slop, self.first[doc + 1] - 1)
                base = term[wanted] << 32
                at = np.searchsorted(self.keys, base + low)
                good = (low <= high) & (at < len(self.keys))
                good[good] = self.keys[at[good]] <= (base + high)[good]
                good |= wanted < 0
                window, doc, start = window[good], doc[good], start[good]
            yield window, doc, start


def search(postings: DataFrame, part: Part, slop: int) -> DataFrame:
    """For each document with a match: the items matched exactly and nearly, and the word spans of exact matches, joined where they touch."""
    shared = postings.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                first, terms, lists, places = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in ((1, np.int64), (2, np.uint64), (3, np.uint32), (4, np.uint32)))
                block = Block(first, terms, lists, places)
                near = _distinct([(doc, window) for window, doc, _ in block.matches(part, slop)])
                hits = [(doc, window, start) for window, doc, start in block.matches(part, 0)] if len(near[0]) else []
                exact = _distinct([x[:2] for x in hits])
                docs = np.union1d(near[0], exact[0])
                covered = np.zeros(int(first[-1]) + 1, np.int64)
                for _, window, start in hits:
                    np.add.at(covered, start, 1)
                    np.add.at(covered, start + part.length[window], -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_rows(batch.column(0)[i].as_py(), docs)), _items(part, docs, exact), _items(part, docs, near), _spans(np.cumsum(covered[:-1]) > 0, first, docs)],
                    ["row", "items", "near", "spans"])

    return postings.select("block", "first", "terms", "lists", "places").mapInArrow(run, FOUND)


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, window) pairs, by document."""
    keys = np.unique(np.concatenate([np.empty(0, np.int64), *(np.unique((doc << 32) | window) for doc, window in parts)]))
    return keys >> 32, keys & 0xFFFFFFFF


def _items(part: Part, docs: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """The items of each document's windows; one may be there twice."""
    doc, window = pairs
    n = part.item_at[window + 1] - part.item_at[window]
    at = np.repeat(part.item_at[window] - np.cumsum(n) + n, n) + np.arange(n.sum())
    ends = np.append(0, np.cumsum(np.bincount(np.repeat(np.searchsorted(docs, doc), n), minlength=len(docs)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), part.items.take(pa.array(at.astype(np.int64))))


def _spans(hit: np.ndarray, first: np.ndarray, docs: np.ndarray) -> pa.Array:
    """Runs of hit words of each document, counted from its first word."""
    begin = hit.copy()
    begin[1:] &= ~hit[:-1]
    inner = first[1:-1][first[1:-1] < len(hit)]
    begin[inner] = hit[inner]
    start = np.flatnonzero(begin)
    end = hit.copy()
    end[:-1] &= ~hit[1:] | begin[1:]
    stop = np.flatnonzero(end) + 1
    doc = np.searchsorted(first, start, side="right") - 1
    ends = np.append(0, np.cumsum(np.bincount(np.searchsorted(docs, doc), minlength=len(docs)))).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(start - first[doc]), pa.array(stop - first[doc])], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(ends), runs)


def covered_words(spans: Column) -> Column:
    """How many words lie in at least one of the spans, which are in order."""
    step = lambda was, x: F.struct(
        (was["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], was["reach"]))).alias("n"), F.greatest(was["reach"], x["stop"]).alias("reach"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("reach")), step, lambda was: was["n"])


def find(postings: DataFrame, items: DataFrame, size: int = 10, slop: int = 2, part_windows: int = PART) -> DataFrame:
    """One row for each document of the index: ``row, doc_id, n_words, items, near`` (distinct item ids) and ``spans`` of exact matches."""
    wanted = store.written(windows(items, size), "windows")
    parts = -(-wanted.count() // part_windows)
    found = None
    for number in range(parts):
        own = wanted.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(parts)) == number) if parts > 1 else wanted
        part = Part(own.toArrow())
        part.rank(counts(postings, part))
        rows = search(postings, part, slop)
        found = rows if found is None else found.union(rows)
    if found is None:
        found = postings.sparkSession.createDataFrame([], FOUND)
    merged = found.groupBy("row").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")], F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    rows = documents_of(postings).join(merged, "row", "left")
    return rows.withColumns({c: F.coalesce(c, F.array()) for c in ("items", "near", "spans")})


def contamination(documents: DataFrame, items: DataFrame, size: int = 10, slop: int = 2) -> DataFrame:
    """Index the documents, find the items, and give one row per document as ``find`` does; the index is dropped."""
    with store.Scratch(documents.sparkSession) as scratch:
        return scratch.kept(find(index(documents), items, size, slop), "contamination")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS x
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
dw AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS x
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT r, i, k, item_id FROM dw JOIN bw USING (k, x)),
n AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS i FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
i AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.s, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN i ON i.r = d.r
"""


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    n_hit = covered_words(F.col("spans"))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
