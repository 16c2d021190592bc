"""Phrase collocations by stripes: every prefix keys a counter of the words that follow it.

1. A pass over the texts for each prefix length, from none to four words. A block of documents makes one stripe for each prefix it
   holds: the following words with their counts. Stripes travel in bundles, by a hash of the prefix: a bundle holds the stripes of a
   block that fall to one of so many buckets that each has some ``BUCKET_WORDS`` words of text, so there are never more rows than stripes.
   Stripes of a prefix are merged elementwise after one shuffle. A merged stripe gives
   the frequencies of the one-word extensions, which are the totals of the prefixes of the next pass, and the largest of them (for
   subsumption).
2. A phrase is frequent only if the phrases without its first and without its last word are. So a pass sends stripes for prefixes
   that passed before, with the words that make an extension whose last words passed, too. What passed is broadcast as a bit filter
   of ``FILTER_BITS`` at most: a false positive costs a row, never a result.
3. Hot prefixes, with at least 1/1024 of all words each and so at most 1,024, are broadcast, and their stripes are split over
   buckets by the next word; the stripe of the empty prefix always is. So no task sees a prefix whole that a third of the corpus holds.
4. Candidates look up the totals of both sides of each cut. Scores are computed with decimals of 38 digits.

Words are told apart by 64-bit hashes, salted by language; phrases by the hashes of all their words.

Defined cases: A-Z count as a-z. A null or empty text has no words; a null language is ``und``. Repeated rows count each. Other columns
are not looked at. A text is one group of pieces, however long. Frequencies and word counts must be below 10**15, else an error is raised.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from proseaudit.llm import store, text

U64 = np.uint64
MAX_WORDS = 5
BLOCK_BYTES = 1 << 22
#: Words of text for each bucket of stripes, at most, and entries of a bundle that are merged at a time.
BUCKET_WORDS, MERGE_ENTRIES = 1 << 21, 1 << 19
#: Sub-stripes of the empty prefix and of a hot one, by the leading bits of the next word.
WORD_BITS, HOT_BITS = 10, 6
FILTER_BITS, CHUNK_BITS = 29, 19
#: Languages of which the word counts are broadcast; with more of them, they are joined by a shuffle.
SMALL = 1 << 16
STRIPES = "lang string, bucket int, prefixes binary, sizes binary, next binary, n binary"
MERGED = "lang string, words binary, a bigint, best bigint"
_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"

BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[BREAK] = 0x20


class Tokens:
    """The words of a slice: ``id`` (hash, salted by language), language, and ``room`` (words from here to the end of the piece)."""

    def __init__(self, batch: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray):
        self.buf = FOLD[buf]
        self.words = text.Words(self.buf, offsets)
        coded = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy()[self.words.row]
        salt = text.byte_sums(np.frombuffer("".join(self.langs.to_pylist()).encode(), np.uint8))
        ends = np.append(0, np.cumsum([len(x.encode()) for x in self.langs.to_pylist()])).astype(np.int64)
        salt = text.mix(text.spans(salt, ends[:-1], ends[1:]) + U64(1))  # not the hash of a word, or "es" in "en" were "en" in "es"
        self.id = np.maximum(text.mix(self.words.hash ^ salt[self.lang]), U64(1))
        breaks = np.cumsum(BREAK[buf])[self.words.start]
        n = len(self.id)
        new = np.ones(n, bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (self.words.row[1:] != self.words.row[:-1])
        starts = np.flatnonzero(new)
        self.room = np.append(starts[1:], n)[np.cumsum(new) - 1] - np.arange(n) if n else np.empty(0, np.int64)
        self.sums = text.prefix(self.id)

    def phrases(self, size: int) -> np.ndarray:
        """The hash of the ``size`` words from each word on; meaningless where there is no room."""
        out = np.zeros(len(self.id), U64)
        found = text.windows(self.sums, size)
        out[: len(found)] = found
        return out


def hash_of(words: np.ndarray) -> np.ndarray:
    """Hashes of phrases given as rows of word ids, equal to those of ``Tokens.phrases``."""
    return text.mix((words * text.powers(words.shape[1])[0]).sum(axis=1, dtype=U64))


class Passed:
    """A bit for the leading bits of each frequent phrase's hash, and the hashes of hot ones."""

    def __init__(self, bits: np.ndarray, size: int, hot: np.ndarray):
        self.bits, self.size, self.hot = bits, size, hot

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> U64(64 - self.size)
        return (self.bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0

    def is_hot(self, hashes: np.ndarray) -> np.ndarray:
        return np.isin(hashes, self.hot)


def passed(merged: DataFrame, n_words: int) -> Passed | None:
    """The filter of all extensions; None if there are none. Its bits are gathered in chunks of 64 KB, 64 MB at most."""
    rows = merged.where("a IS NOT NULL")
    count = rows.count()
    if not count:
        return None
    size = min(FILTER_BITS, max(CHUNK_BITS, (16 * count - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(hash_of(_matrix(batch.column(0))) >> U64(64 - size)).astype(np.int64) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> CHUNK_BITS).astype(np.int32)), pa.array((at & ((1 << CHUNK_BITS) - 1)).astype(np.int32))], ["chunk", "at"])

    def packed(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << CHUNK_BITS, np.uint8)
        bits[table.column("at").to_numpy()] = 1
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    chunks = rows.select("words").mapInArrow(places, "chunk int, at int").distinct().groupBy("chunk").applyInArrow(packed, "chunk int, bits binary")
    bits = np.zeros(1 << (size - 3), np.uint8)
    for row in chunks.toLocalIterator():
        bits[row.chunk << (CHUNK_BITS - 3): (row.chunk + 1) << (CHUNK_BITS - 3)] = np.frombuffer(row.bits, np.uint8)
    hot = rows.where(F.col("a") >= max(1, n_words >> 10)).select("words").toArrow().column(0).combine_chunks()
    return Passed(bits, size, hash_of(_matrix(hot)) if len(hot) else np.empty(0, U64))


def _matrix(phrases: pa.Array) -> np.ndarray:
    """Phrases of equal length as rows of word ids."""
    buf, _ = text.buffer_of(phrases)
    return np.frombuffer(buf.tobytes(), U64).reshape(len(phrases), -1)


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column from byte offsets and values."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def word_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stripe of the empty prefix of each language, in sub-stripes, with the words."""
    for batch, buf, offsets in text.slices(batches, "text", BLOCK_BYTES):
        tokens = Tokens(batch, buf, offsets)
        ids, at, n = np.unique(tokens.id, return_index=True, return_counts=True)
        order = np.argsort(tokens.lang[at], kind="stable")  # ids are in order, so sub-stripes are runs
        ids, at, n = ids[order], at[order], n[order]
        lang, sub = tokens.lang[at], (ids >> U64(64 - WORD_BITS)).astype(np.int32)
        starts = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (sub[1:] != sub[:-1]))[: len(ids)])
        ends = np.append(starts, len(ids))
        begin, length = tokens.words.start[at], (tokens.words.stop - tokens.words.start)[at]
        cuts = np.append(0, np.cumsum(length))
        data = tokens.buf[np.repeat(begin - cuts[:-1], length) + np.arange(cuts[-1])]
        words = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays(
            [tokens.langs.take(pa.array(lang[starts])), pa.array(sub[starts]), _binary(ends * 8, ids), _binary(ends * 8, n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words)],
            ["lang", "sub", "next", "n", "word"])


def stripes(size: int, known: Passed, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of prefixes of ``size`` words that passed, with the words after which the last ``size`` words passed, too.

    A row is the bundle of a bucket: prefixes, the size of the stripe of each, and the next words and counts of all of them.
    """
    for batch, buf, offsets in text.slices(batches, "text", BLOCK_BYTES):
        tokens = Tokens(batch, buf, offsets)
        prefix = tokens.phrases(size)
        good = known(prefix) & (tokens.room >= size)
        at = np.flatnonzero(good[:-1] & good[1:] & (tokens.room[:-1] > size))
        prefix, word = prefix[at], tokens.id[at + size]
        _, first, n = np.unique(text.mix(prefix + word * U64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        at, prefix, word = at[first], prefix[first], word[first]
        split = np.where(known.is_hot(prefix), (word >> U64(64 - HOT_BITS)) + U64(1), U64(0))
        lang, bucket = tokens.lang[at], (text.mix(prefix ^ text.mix(split)) >> U64(32)).astype(np.int64) >> (32 - bits)
        order = np.lexsort((word, prefix, bucket, lang))
        at, prefix, word, n, lang, bucket = (x[order] for x in (at, prefix, word, n, lang, bucket))
        new_row = np.append(True, (lang[1:] != lang[:-1]) | (bucket[1:] != bucket[:-1]))[: len(at)]
        units = np.flatnonzero(new_row | np.append(True, prefix[1:] != prefix[:-1])[: len(at)])
        rows = np.flatnonzero(new_row)
        first_unit = np.append(np.searchsorted(units, rows), len(units))
        ends = np.append(rows, len(at))
        sizes = np.diff(np.append(units, len(at))).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [tokens.langs.take(pa.array(lang[rows])), pa.array(bucket[rows].astype(np.int32)), _binary(first_unit * 8 * size, tokens.id[at[units][:, None] + np.arange(size)]),
             _binary(first_unit * 4, sizes), _binary(ends * 8, word), _binary(ends * 4, n.astype(np.uint32))],
            ["lang", "bucket", "prefixes", "sizes", "next", "n"])


def _runs(columns: list[pa.Array]) -> tuple[list[tuple], np.ndarray]:
    """The distinct keys of rows that are sorted by them, and at which rows a new one starts."""
    change = np.ones(len(columns[0]), bool)
    change[1:] = False
    for c in columns:
        coded = c.dictionary_encode().indices.to_numpy()
        change[1:] |= coded[1:] != coded[:-1]
    starts = pa.array(np.flatnonzero(change))
    return list(zip(*(c.take(starts).to_pylist() for c in columns))), change


class Run:
    """A stripe that is still being merged: its key, words in order and their counts."""

    def __init__(self, key: tuple, word: np.ndarray, n: np.ndarray, payload: pa.Array | None):
        self.key, self.word, self.n, self.payload = key, word, n, payload


def merged_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, pa.Array | None]]:
    """Elementwise sums of the stripes of equal keys (the first ``keys`` columns, by which rows are sorted).

    Gives some keys at a time: keys, the first place of each in what follows, words, counts, and the payload (a list column, if there is one).
    A key is held until another one comes, already merged, so memory is bounded by a batch and one stripe.
    """
    held: Run | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names, change = _runs([batch.column(i) for i in range(keys)])
        words, ends = text.buffer_of(batch.column(keys))
        word, size = np.frombuffer(words.tobytes(), U64), np.diff(ends) // 8
        n = np.frombuffer(text.buffer_of(batch.column(keys + 1))[0].tobytes(), np.int64)
        payload = batch.column(keys + 2).flatten() if batch.num_columns > keys + 2 else None
        run = np.repeat(np.cumsum(change) - 1, size)
        if held is not None:
            if held.key == names[0]:
                before = np.zeros(len(held.word), np.int64)
            else:
                before, run, names = np.zeros(len(held.word), np.int64), run + 1, [held.key, *names]
            run, word, n = np.concatenate([before, run]), np.concatenate([held.word, word]), np.concatenate([held.n, n])
            payload = None if payload is None else pa.concat_arrays([held.payload, payload])
        order = np.lexsort((word, run))
        new = np.append(True, (run[order][1:] != run[order][:-1]) | (word[order][1:] != word[order][:-1]))
        first = np.flatnonzero(new)
        n = np.add.reduceat(n[order], first)
        run, word = run[order][first], word[order][first]
        payload = None if payload is None else payload.take(pa.array(order[first]))
        at = np.searchsorted(run, np.arange(len(names)))
        last = at[-1]
        held = Run(names[-1], word[last:], n[last:], None if payload is None else payload.slice(int(last)))
        if len(names) > 1:
            yield names[:-1], at[:-1], word[:last], n[:last], None if payload is None else payload.slice(0, int(last))
    if held is not None:
        yield [held.key], np.zeros(1, np.int64), held.word, held.n, held.payload


def slices_of(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``limit`` bytes of a binary column, at least one row each."""
    for batch in batches:
        ends = text.buffer_of(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def merged_bundles(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Elementwise sums of the stripes of equal prefixes, in bundles sorted by language and bucket.

    Gives some buckets at a time: language and words of each prefix, the first place of each in what follows, next words, counts.
    A bucket is held, merged, until another one comes.
    """
    key, held = None, None

    def stripes_of(langs: list, run: np.ndarray, own: np.ndarray, word: np.ndarray, n: np.ndarray):
        new = np.append(True, (run[1:] != run[:-1]) | (own[1:] != own[:-1]).any(axis=1))
        at = np.flatnonzero(new)
        return pa.array(langs, pa.string()).take(pa.array(run[at])), own[at], at, word, n

    for batch in slices_of(batches, 4, 8 * MERGE_ENTRIES):
        names, change = _runs([batch.column(0), batch.column(1)])
        columns = [text.buffer_of(batch.column(i)) for i in range(2, 6)]
        units, sizes, word, n = (np.frombuffer(c[0].tobytes(), k) for c, k in zip(columns, (U64, np.uint32, U64, np.uint32)))
        row = np.repeat(np.cumsum(change) - 1, np.diff(columns[1][1]) // 4)
        run, own, n = np.repeat(row, sizes), np.repeat(units.reshape(-1, size), sizes, axis=0), n.astype(np.int64)
        if held is not None:
            if key != names[0]:
                run, names = run + 1, [key, *names]
            run, own, word, n = (np.concatenate(x) for x in zip((np.zeros(len(held[1]), np.int64), *held), (run, own, word, n)))
        prefix = hash_of(own)
        order = np.lexsort((word, prefix, run))
        run, prefix, word = run[order], prefix[order], word[order]
        first = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1])))
        n, run, own, word = np.add.reduceat(n[order], first), run[first], own[order[first]], word[first]
        last = int(np.searchsorted(run, len(names) - 1))
        key, held = names[-1], (own[last:], word[last:], n[last:])
        if last:
            yield stripes_of([k[0] for k in names], run[:last], own[:last], word[:last], n[:last])
    if held is not None:
        yield stripes_of([key[0]], np.zeros(len(held[1]), np.int64), *held)


def merge_words(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent words with their counts, and the sum of each sub-stripe."""
    for names, at, word, n, payload in merged_runs(batches, 2):
        lang = pa.array([k[0] for k in names], pa.string())
        owner = np.searchsorted(at, np.arange(len(word)), side="right") - 1
        often = np.flatnonzero(n >= least)
        yield pa.RecordBatch.from_arrays(
            [lang.take(pa.array(owner[often])), _binary(np.arange(len(often) + 1) * 8, word[often]), pa.array(n[often]), payload.take(pa.array(often)), pa.nulls(len(often), pa.int64())], ["lang", "words", "a", "word", "total"])
        yield pa.RecordBatch.from_arrays([lang, pa.nulls(len(names), pa.binary()), pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.string()), pa.array(np.add.reduceat(n, at))], ["lang", "words", "a", "word", "total"])


def merge_stripes(size: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent extensions with their counts ``a``; and the prefix of each sub-stripe with its largest extension ``best``."""
    for lang, prefix, at, word, n in merged_bundles(size, batches):
        owner = np.searchsorted(at, np.arange(len(word)), side="right") - 1
        often = np.flatnonzero(n >= least)
        longer = np.concatenate([prefix[owner[often]], word[often][:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([lang.take(pa.array(owner[often])), _binary(np.arange(len(often) + 1) * 8 * (size + 1), longer), pa.array(n[often]), pa.nulls(len(often), pa.int64())], ["lang", "words", "a", "best"])
        best = np.maximum.reduceat(n, at)
        top = np.flatnonzero(best >= least)
        yield pa.RecordBatch.from_arrays([lang.take(pa.array(top)), _binary(np.arange(len(top) + 1) * 8 * size, prefix[top]), pa.nulls(len(top), pa.int64()), pa.array(best[top])], ["lang", "words", "a", "best"])


def dealt(rows: DataFrame, send: Callable, schema: str, keys: list[str], merge: Callable, out: str, name: str) -> DataFrame:
    """Stripes of all blocks, merged by key, as a table."""
    sent = rows.mapInArrow(send, schema)
    return store.written(sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, out), name)


def frequencies(documents: DataFrame, least: int = 100, longest: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Words (``lang, words, a, word``), words by language (``lang, n``), prefix totals (``lang, words, total, best``) and extensions (``lang, words, a``).

    ``words`` holds eight bytes for each word of a phrase. Extensions are all phrases of two to ``longest`` words with ``a >= least``.
    """
    spark = documents.sparkSession
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    found = dealt(rows, word_stripes, "lang string, sub int, next binary, n binary, word array<string>", ["lang", "sub"], lambda b: merge_words(least, b), "lang string, words binary, a bigint, word string, total bigint", "stripes-0")
    langs = store.written(found.where("total IS NOT NULL").groupBy("lang").agg(F.sum("total").alias("n")), "languages")
    n_words = langs.agg(F.sum("n")).first()[0] or 0
    words, levels = found.where("a IS NOT NULL").drop("total"), []
    known, bits = passed(words, n_words), min(30, (max(0, n_words - 1) // BUCKET_WORDS).bit_length())
    for size in range(1, longest):
        if known is None:
            break
        shared = spark.sparkContext.broadcast(known)
        levels.append(dealt(
            rows, lambda b, size=size, shared=shared: stripes(size, shared.value, bits, b), STRIPES, ["lang", "bucket"],
            lambda b, size=size: merge_stripes(size, least, b), MERGED, f"stripes-{size}"))
        known = passed(levels[-1], n_words) if size + 1 < longest else None
    if not levels:
        levels = [spark.createDataFrame([], MERGED)]
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    best = every.where("a IS NULL").groupBy("words").agg(F.max("best").alias("best"))
    extensions = every.where("a IS NOT NULL").select("lang", "words", "a")
    shorter = words.select("words", "a").union(extensions.select("words", "a").where(F.length("words") < 8 * longest))
    totals = shorter.join(best, "words", "left").select("words", F.col("a").alias("total"), "best")
    return words, langs, store.written(totals, "totals"), extensions


def scored(langs: DataFrame, totals: DataFrame, extensions: DataFrame) -> DataFrame:
    """``lang, words, a, l, r, n, score`` of the candidates that no longer one subsumes, at their lowest cut."""
    longer = extensions.select(F.expr("substring(words, 9)").alias("words"), "a").groupBy("words").agg(F.max("a").alias("left_best"))
    own = extensions.join(totals.select("words", "best"), "words", "left").join(longer, "words", "left")
    own = own.where(F.coalesce(F.greatest("best", "left_best"), F.lit(0)) < F.col("a"))
    cuts = own.select("lang", "words", "a", F.explode(F.expr("sequence(1, length(words) div 8 - 1)")).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring(words, 1, 8 * k)"), "right": F.expr("substring(words, 8 * k + 1)")})
    cuts = cuts.join(totals.select(F.col("words").alias("left"), F.col("total").alias("l")), "left").join(totals.select(F.col("words").alias("right"), F.col("total").alias("r")), "right")
    if langs.limit(SMALL + 1).count() <= SMALL:
        langs = F.broadcast(langs)
    score = "(1000 * cast(a AS decimal(15, 0)) * cast(n AS decimal(15, 0))) div (cast(l AS decimal(15, 0)) * cast(r AS decimal(15, 0)))"
    cuts = cuts.join(langs, "lang").select("lang", "words", "a", "n", F.struct(F.expr(score).alias("score"), "k", "l", "r").alias("cut"))
    return cuts.groupBy("lang", "words", "a", "n").agg(F.min("cut").alias("cut")).select("lang", "words", "a", "cut.l", "cut.r", "n", "cut.score")


@contextlib.contextmanager
def early_limit(spark: SparkSession, top: int):
    """Within it, a filter on a rank of up to ``top`` is applied before the shuffle, too."""
    before = spark.conf.get(_GROUP_LIMIT)
    spark.conf.set(_GROUP_LIMIT, str(max(top, int(before))))
    try:
        yield
    finally:
        spark.conf.set(_GROUP_LIMIT, before)


def _by(*order: Column) -> Window:
    return Window.partitionBy("lang").orderBy(*order)


def collocations(documents: DataFrame, least: int = 100, top: int = 2000, longest: int = MAX_WORDS) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    with store.Scratch(documents.sparkSession) as scratch, early_limit(documents.sparkSession, top):
        words, langs, totals, extensions = frequencies(documents, least, longest)
        order = [F.col("score").desc(), F.col("a").desc()]
        # Ties at the end stay until the phrases are spelled out.
        first = store.written(scored(langs, totals, extensions).withColumn("rank", F.rank().over(_by(*order))).where(F.col("rank") <= top).drop("rank"), "first-phrases")
        each = first.select(F.col("words").alias("whole"), F.posexplode(F.expr("transform(sequence(1, length(words) div 8), i -> substring(words, 8 * i - 7, 8))")).alias("place", "words"))
        spelled = each.join(words.select("words", "word"), "words").groupBy(F.col("whole").alias("words")).agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("parts"))
        rows = first.join(spelled, "words").withColumn("phrase", F.array_join("parts.word", " "))
        rows = rows.withColumn("rank", F.row_number().over(_by(*order, F.col("phrase"))).cast("bigint")).where(F.col("rank") <= top)
        return scratch.kept(rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) r(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1),
own AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c o WHERE o.lang = c.lang AND o.f >= c.f AND o.k > c.k AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, k, phrase, f, i, array_to_string(string_split(phrase, ' ')[:i], ' ') AS a, array_to_string(string_split(phrase, ' ')[i + 1:], ' ') AS b
  FROM (SELECT *, unnest(range(1, k)) AS i FROM own)),
scores AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, n.n, i, (1000::HUGEINT * cuts.f * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.a JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.b JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""
