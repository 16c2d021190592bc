import collections
import random
import re

import numpy as np
import pytest

from proseaudit.llm import collocations
from tests.llm.compare import against_sql


def brute(docs, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, t in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    inside = collections.Counter()
    for (lang, p), c in f.items():
        if c >= least:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[lang, p[i:i + k]] = max(inside[lang, p[i:i + k]], c)
    for (lang, p), a in f.items():
        if a >= least and len(p) > 1 and inside[lang, p] < a:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1): (p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


def corpus(seed=1):
    rng = random.Random(seed)
    common = ["es", "en", "de", "the", "ü", "Z"]

    def text():
        words = [rng.choice(common) if rng.random() < 0.7 else f"r{rng.randrange(300)}" for _ in range(rng.randrange(120))]
        return "".join(w + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\r\n"]) for w in words)

    docs = [(rng.choice(["en", "es", "de", None, "und"]), text()) for _ in range(150)]
    return docs + [("en", None), (None, ""), ("xx", "..."), ("yy", "one word here"), ("en", "a b c d e f g")] + [("en", "one fixed phrase of seven words here")] * 9


@pytest.mark.parametrize("least, top", [(4, 2000), (12, 5)])
def test_brute(spark, least, top):
    docs = corpus()
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "lang string, text string, rank int, words string").repartition(5)
    found = collocations.collocations(d, least, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r)[:2]: tuple(r)[2:] for r in found.collect()} == brute(docs, least, top)


def test_totals_are_the_sums_of_stripes(spark):
    """The total of a prefix's merged stripe is the count its extension got one pass before."""
    d = spark.createDataFrame(corpus(2), "lang string, text string").repartition(4)
    words, _, totals, extensions = collocations.frequencies(d, 5)
    counts = {bytes(r.words): r.a for r in words.select("words", "a").union(extensions.select("words", "a")).collect() if len(r.words) < 40}
    assert counts == {bytes(r.words): r.total for r in totals.collect()}


def test_score_beyond_64_bits(spark):
    a, n, part = 10**14 - 3, 9 * 10**14 + 1, 10**14 + 7
    langs = spark.createDataFrame([("x", n)], "lang string, n bigint")
    one, two = (0).to_bytes(8, "little"), (1).to_bytes(8, "little")
    totals = spark.createDataFrame([(bytearray(one), part, 0), (bytearray(two), part + 1, 0)], "words binary, total bigint, best bigint")
    rows = collocations.scored(langs, totals, spark.createDataFrame([("x", bytearray(one + two), a)], "lang string, words binary, a bigint")).collect()
    assert [r.score for r in rows] == [1000 * a * n // (part * (part + 1))]


def test_merging_does_not_depend_on_batches():
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted((rng.choice("ab"), rng.randrange(3), tuple(sorted(rng.sample(range(9), 3)))) for _ in range(60))
    pack = lambda x: np.array(x, np.uint64).tobytes()
    table = pa.table({"lang": [r[0] for r in rows], "sub": pa.array([r[1] for r in rows], pa.int32()), "next": [pack(r[2]) for r in rows], "n": [pack([1] * 3) for _ in rows]})
    want = collections.Counter((lang, sub, w) for lang, sub, x in rows for w in x)
    for size in (1, 7, 100):
        got = {}
        for keys, at, word, n, _ in collocations.merged_runs(iter(table.to_batches(max_chunksize=size)), 2):
            owner = np.searchsorted(at, np.arange(len(word)), side="right") - 1
            assert not any((*keys[o], int(w)) in got for o, w in zip(owner, word))
            got |= {(*keys[o], int(w)): int(c) for o, w, c in zip(owner, word, n)}
        assert got == want


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_sql(spark):
    against_sql(spark, "op13_phrase_collocations")


def test_many_buckets_and_hot_prefixes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 50)
    docs = corpus(3)
    found = collocations.collocations(spark.createDataFrame(docs, "lang string, text string").repartition(6), 6)
    assert {tuple(r)[:2]: tuple(r)[2:] for r in found.collect()} == brute(docs, 6, 2000)


def test_merging_bundles_does_not_depend_on_batches(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    pack = lambda x, kind=np.uint64: np.array(x, kind).tobytes()
    want, rows = collections.Counter(), []
    for _ in range(80):
        lang, bucket = rng.choice("ab"), rng.randrange(4)
        units = rng.sample(range(6), 3)
        follows = [rng.sample(range(1, 9), rng.randrange(1, 4)) for _ in units]
        want.update((lang, bucket * 10 + u, 7, w) for u, x in zip(units, follows) for w in x)
        rows.append((lang, bucket, pack([[bucket * 10 + u, 7] for u in units]), pack([len(x) for x in follows], np.uint32), pack(sum(follows, [])), pack([1] * sum(map(len, follows)), np.uint32)))
    columns = list(zip(*sorted(rows, key=lambda r: r[:2])))
    table = pa.table({"lang": columns[0], "bucket": pa.array(columns[1], pa.int32()), **dict(zip(["prefixes", "sizes", "next", "n"], columns[2:]))})
    for size, entries in ((1, 100), (7, 100), (100, 100), (100, 1)):
        monkeypatch.setattr(collocations, "MERGE_ENTRIES", entries)
        got = {}
        for langs, own, at, word, n in collocations.merged_bundles(2, iter(table.to_batches(max_chunksize=size))):
            owner = np.searchsorted(at, np.arange(len(word)), side="right") - 1
            part = {(langs[int(o)].as_py(), *map(int, own[o]), int(w)): int(c) for o, w, c in zip(owner, word, n)}
            assert not part.keys() & got.keys() and len(part) == len(word)
            got |= part
        assert got == want
