import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from proseaudit.llm import exchange, queries, recompression, suffixes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def covered(docs, size):
    """For (id, sequence) pairs: which items a window that also starts in a smaller id covers."""
    first = {}
    for d, s in docs:
        for i in range(len(s) - size + 1):
            key = tuple(s[i:i + size]) if isinstance(s, list) else s[i:i + size]
            first[key] = min(first.get(key, d), d)
    out = []
    for d, s in docs:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - size + 1):
            key = tuple(s[i:i + size]) if isinstance(s, list) else s[i:i + size]
            if first[key] < d:
                gone[i:i + size] = True
        out.append(gone)
    return out


def brute_words(docs):
    words = [(d, WORD.findall((t or "").encode())) for d, t in docs]
    return sorted((d, len(w), int(g.sum()), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for (d, w), g in zip(words, covered(words, 50)))


def brute_bytes(docs):
    data = [(d, (t or "").encode()) for d, t in docs]
    out = []
    for (d, b), g in zip(data, covered(data, 50)):
        runs = int((g & ~np.r_[False, g[:-1]]).sum()) if len(g) else 0
        out.append((d, len(b), int(g.sum()), runs, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return sorted(out)


def made():
    rng = random.Random(9)
    word = lambda n: " ".join(rng.choice(["the", "of", "é", f"w{rng.randrange(3000)}"]) for _ in range(n))
    passages = [word(n) for n in (49, 50, 51, 60, 90, 200)] + ["same " * 70, "a b " * 60, "x " * 25 + word(40) + " y" * 30]
    docs = []
    for _ in range(150):
        parts = [word(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split()
            lo = rng.randrange(0, max(1, len(p) // 3))
            parts += [" ".join(p[lo:]), word(rng.randrange(0, 30))]
        docs.append((rng.choice(["  ", "\n", " "])).join(parts))
    docs += [None, "", " \t ", "é" * 100, "é" * 120, "z" * 300, "z" * 49, docs[3], docs[3]]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs))


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, block string, ids int").repartition(5)


def test_words(spark):
    docs = made()
    for size in (4096, 1 << 22):
        got = recompression.dedup(frame(spark, docs), block_bytes=size).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == brute_words(docs)
    assert recompression.dedup(frame(spark, docs).limit(0)).count() == 0


def test_bytes(spark):
    docs = made()
    for size in (4096, 1 << 21):
        got = suffixes.dedup(frame(spark, docs), block_bytes=size, rounds=2).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == brute_bytes(docs)
    assert suffixes.dedup(frame(spark, docs).limit(0)).count() == 0


def test_equal_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text), (None, "short")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 9, r.n_removed) for r in recompression.dedup(docs).collect())
    assert got == [(1, 0), (1, 0), (9, 0), (9, 80), (9, 80)]
    got = sorted((r.doc_id or 9, r.n_removed) for r in suffixes.dedup(docs).collect())
    assert got == [(1, 0), (1, 0), (9, 0), (9, len(text)), (9, len(text))]


def test_cover():
    differences = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert differences == set(range(suffixes.PERIOD))


def test_queries(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op8(spark, FOLDER).collect())) == brute_words(docs)
    assert sorted(map(tuple, queries.op9(spark, FOLDER).collect())) == brute_bytes(docs)


def test_runs_beyond_two_gb():
    """Three rows of 900 MB, more than one binary array can hold; all share one buffer of untouched zeros."""
    size = 900 << 20
    ends, data = pa.py_buffer(np.array([0, size], np.int32)), pa.py_buffer(np.zeros(size, np.uint8))
    row = pa.RecordBatch.from_arrays([pa.array([7], pa.int32()), pa.Array.from_buffers(pa.binary(), 1, [None, ends, data])], ["bucket", "keys"])
    other = pa.RecordBatch.from_arrays([pa.array([8], pa.int32()), pa.array([b"x"], pa.binary())], ["bucket", "keys"])
    got = [(r.column(0)[0].as_py(), sum(x.as_buffer().size for x in r.column(1))) for r in exchange.runs(iter([row, row, row, other]))]
    assert got == [(7, 3 * size), (8, 1)]


def test_missing_reply():
    keys = exchange.Keys(np.array([0, 1, 1]), np.array([5, 6, 7], np.uint64), np.array([1, 1, 2]), 2)
    whole = [{"bucket": 0, "bits": b"\x80"}, {"bucket": 1, "bits": b"\x40"}]
    assert keys.answers(whole).tolist() == [True, False, True]
    for replies in (None, whole[:1], [whole[0], {"bucket": 1, "bits": b""}]):
        with pytest.raises(ValueError):
            keys.answers(replies)


def test_buckets_follow_the_text(spark):
    docs = made()
    total = sum(len((t or "").encode()) for _, t in docs)
    blocks = exchange.block_table(frame(spark, docs), 4096)
    assert exchange.buckets_of(blocks, 1000) == -(-total // 1000) > exchange.partitions_of(spark) == exchange.buckets_of(blocks, 1 << 24)
    got = recompression.dedup(frame(spark, docs), block_bytes=4096, bucket_bytes=1000).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == brute_words(docs)
    got = suffixes.dedup(frame(spark, docs), block_bytes=4096, bucket_bytes=1000).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == brute_bytes(docs)
