import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from proseaudit.llm import decontamination
from tests.llm.compare import against_sql


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    wanted = set()
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        wanted |= {(item, tuple(w[i:i + n])) for i in range(len(w) - n + 1) if n}
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in wanted:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i:i + len(x)]) == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(item)
        digest = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(digest.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = ["the", "of", "a", "é", "x1", "Straße", "end", "to"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(30)
    docs = [(i, text(rng.randrange(60))) for i in range(40)] + [(100 + i, text(5) + " " + passage.upper() + ", " + text(4)) for i in range(20)]
    docs += [(200, None), (201, ""), (202, " .,; "), (203, passage), (203, passage), (203, "one"), (None, passage), (204, text(20000)), (205, passage[:-2] + "..end")]
    items = [(1, passage), (2, "the of a"), (3, None), (4, ""), (5, "..."), (6, passage), (None, "x1 x1"), (7, text(11)), (7, passage + " more words"), (10, "é"), (10, "é")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(a, b, "z", 7) for a, b in docs], "doc_id bigint, text string, row string, items int").repartition(3)
    return d, spark.createDataFrame([(a, b, 1) for a, b in items], "item_id int, text string, doc_id int")


@pytest.mark.parametrize("block, part", [(1 << 22, 1 << 16), (500, 7)])
def test_brute(spark, corpus, block, part):
    d, b = frames(spark, *corpus)
    found = decontamination.find(decontamination.index(d, block), b, part_windows=part)
    got = [tuple(r) for r in decontamination.digest(found).collect()]
    assert sorted(got, key=str) == brute(*corpus)


def test_candidates_in_chunks(spark, corpus, monkeypatch):
    import numpy as np

    wanted = decontamination.Part(decontamination.windows(frames(spark, *corpus)[1]).toArrow())
    wanted.rank(np.arange(1, len(wanted.terms) + 1))
    rows = decontamination.index(frames(spark, *corpus)[0]).collect()
    blocks = [decontamination.Block(*(np.frombuffer(r[c], k) for c, k in (("first", np.int64), ("terms", np.uint64), ("lists", np.uint32), ("places", np.uint32)))) for r in rows]
    once = [sorted(x for part in b.matches(wanted, 1) for x in zip(*map(list, part))) for b in blocks]
    monkeypatch.setattr(decontamination, "CHUNK", 50)
    many = [sorted(x for part in b.matches(wanted, 1) for x in zip(*map(list, part))) for b in blocks]
    assert many == once and all(once)


def test_near_and_spans(spark):
    base = [f"w{i}" for i in range(10)]
    docs = [(1, base), (2, base[:5] + ["new"] + base[5:]), (3, base[:4] + base[5:]), (4, base[:5] + ["a", "b", "c"] + base[5:]), (5, ["z"] * 3 + base + ["z"] + base), (6, base[:9])]
    d, b = frames(spark, [(i, " ".join(w)) for i, w in docs], [(9, " ".join(base))])
    rows = {r.doc_id: r for r in decontamination.contamination(d, b, slop=2).collect()}
    assert sorted(i for i in rows if rows[i]["items"] == [9]) == [1, 5]
    assert sorted(i for i in rows if rows[i].near == [9]) == [1, 2, 5]
    assert [(s.start, s.stop) for s in rows[5].spans] == [(3, 13), (14, 24)]


def test_empty_tables(spark):
    d, b = frames(spark, [(1, "some words"), (2, None)], [(1, "some")])
    assert decontamination.contamination(d.limit(0), b).count() == 0
    assert [(r.n_words, list(r["items"])) for r in decontamination.contamination(d, b.limit(0)).orderBy("doc_id").collect()] == [(2, []), (0, [])]


def test_overlapping_spans_of_parts(spark):
    df = spark.createDataFrame([([(0, 10), (2, 5), (8, 12), (20, 21)],), ([],)], "spans array<struct<start:bigint,stop:bigint>>")
    assert [r[0] for r in df.select(decontamination.covered_words(F.col("spans"))).collect()] == [13, 0]


def test_sql(spark):
    against_sql(spark, "op11_benchmark_decontamination")
