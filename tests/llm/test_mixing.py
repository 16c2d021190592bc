import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from proseaudit.llm import mixing, queries, text


def test_margins_and_sample(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"longword{rng.integers(40)}" for _ in range(20 + i % 30)), ["en", "de", None][i % 3], "abc"[(i * i) % 3 if i % 5 else 2]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("topic", F.lit("clash")).withColumn("n", F.lit(1))
    kept, cells = mixing.mix(docs.repartition(6), targets={"source": {"a": 0.2, "b": 0.5, "c": 0.3}}, keep=0.3, topics=4)
    cells, kept = cells.toPandas(), kept.toPandas()
    total = cells.n.sum()
    shares = cells.groupby("source").w.sum() / total
    assert np.allclose([shares["a"], shares["b"], shares["c"]], [0.2, 0.5, 0.3], atol=1e-3)
    for margin in ("lang", "topic"):
        want = (cells.groupby(margin).n.sum() / total) ** 0.7
        assert np.allclose(cells.groupby(margin).w.sum() / total, want / want.sum(), atol=1e-3)
    assert abs((cells.n * cells.p).sum() / total - 0.3) < 1e-6 and cells.p.max() <= 1
    assert abs(kept["__kept"].mean() - kept["__p"].mean()) < 0.03
    # brute-force fitting
    w = cells.n.astype(float).copy()
    goals = {m: cells.groupby(m).w.sum() for m in mixing.MARGINS}
    for _ in range(60):
        for m in mixing.MARGINS:
            w *= cells[m].map(goals[m]) / w.groupby(cells[m]).transform("sum")
    assert np.allclose(w, cells.w, rtol=1e-3)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "", "en", "x"), (2, "some words here", "en", "x"), (2, "some words here", "en", "x")], "doc_id bigint, text string, lang string, source string")
    kept, _ = mixing.mix(docs, keep=1.0)
    got = kept.orderBy("doc_id").collect()
    assert len(got) == 4 and all(r["__kept"] for r in got if r.doc_id == 2)
    assert mixing.mix(docs.limit(0))[0].count() == 0


def test_query_brute(spark):
    """Topics, tokens, weights, probabilities and draws of the registered query, worked out one document at a time."""
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def group(word):
        return int(text.Words(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hash[0] % np.uint64(16))

    cell_of, size = {}, defaultdict(int)
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        votes = Counter(group(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode()) if len(w) >= 7)
        topic = min(votes, key=lambda t: (-votes[t], t)) if votes else 0
        cell_of[r.doc_id] = (r.source or "", r.lang or "", topic)
        size[cell_of[r.doc_id]] += len(encoder.encode(r.text or "", add_special_tokens=False).ids)
    size = {c: n for c, n in size.items() if n}
    total, weight = sum(size.values()), {c: float(n) for c, n in size.items()}

    def margin(values, m):
        out = defaultdict(float)
        for c, v in values.items():
            out[c[m]] += v
        return out

    for _ in range(300):
        for m in range(3):
            goal = {k: (n / total) ** 0.7 for k, n in margin(size, m).items()}
            now, scale = margin(weight, m), total / sum(goal.values())
            weight = {c: w * goal[c[m]] * scale / now[c[m]] for c, w in weight.items()}
    low, high = 0.0, 1e6  # the factor at which the expected tokens are six tenths of all
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(n, middle * weight[c]) for c, n in size.items()) < 0.6 * total else (low, middle)
    got = queries.op10(spark, folder).collect()
    assert len(got) == len(cell_of)
    for r in got:
        assert (r.source, r.lang, r.topic) == cell_of[r.doc_id]
        p = min(1.0, low * weight[cell_of[r.doc_id]] / size[cell_of[r.doc_id]]) if cell_of[r.doc_id] in size else 0.0
        draw = int(hashlib.md5(f"11:{r.doc_id}".encode()).hexdigest()[:12], 16) / 2**48
        assert abs(r.probability - p) < 2e-3
        assert abs(draw - p) < 2e-3 or r.kept == (draw < p)


def test_clashing_names_and_targets_out_of_reach(spark):
    docs = spark.createDataFrame([(1, "some words here", "en", "x"), (2, "other words there", "de", "y")], "doc_id bigint, text string, lang string, source string")
    kept, cells = mixing.mix(docs.selectExpr("*", "1 AS __topic", "2 AS __p", "'z' AS __source", "3 AS __lang", "4 AS __n", "5 AS __kept"), keep=1.0)
    assert [r["__source"] for r in kept.orderBy("doc_id").collect()] == ["x", "y"] and all(r["__kept"] for r in kept.collect())
    assert all(r.deviation < 1e-4 for r in cells.collect())
    with pytest.warns(UserWarning, match="off its target"):  # language and source say the same here, and their targets differ
        _, cells = mixing.mix(docs, targets={"source": {"x": 0.9, "y": 0.1}, "lang": {"en": 0.1, "de": 0.9}}, rounds=5)
    assert all(r.deviation > 0.5 for r in cells.collect())
