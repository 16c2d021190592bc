import itertools
import random
import re

from proseaudit.llm import filter_audit
from tests.llm.compare import against_sql


def fails(doc, t, docs):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {
        "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
        "E": doc is not None and any(o is not None and o < doc and (u or "") == t for o, u, _ in docs)}


def brute(docs, labels):
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    rows = [(d, s or "", fails(d, t, docs)) for d, t, s in docs]
    out = {}
    for part in {s for _, s, _ in rows}:
        own = [(d, f) for d, s, f in rows if s == part]
        steps = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for i, x in enumerate(order):
                gone = [(d, f) for d, f in left if f[x]]
                left = [(d, f) for d, f in left if not f[x]]
                redundant = sum(f[x] for _, f in own) - len(gone)
                alone = sum(f[x] and sum(f.values()) == 1 for _, f in own)
                steps[order, i + 1] = (len(left), len(gone), redundant, alone, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
        share = {x: sum(m[1] for (order, i), m in steps.items() if order[i - 1] == x) for x in "ABCDE"}
        out |= {(part, order, i): (*m, share[order[i - 1]]) for (order, i), m in steps.items()}
    return out


def test_brute(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "BIG", "ünter", "c|d", "Word", "x"]) + str(rng.randrange(40))
    texts = [" ".join(word() for _ in range(rng.choice([3, 49, 50, 70]))) for _ in range(25)] + ["", None, " \t\n", "A" * 10, "plain " * 60, " ".join(f"w{i}" for i in range(60))]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(150)]
    docs += [(None, texts[0], "s"), (None, "only here", "t"), (7, docs[7][1], "s"), (500, "plain " * 60, "one"), (500, "plain " * 60, "one")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id bigint, text string, source string, mask int, part string").repartition(3)
    found = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()}
    assert got == brute(docs, labels)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert filter_audit.audit(d, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_more_parts_than_the_default_row_limit(spark):
    d = spark.range(4000).selectExpr("id AS doc_id", "'some text' AS text", "concat('s', id) AS source")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    with_limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    found = filter_audit.prefixes(filter_audit.cells(d, labels))
    assert found.count() == 4000 * 325
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == with_limit


def test_sql(spark):
    against_sql(spark, "op12_filter_audit")
