from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from proseaudit.llm import queries, rollups, store


def rows(df):
    return sorted((r.source or "", r.lang or "", r.version or "", r.n_docs, r.n_tokens) for r in df.collect())


def test_batches(spark):
    def batch(*items):
        return spark.createDataFrame([(k, op, s, "en", v, 1, n, 0) for k, op, s, v, n in items], "key bigint, op string, source string, lang string, version string, n_docs bigint, n_tokens bigint, batch int")

    path = store.new_path(spark, "rollup")
    r = rollups.Rollup(spark, path)
    assert rows(r.totals()) == []
    assert r.commit(1, batch((1, "insert", "a", "x", 10), (2, "insert", "a", "x", 5), (3, "insert", None, None, 7), (3, "insert", None, None, 7), (None, "insert", "a", "x", 1), (4, None, "a", "x", 1)))
    assert rows(r.totals()) == [("", "en", "", 2, 14), ("a", "en", "x", 2, 15)]
    assert r.commit(2, batch((1, "revise", "b", "x", 11), (9, "delete", "a", "x", 0), (5, "revise", "a", "x", None), (3, "delete", None, None, None)))
    assert rows(r.totals()) == [("a", "en", "x", 2, 5), ("b", "en", "x", 1, 11)]
    assert not r.commit(2, batch((1, "delete", "b", "x", 0)))
    assert not rollups.Rollup(spark, path).commit(1, batch((1, "delete", "b", "x", 0)))
    # a batch that broke off before its delta was complete
    batch((1, "insert", "z", "x", 99)).select("key", "source", "lang", "version", "n_docs", "n_tokens").write.parquet(f"{path}/ledger/batch-3")
    assert rows(r.totals()) == [("a", "en", "x", 2, 5), ("b", "en", "x", 1, 11)]
    assert r.commit(3, batch((1, "delete", None, "x", None), (2, "insert", "a", "x", 6), (2, "delete", "a", "x", 1)))
    assert rows(r.totals()) == [("a", "en", "x", 1, 0)]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    n, docs = Counter(), Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        if r.doc_id not in toxic:
            for v, k in (("byte_bpe_50k", len(t.encode(r.text or "", add_special_tokens=False).ids)), ("words", len((r.text or "").split()))):
                n[r.source, r.lang, v] += k
                docs[r.source, r.lang, v] += 1
    assert rows(queries.op7(spark, folder)) == sorted((*k, docs[k], n[k]) for k in docs)
