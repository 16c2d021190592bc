import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proseaudit.llm import packing


def encode(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_round_trip(spark):
    odd = [None, "", " ", "  two  spaces \n\n and\ttabs ", "it's we'll 12 345, ¡qué!  x   y　z", "a" * 5000, "né " * 4000, " \u0085 \x1c b", "日本 語 の テスト 😀 ok"]
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    extra = spark.createDataFrame([(10_000 + i, t, None if i % 2 else "src0") for i, t in enumerate(odd)] * 2, "doc_id bigint, text string, source string")
    docs = given.union(extra).withColumn("queue", F.lit("clash")).withColumn("part", F.lit(1)).cache()
    rows = docs.collect()
    ids = dict(zip([r.doc_id for r in rows], encode([r.text for r in rows])))
    pieces = packing.pack(docs.repartition(5), length=512, window=8 * 512).collect()
    sequences, seen = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start:p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id])
        sequences[p.sequence_id].append((p.offset, p.length))
        seen[p.doc_id].append((p.start, p.length))
    total = sum(len(ids[r.doc_id]) for r in rows)
    assert sorted(sequences) == list(range(-(-total // 512)))
    for s, spans in sequences.items():
        spans.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0
        assert sum(n for _, n in spans) == (512 if s < max(sequences) else total - 512 * max(sequences))
    copies = 2
    for doc, spans in seen.items():
        covered = np.zeros(len(ids[doc]), int)
        for at, n in spans:
            covered[at:at + n] += 1
        assert set(covered.tolist()) == {copies if doc >= 10_000 else 1}


def test_windows_follow_targets(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 40), "ab"[i % 2]) for i in range(4000)], "doc_id bigint, text string, source string")
    pieces = packing.pack(docs.repartition(7), length=256, window=4096, targets={"a": 0.75, "b": 0.25})
    by = pieces.join(docs.select("doc_id", "source"), "doc_id").where("sequence_id < 160").groupBy((F.col("sequence_id") / 16).cast("int").alias("w")).pivot("source").sum("length").collect()
    assert len(by) == 10 and all(abs(r.a / (r.a + r.b) - 0.75) < 0.03 for r in by)


def test_digest_and_empty(spark):
    from proseaudit.llm import queries

    row = queries.op3(spark, "/root/testdata/sf0.001").orderBy("doc_id", "start").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    assert row.ids_crc32 == zlib.crc32(np.array(encode([text])[0][:row.length], "<u4").tobytes())
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert packing.pack(empty).count() == 0
