import numpy as np

import corpus_pipeline
from proseaudit.llm import mixing, store
from tests.llm.test_jaccard_join import brute as near_brute
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_packing import encode
from tests.llm.test_quality import brute as statistics_brute

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark):
    """Each stage beside a plain version of its rule on what the one before it wrote."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = store.written(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == columns or name == "packing"
        tables.append(docs)
    raw, good, lines, near, mixed = [{r.doc_id: r.text for r in t.collect()} for t in tables[:-1]]

    assert set(good) <= set(raw) and all(good[d] == raw[d] for d in good)
    for d, t in raw.items():
        n, _, _, _, repeated = statistics_brute(t)
        assert d not in good or (n >= 20 and 100 * repeated <= 30 * n)
    want = {d: t for d, t in lines_brute(sorted(good.items())).items() if t == good[d] or t.split()}
    assert lines == want
    classes = near_brute(sorted(lines.items()))
    assert near == {d: lines[d] for d in {c for c, _ in classes.values()}}
    drawn = {r.doc_id for r in mixing.mix(tables[3])[0].where("__kept").collect()}
    assert mixed == {d: near[d] for d in drawn}
    ids, order = dict(zip(mixed, encode(mixed.values()))), sorted(mixed)
    pieces = sorted(((p.doc_id, p.start, p.ids) for p in tables[-1].collect()))
    joined = {d: np.concatenate([np.frombuffer(x, "<u4") for e, _, x in pieces if e == d]).tolist() for d in order}
    assert joined == ids
