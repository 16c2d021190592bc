import re

from proseaudit.llm import quality

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = SPACE.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    spans = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, s in enumerate(spans) if spans.count(s) > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_statistics_and_model(spark):
    cycle = "a b c d e f g h i j "
    texts = [None, "", " \n\t ", "é è ü", cycle * 4, "one line\none line\n\none line \n\n", "x\n" * 30, "#*$%& | <> ok", cycle + "z " + cycle]
    good = [" ".join(f"plain{(i * k) % 97} words" for i in range(15 + k)) for k in range(1, 60)]
    bad = [" ".join(f"JUNK{(i * k) % 89}!!$ %%" for i in range(15 + k)) for k in range(1, 60)]
    everything = texts + good + bad + ["né n " * 3 + "very long " * 20000]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(everything)], "doc_id bigint, text string, probability string, __id double")
    first = len(texts)
    labels = spark.createDataFrame(
        [(first + i, 1, 0) for i in range(0, 118, 2) if i < 59] + [(first + i, 0, 0) for i in range(59, 118, 2)] + [(None, 1, 0), (5, None, 0), (10**9, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    rows = {r.doc_id: r for r in quality.quality(docs.repartition(3), labels).collect()}
    assert len(rows) == len(everything)
    for i, t in enumerate(everything[:-1]):
        r = rows[i]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute(t), (i, t)
        assert r.base_failed == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert not (r.kept and r.base_failed)
    assert rows[len(everything) - 1].n_repeat_words >= 40000
    assert all(rows[first + i].probability > 0.5 for i in range(59))
    assert all(rows[first + i].probability < 0.5 for i in range(59, 118))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "w " * 5), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.kept for r in quality.quality(docs, none).collect()] == [False, False]
    assert quality.quality(docs.limit(0), none).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels.where("doc_id % 2 = 0")))
    held = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert len(held) > 100 and sum(r.kept == (r.quality == 1) for r in held) >= 0.95 * len(held)
