from pyspark.sql import functions as F

from tests.llm.compare import against_sql

from proseaudit.llm import line_dedup


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    lines = [(d, i, tuple(x for x in line.replace("\t", " ").split(" ") if x)) for d, t in docs if t is not None for i, line in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if len(x[2]) >= 5)
    gone = {(d, i) for n, (d, i, w) in enumerate(lines) if any(v == w or apart(v, w) for _, _, v in lines[:n])}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def test_brute(spark):
    base = "alpha beta gamma delta epsilon zeta"
    docs = [
        (0, None), (1, ""), (2, base + "\nshort one\n\nshort one"), (3, base), (4, base.replace("gamma", "GAMMA") + "\nkeep this line as it is"),
        (5, base + " eta\n" + base + " eta theta"), (6, "beta gamma delta epsilon zeta"), (7, "alpha\tbeta  gamma delta epsilon zeta\n\n"),
        (8, "zeta epsilon delta gamma beta alpha"), (9, "a b c d e\nb c d e a\na b d e c"), (10, "p q r s t\np q r s u\np q r v u"),
        (11, " ".join(f"w{i}" for i in range(400))), (12, " ".join(f"w{i}" for i in range(400) if i != 7)),
    ] + [(100 + i, f"item number {i} of the list") for i in range(60)]
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in docs], "doc_id bigint, text string, line string, h int").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert got == brute(docs)
    assert line_dedup.dedup(df).columns == ["doc_id", "text", "line", "h", "__line_n", "__line_removed"]
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_sql(spark):
    against_sql(spark, "op5_line_dedup")


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    plan = line_dedup.dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_plain_lines_and_words_left_out(spark):
    lines = ["a b c d e", " a b c d e", "a  b c d e ", "a\tb\x0bc\x0cd\r", "", " ", "\r", "é ü — x", "one", "a b b a"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_dedup.plain(F.col("line")).alias("p")).withColumn("n", line_dedup.count_words(F.col("p")))
    for r in df.withColumn("out", F.transform(F.when(F.col("n") > 1, F.sequence(F.lit(0), F.col("n") - 1)), lambda i: line_dedup.left_out(F.col("p"), F.col("n"), i))).collect():
        words = r.line.replace("\xa0", "x").split()
        assert (r.p, r.n) == (" ".join(words), len(words))
        assert r.out is None or list(r.out) == [" ".join(words[:i] + words[i + 1:]) for i in range(len(words))]


def test_line_that_stands_everywhere(spark):
    """One line in every document: its verdict is broadcast; a thousandth of the rows or more counts as frequent."""
    docs = [(i, "the same line stands in all texts\n" + " ".join(f"w{i}x{j}" for j in range(6))) for i in range(3000)] + [(5000, "w7x0 w7x1 w7x2 w7x3 w7x4 w7x5")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r["__line_removed"] for r in line_dedup.dedup(df).collect()}
    assert got == {i: int(i > 0) for i, _ in docs}
