"""Reports, the golden score, fleet operators, streams, and the registry."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from proseaudit.operators import fleet, protect, report, score, suggest
from proseaudit.plans import corpus, review
from proseaudit.plans.registry import QUERIES
from proseaudit.sources import schemas, sinks
from proseaudit.streaming import progress
from proseaudit.streaming import review as live

SF = "/root/testdata/sf0.001"


def issue_rows(spark, counts, doc=1):
    rows = [(doc, c) for c, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "doc_id int, category string")


def test_golden_score(spark):
    issues = issue_rows(spark, {"grammar": 16, "word-list": 2, "tone": 24, "filename": 1}).unionByName(issue_rows(spark, {"mystery": 5}, 3))
    docs = spark.createDataFrame([(1, 33), (2, 5), (3, 1)], "doc_id int, total_pages int")
    counts = score.category_counts(issues)
    got = {r.doc_id: r for r in score.quality_scores(docs, counts).collect()}
    a = got[1]
    assert (a.overall_score, a.grade, a.status, a.issues_per_page, a.complexity) == (83.5, "B", "Good", 1.3, 1.13)
    assert (a.score_grammar, a.score_word_list, a.score_tone, a.score_filename) == (81.9, 97.7, 72.9, 98.9)
    assert (got[2].overall_score, got[2].grade) == (100.0, "A") and got[3].overall_score == 100.0
    d = {r.category: r.weight for r in score.deductions(docs, counts).where("doc_id = 1").collect()}
    assert d == {"grammar": 30.77, "word-list": 15.38, "tone": 38.46, "filename": 15.38}
    simple = spark.range(1).select(score.simple_score(F.lit(43)).alias("s")).first().s
    assert abs(simple - 95.7) < 1e-9


def test_report_totals_agree(spark):
    issues = corpus.stored_issues(spark, SF)
    b = report.breakdowns(issues, ["doc_id"]).groupBy("dimension").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in b} == {issues.count()}
    maps = report.breakdown_maps(issues, ["doc_id"]).limit(5).collect()
    assert all(sum(r.severity_breakdown.values()) == sum(r.category_breakdown.values()) == sum(r.rule_breakdown.values()) for r in maps)


def test_documents_without_issues_keep_their_score(spark):
    docs = corpus.documents(spark, SF)
    scores = review.worst_documents(docs)
    assert scores.count() == docs.count() and scores.where("total_issues = 0 and overall_score <> 100").count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([("a", "m", "n", "user", 1, None, False)], "oid string, email string, display_name string, role string, created_at int, last_login int, is_active boolean")
    new = spark.createDataFrame([("a", "m2", "n2", "admin", 5), ("b", "x", "y", "user", 6)], "oid string, email string, display_name string, role string, ts int")
    got = {r.oid: (r.email, r.role, r.created_at, r.last_login, r.is_active) for r in fleet.upsert_users(old, new).collect()}
    assert got == {"a": ("m2", "admin", 1, 5, True), "b": ("x", "user", 6, None, True)}


def test_line_numbers_with_one_hot_queue(spark):
    items = spark.range(1000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("q"), (F.col("id") * 3).alias("o"))
    rows = suggest.number_lines(items, ["q"], ["o"], 7).collect()
    for q in ("small", "hot"):
        mine = sorted((r.o, r.batch, r.line) for r in rows if r.q == q)
        assert [(b, n) for _, b, n in mine] == [(i // 7, i % 7 + 1) for i in range(len(mine))]


def test_line_numbers_are_long_and_deal_one_queue_out(spark):
    items = spark.range(40_000).select((F.col("id") * 1_000_003).alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one part
    placed = suggest.number_lines(items, [], ["o"], 1 << 40)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dict(placed.dtypes)["line"] == "bigint" and placed.agg(F.max("line")).first()[0] == 40_000
    table = spark.read.parquet(placed.inputFiles()[0].rsplit("/", 1)[0])
    assert table.groupBy("_part").count().agg(F.max("count")).first()[0] <= 20_000


def test_a_long_list_is_dealt_out(spark):
    issues = spark.range(20_000).select(
        F.lit(1).alias("doc_id"), F.lit("tone").alias("category"), F.lit("active_voice").alias("rule_name"), F.lit("info").alias("severity"), F.col("id").alias("page_index"),
        F.lit(0).alias("element_index"), F.lit("t").alias("found_text"), F.lit(None).cast("string").alias("suggestion"))
    lists = report.by_rule_lists(issues)
    sizes = [r.n for r in lists.select(F.size("issues").alias("n")).collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 8 and max(sizes) < 4_000
    assert "part" in re.search(r"Exchange hashpartitioning\(([^)]*)", lists._jdf.queryExecution().executedPlan().toString())[1]
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    totals, nested = report.nested_report(docs, issues, docs.withColumn("total_pages", F.lit(1)))
    assert {r.doc_id: r.total_issues for r in totals.collect()} == {1: 20_000, 2: 0} and nested.count() == 8


def test_all_terms_are_found(spark):
    terms = spark.createDataFrame([(1, "names", i, f"term{i:04d}") for i in range(400)], "doc_id int, kind string, pos int, term string")
    texts = spark.createDataFrame([(1, " ".join(f"term{i:04d}" for i in range(0, 400, 2)))], "doc_id int, text string")
    assert protect.occurring_terms(texts, terms).count() == 200
    assert protect.occurring_terms(texts, terms, per_kind=100).count() == 50 and protect.occurring_terms(texts, terms, cap=7).count() == 7


@pytest.fixture
def late_events(spark, tmp_path):
    """Four files, one batch each: a file that comes back after a year, one whose only event is late, one whose newest event comes first."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    batches = [[("a", day(0), 10, "uploading", "m"), ("c", day(90), 100, "completed", "m")], [("b", day(200), 30, "x", "m")], [("a", day(401), 90, "y", "m"), ("c", day(5), 20, "late", "m")], [("d", day(1), 10, "uploading", "m"), ("b", day(201), 40, "x", "m")]]
    schema = "file_id string, ts timestamp, progress long, stage string, message string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return str(tmp_path / "events"), str(tmp_path)


def test_streams_over_several_batches(spark, late_events):
    events, out = late_events
    stream = live.parquet_stream(spark, events, files_per_batch=1)
    live.drain_batches(stream, progress.once_per_file(f"{out}/once"), f"{out}/once", f"{out}/c1")
    assert sorted(r.file_id for r in spark.read.parquet(f"{out}/once/batch=*").collect()) == ["a", "b", "c", "d"]
    live.drain_batches(stream, progress.partial_state, f"{out}/state", f"{out}/c2")
    batch = progress.latest_state(spark.read.parquet(events)).collect()
    merged = progress.merged_state(spark.read.parquet(f"{out}/state/batch=*")).collect()
    assert sorted(map(tuple, merged)) == sorted(map(tuple, batch)) and {r.file_id: r.stage for r in merged}["c"] == "completed"


def test_no_fallback_to_a_local_folder(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    with pytest.raises(ValueError):
        sinks.shared_folder(spark, "x")


def test_rule_projection_scans_once_and_does_not_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = review.document_issues(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)


def test_score_shuffles_small_rows_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = review.document_issues(docs).groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["doc_id", "total_pages", "total_issues", "overall_score"] and df.count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not [n for n in QUERIES if "pipeline" in n or re.match(r"op\d+_", n)]


@pytest.mark.parametrize("name", ["r01_progress_events", "r02_latest_state", "r04_log_fan_out", "r07_once_per_file"])
def test_streams_equal_their_sql(spark, name):
    import duckdb

    from tools.check import TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name].build(spark, SF)
    cur = con.execute(QUERIES[name].sql)
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def test_stream_review_equals_batch(spark):
    batch = review.document_issues(corpus.documents(spark, SF)).groupBy("doc_id", "rule_name").count()
    stream = QUERIES["r05_continuous_review"].build(spark, SF)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_full_review_covers_every_family(spark):
    rows = QUERIES["review_full"].build(spark, SF).collect()
    pages = {r.doc_id: r.n for r in spark.read.parquet(f"{SF}/conversations.parquet").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n")).collect()}
    assert {r.doc_id: r.total_pages for r in rows} == pages
    assert all(r.filename == 1 and r.total_issues == r.grammar + r.word_list + r.tone + r.usage + r.formatting + r.filename for r in rows)
    assert sum(r.formatting for r in rows) > 0


def test_full_review_with_protected_terms(spark):
    import json

    pages = [{"index": 1, "layout_info": "TITLE", "elements": [{"text": "Acme plan"}]}, {"index": 2, "elements": [{"text": "We can't ship R & D today."}, {"text": "Costs & dates don't match."}]}]
    docs = spark.createDataFrame([(1, json.dumps({"pages": pages}))], "doc_id long, json string").select("doc_id", F.from_json("json", schemas.NORMALIZED_DOCUMENT).alias("d")).select("doc_id", "d.pages")
    protected = spark.createDataFrame([(1, "can't")], "doc_id long, term string")
    files = spark.createDataFrame([(1, "plan.pptx")], "doc_id long, original_filename string")
    issues = review.full_review(docs, files, protected)
    got = {(r.rule_name, r.location) for r in issues.collect()}
    assert {("ampersand", "slide 2 - element 0"), ("contractions", "slide 2 - element 1"), ("filename-convention", "file")} <= got
    assert ("contractions", "slide 2 - element 0") not in got
    assert review.full_scores(docs, issues).first().total_pages == 2
