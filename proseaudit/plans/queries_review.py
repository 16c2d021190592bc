"""The review job as queries, batch and streaming, and the progress and log streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.operators import fleet, report
from proseaudit.plans import corpus, queries_fleet, review
from proseaudit.plans import oracle as o
from proseaudit.plans import queries_model as qm
from proseaudit.plans import queries_rules as qr
from proseaudit.plans.registry import query
from proseaudit.sources import readers, sinks, snapshots
from proseaudit.streaming import progress
from proseaudit.streaming import review as live

# --- all rules over the elements of all documents -------------------------------------------------------

# The rule twins are written over a table ``lines``; here it is the elements of the documents.
_ELEMENTS = (
    f"{qm.elements_sql(qm.DOC_PAGES_SQL)}, lines AS (SELECT 'doc' AS src, doc_id AS key, element_index AS ord, text FROM elements WHERE length({o.strip('text')}) >= 3)"
)


def _over_elements(sql: str) -> str:
    return sql.replace(corpus.LINES_SQL + ", ", "", 1)


_HITS = {rule: ("word-list" if rule == "word_list" else "grammar", _over_elements(sql)) for _, (rule, sql) in qr._REWRITES.items()}
_HITS["positive_language"] = ("tone", _over_elements(f"{qr._SENTS} SELECT key FROM marked WHERE {qr._NEG_CASE} AND {qr._GATE}"))
_HITS["active_voice"] = ("tone", _over_elements(f"{qr._SENTS} SELECT key FROM marked WHERE ({o.has('t', qr.PASSIVE)} OR {o.has('t', qr.HEDGING)}) AND {qr._GATE}"))
_HITS["specificity"] = ("usage", _over_elements(f"{qr.MARKED} SELECT key FROM marked WHERE {qr.SPECIFIC} AND NOT {qr.heading_like('text', 't', False)}"))
_HITS["inclusivity"] = ("usage", _over_elements(f"{qr.MARKED} SELECT key FROM marked WHERE {qr.INCLUSIVE} AND NOT {qr.heading_like('text', 't', False)}"))
_FOUND = f"{_ELEMENTS}, found AS (" + " UNION ALL ".join(
    f"SELECT key AS doc_id, '{category}' AS category, '{rule}' AS rule_name FROM ({sql})" for rule, (category, sql) in _HITS.items()
) + ")"


@query("d01_issue_counts", f"WITH {_FOUND} SELECT doc_id, category, rule_name, count(*) AS n FROM found GROUP BY ALL")
def d01(spark, sf):
    """Issues per document and rule: every rule, one scan."""
    issues = review.document_issues(corpus.documents(spark, sf))
    return issues.groupBy("doc_id", "category", "rule_name").agg(F.count(F.lit(1)).alias("n"))


_SCORED = f"WITH {_FOUND}, docs AS (SELECT doc_id, 1 AS total_pages FROM documents), {queries_fleet.score_sql('found', 'docs')}"


@query("review_scores", f"{_SCORED} SELECT doc_id, total_issues, overall_score, grade, score_tone, score_usage, score_grammar FROM scored")
def review_scores(spark, sf):
    """The flagship: score and grade of every document."""
    return review.worst_documents(corpus.documents(spark, sf)).select(
        "doc_id", "total_issues", "overall_score", "grade", "score_tone", "score_usage", "score_grammar"
    )




@query("review_actionable")
def review_actionable(spark, sf):
    """Issues that carry a real suggestion, per document and rule."""
    issues = review.review(corpus.documents(spark, sf), actionable_only=True)
    return issues.groupBy("doc_id", "rule_name", "method").agg(F.count(F.lit(1)).alias("n"))


@query("review_full")
def review_full(spark, sf):
    """Conversations as slide documents of several pages: issues of every family by document, zeros included, and the score they lead to.

    Technical terms are protected in every document, so no rewrite touches them.
    """
    docs = sinks.written(readers.from_slides(qm.raw_slides(spark, sf)), "slides")
    files = docs.select("doc_id", F.concat(F.lit("conversation "), F.col("doc_id").cast("string"), F.lit(".pptx")).alias("original_filename"))
    protected = docs.select("doc_id", F.explode(F.array(*[F.lit(t) for t in lx.TECH_TERMS])).alias("term"))
    issues = sinks.written(review.full_review(docs, files, protected), "issues")
    counts = report.tallies(issues, ["doc_id"], {"category": report.CATEGORIES})
    scores = review.full_scores(docs, issues).select("doc_id", "total_pages", "total_issues", "overall_score", "grade")
    return scores.join(counts, "doc_id", "left").fillna(0, [c for c in counts.columns if c != "doc_id"])


@query("review_score_by_label", (
    f"{_SCORED} SELECT quality, toxic, count(*) AS n_docs, CAST(sum(total_issues) AS BIGINT) AS n_issues, count(*) FILTER (WHERE grade = 'A') AS n_grade_a FROM scored JOIN labels USING (doc_id) GROUP BY quality, toxic"
))
def review_by_label(spark, sf):
    """Scores against the quality labels of the documents."""
    labels = readers.table(spark, sf, "labels")
    scored = review.worst_documents(corpus.documents(spark, sf)).select("doc_id", "total_issues", "grade")
    return scored.join(labels, "doc_id").groupBy("quality", "toxic").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("total_issues").alias("n_issues"), F.count_if(F.col("grade") == "A").alias("n_grade_a")
    )


# --- streams -------------------------------------------------------------------------------------------------

_STAGE = {"signup": "uploading", "view": "extracting", "click": "analyzing", "purchase": "completed", "error": "error"}
_STAGE_SQL = o.cases(_STAGE, "event_type")
_PERCENT_SQL = o.cases({"uploading": 10, "extracting": 30, "analyzing": 60, "completed": 100, "error": 0}, "stage")
_PROGRESS_SQL = f"p AS (SELECT event_id, user_id AS file_id, ts, {_STAGE_SQL} AS stage, props AS message FROM events), progress AS (SELECT *, CAST({_PERCENT_SQL} AS BIGINT) AS progress FROM p)"


def _progress(events: DataFrame) -> DataFrame:
    stage = F.when(F.lit(False), "")
    for k, v in _STAGE.items():
        stage = stage.when(F.col("event_type") == k, v)
    rows = events.select("event_id", F.col("user_id").alias("file_id"), F.col("ts").cast("timestamp").alias("ts"), stage.alias("stage"), F.col("props").alias("message"))
    return progress.with_progress(rows)


def _events(spark, sf) -> DataFrame:
    return live.parquet_stream(spark, f"{sf}/events.parquet")


@query("r01_progress_events", f"WITH {_PROGRESS_SQL} SELECT event_id, stage, progress FROM progress")
def r01(spark, sf):
    """Stage events with their percentage, through a stream."""
    out = sinks.shared_folder(spark, "progress")
    live.drain(_progress(_events(spark, sf)), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select("event_id", "stage", F.col("progress").cast("long").alias("progress"))


_LATEST_SQL = (
    f"WITH {_PROGRESS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, progress DESC, stage DESC, message DESC) AS r, count(*) OVER (PARTITION BY file_id) AS n_events FROM progress) "
    "SELECT file_id, ts, stage, progress, message, n_events FROM r WHERE r = 1"
)


def _latest(df: DataFrame) -> DataFrame:
    return df.select("file_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "stage", F.col("progress").cast("long").alias("progress"), "message", "n_events")


@query("r02_latest_state", _LATEST_SQL)
def r02(spark, sf):
    """Latest stage per file of a stream, in a table with one row per file."""
    out = sinks.shared_folder(spark, "latest")
    table = snapshots.Snapshot(spark, f"{out}/state", ["file_id"], 16)
    live.drain_into(_progress(_events(spark, sf)), progress.fold_state(table), f"{out}/checkpoint")
    return _latest(progress.merged_state(table.read()))


@query("r02_subscription", (
    f"WITH {_PROGRESS_SQL}, done AS (SELECT file_id, min(row(ts, event_id)) AS e FROM progress WHERE stage = 'completed' GROUP BY file_id) "
    "SELECT event_id, file_id, stage FROM progress LEFT JOIN done USING (file_id) WHERE e IS NULL OR row(ts, event_id) <= e"
))
def r02_subscription(spark, sf):
    """Events of every file up to the one that completes it."""
    return progress.until_completed(_progress(readers.table(spark, sf, "events"))).select("event_id", "file_id", "stage")


@query("r02_latest_state_batch", _LATEST_SQL)
def r02_batch(spark, sf):
    return _latest(progress.latest_state(_progress(readers.table(spark, sf, "events"))))


@query("r03_job_status", (
    f"WITH {_PROGRESS_SQL}, l AS (SELECT file_id, min(ts) AS started_at, max(ts) AS updated_at FROM progress GROUP BY file_id), s AS ({_LATEST_SQL.replace('WITH ' + _PROGRESS_SQL + ', r AS', 'WITH r AS')}) "
    "SELECT file_id, CASE WHEN stage IN ('completed', 'error') THEN stage ELSE 'processing' END AS status, started_at, updated_at FROM l JOIN s USING (file_id)"
))
def r03(spark, sf):
    st = progress.job_status(_progress(readers.table(spark, sf, "events")))
    return st.select("file_id", "status", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("r04_log_fan_out", (
    f"WITH {queries_fleet._LOG_SQL} SELECT 'all' AS sink, level, count(*) AS n FROM logs GROUP BY level UNION ALL SELECT 'visible', level, count(*) FROM logs WHERE component = 'app' AND level <> 'DEBUG' GROUP BY level"
))
def r04(spark, sf):
    """Log rows to two sinks from one stream, nothing dropped."""
    out = sinks.shared_folder(spark, "logs")
    keep_all = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/all/batch={i}")
    keep_visible = lambda df, i: progress.visible_logs(df).write.mode("overwrite").parquet(f"{out}/visible/batch={i}")
    progress.fan_out(queries_fleet.logs(spark, sf, _events(spark, sf)), [keep_all, keep_visible], f"{out}/checkpoint").awaitTermination()
    count = lambda s: spark.read.parquet(f"{out}/{s}").groupBy(F.lit(s).alias("sink"), "level").agg(F.count(F.lit(1)).alias("n"))
    return count("all").unionByName(count("visible"))


@query("r05_continuous_review", f"WITH {_FOUND} SELECT doc_id, rule_name, count(*) AS n FROM found GROUP BY ALL")
def r05(spark, sf):
    """The rule projection on a stream of documents; equals the batch job."""
    out = sinks.shared_folder(spark, "review")
    docs = live.parquet_stream(spark, f"{sf}/documents.parquet").select("doc_id", "text")
    live.drain(live.review_stream(docs), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").groupBy("doc_id", "rule_name").agg(F.count(F.lit(1)).alias("n"))


@query("r06_session_lifetime", "SELECT event_id AS id, ts + INTERVAL 24 HOUR AS expires_at, ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-20 12:00:00' AS is_live FROM events")
def r06(spark, sf):
    e = readers.table(spark, sf, "events").select(F.col("event_id").alias("id"), fleet.session_expiry(F.col("ts")).alias("expires_at"))
    return e.withColumn("is_live", F.col("expires_at") > fleet.at(queries_fleet.NOW))


_GAP = "INTERVAL 6 HOUR"


@query("r06_sessions", (
    f"WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + {_GAP} THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "n AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) "
    f"SELECT user_id, min(ts) AS started_at, max(ts) + {_GAP} AS expires_at, count(*) AS n_events FROM n GROUP BY user_id, n"
))
def r06_sessions(spark, sf):
    """Sessions of every user: each event keeps a session alive for six hours more."""
    found = fleet.session_windows(readers.table(spark, sf, "events"), "user_id", "ts", "6 hours")
    return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "expires_at")], "n_events")


@query("r07_once_per_file", "SELECT DISTINCT user_id AS file_id FROM events")
def r07(spark, sf):
    """One result per file out of a stream with many events per file."""
    out = sinks.shared_folder(spark, "once")
    once = progress.OncePerFile(spark, f"{out}/rows", f"{out}/filters")
    live.drain_into(_progress(_events(spark, sf)).select("file_id", "event_id"), once, f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select("file_id")
