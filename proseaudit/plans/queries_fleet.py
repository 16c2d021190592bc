"""Queries for joins, reports, scores and fleet analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import text as tx
from proseaudit.operators import fleet, flatten, report, score
from proseaudit.plans import corpus
from proseaudit.plans import oracle as o
from proseaudit.plans.registry import query
from proseaudit.sources import readers, sinks, snapshots
from proseaudit.streaming import progress

NOW = "2024-01-20 12:00:00"
_NOW = f"TIMESTAMP '{NOW}'"
ISSUES = f"WITH {corpus.STORED_ISSUES_SQL} "
LONG = lambda c: F.col(c).cast("long").alias(c)

# --- joins -----------------------------------------------------------------------------------------------


@query("n01_session_user", (
    f"WITH {corpus.USERS_SQL}, {corpus.SESSIONS_SQL} SELECT s.id, s.user_id, coalesce(u.email, 'Unknown') AS user_email, coalesce(u.display_name, 'Unknown') AS user_name FROM sessions s LEFT JOIN users u ON s.user_id = u.id"
))
def n01(spark, sf):
    return fleet.with_user(corpus.sessions(spark, sf), corpus.users(spark, sf)).select("id", "user_id", "user_email", "user_name")


_SEV = f"coalesce({o.cases(lx.STORED_SEVERITY, chr(39).join(['coalesce(severity, ', 'medium', ')']))}, 'medium')"
_CAT = f"coalesce({o.cases(lx.STORED_CATEGORY, 'category')}, 'grammar')"


@query("n02_stored_vocabulary", f"{ISSUES} SELECT category, {_SEV} AS stored_severity, {_CAT} AS stored_category, count(*) AS n FROM issues GROUP BY ALL")
def n02(spark, sf):
    return fleet.stored_vocabulary(corpus.stored_issues(spark, sf)).groupBy("category", "stored_severity", "stored_category").agg(F.count(F.lit(1)).alias("n"))


@query("n03_uploader", f"WITH {corpus.USERS_SQL}, {corpus.UPLOADS_SQL} SELECT d.id, u.email, u.display_name FROM uploads d LEFT JOIN users u ON d.user_id = u.id")
def n03(spark, sf):
    u = corpus.users(spark, sf).select(F.col("id").alias("user_id"), "email", "display_name")
    return corpus.uploads(spark, sf).join(u, "user_id", "left").select("id", "email", "display_name")


@query("n04_first_analysis", (
    f"WITH {corpus.UPLOADS_SQL}, {corpus.ANALYSES_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id, total_issues, processing_time_seconds) AS r FROM analyses) "
    "SELECT d.id, f.id AS analysis_id, f.total_issues, f.processing_time_seconds FROM uploads d LEFT JOIN f ON f.document_id = d.id AND f.r = 1"
))
def n04(spark, sf):
    first = fleet.first_analysis(corpus.analyses(spark, sf), ["total_issues", "processing_time_seconds"]).withColumnRenamed("document_id", "id")
    return corpus.uploads(spark, sf).select("id").join(first, "id", "left")


@query("n05_children", f"WITH {corpus.UPLOADS_SQL}, {corpus.ANALYSES_SQL} SELECT d.id, count(a.id) AS n_children FROM uploads d LEFT JOIN analyses a ON a.document_id = d.id GROUP BY d.id")
def n05(spark, sf):
    return fleet.children(corpus.uploads(spark, sf).select("id"), corpus.analyses(spark, sf), "id", "document_id")


@query("n05_integrity", (
    f"WITH {corpus.USERS_SQL}, {corpus.SESSIONS_SQL}, {corpus.UPLOADS_SQL}, gone AS (SELECT id FROM users WHERE NOT is_active) "
    "SELECT 'orphan_sessions' AS what, count(*) AS n FROM sessions WHERE user_id NOT IN (SELECT id FROM users) UNION ALL "
    "SELECT 'sessions_after_cascade', count(*) FROM sessions WHERE user_id NOT IN (SELECT id FROM gone) UNION ALL "
    "SELECT 'documents_set_null', count(*) FROM uploads WHERE user_id IN (SELECT id FROM gone)"
))
def n05_integrity(spark, sf):
    """Dangling sessions; what is left of them and of the documents when inactive users are deleted."""
    users, sessions, docs = corpus.users(spark, sf), corpus.sessions(spark, sf), corpus.uploads(spark, sf)
    gone = users.where(~F.col("is_active"))
    n = F.count(F.lit(1)).alias("n")
    a = fleet.orphans(sessions, users, "user_id", "id").agg(n).select(F.lit("orphan_sessions").alias("what"), "n")
    b = fleet.cascade_delete(sessions, gone, "user_id", "id").agg(n).select(F.lit("sessions_after_cascade").alias("what"), "n")
    c = fleet.set_null_on_delete(docs, gone, "user_id", "id").where("user_id is null").agg(n).select(F.lit("documents_set_null").alias("what"), "n")
    return a.unionByName(b).unionByName(c)


@query("n08_already_processed", (
    f"WITH {corpus.UPLOADS_SQL}, {corpus.ANALYSES_SQL} SELECT CASE WHEN id IN (SELECT document_id FROM analyses WHERE total_issues > 45) THEN 'hit' ELSE 'miss' END AS state, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM uploads GROUP BY 1"
))
def n08(spark, sf):
    docs = corpus.uploads(spark, sf).select("id")
    done = corpus.analyses(spark, sf).where("total_issues > 45").select(F.col("document_id").alias("id"))
    marked = fleet.mark_processed(docs, done, "id").withColumn("state", F.when(F.col("is_processed"), "hit").otherwise("miss"))
    return marked.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query("n09_member_roles", (
    "WITH g AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS groups, count(*) AS n FROM events GROUP BY user_id) "
    "SELECT user_id, CASE WHEN list_contains(groups, 'purchase') THEN 'admin' ELSE 'user' END AS role, list_contains(groups, 'purchase') OR list_contains(groups, 'signup') AS has_access FROM g"
))
def n09(spark, sf):
    """Event types as group memberships of a user."""
    e = readers.table(spark, sf, "events").select("user_id", "event_type").distinct()
    g = e.groupBy("user_id").agg(F.collect_list("event_type").alias("groups"))
    return g.select("user_id", fleet.member_role(F.col("groups"), "purchase").alias("role"), fleet.has_access(F.col("groups"), "purchase", "signup").alias("has_access"))


# --- issue reports ------------------------------------------------------------------------------------------------

_KNOWN = ("grammar", "word-list", "tone", "usage", "formatting", "filename")
_FAMILY = "CASE WHEN category IN ('grammar', 'word-list') THEN 'grammar' WHEN category IN ('tone', 'usage', 'formatting', 'filename') THEN category END"


@query("p01_breakdowns", (
    f"{ISSUES} SELECT doc_id, 'severity' AS dimension, coalesce(severity, 'unknown') AS label, count(*) AS n FROM issues GROUP BY doc_id, 3 UNION ALL "
    "SELECT doc_id, 'category', coalesce(category, 'unknown'), count(*) FROM issues GROUP BY doc_id, 3 UNION ALL "
    "SELECT doc_id, 'rule', coalesce(rule_name, 'unknown'), count(*) FROM issues GROUP BY doc_id, 3"
))
def p01(spark, sf):
    return report.breakdowns(corpus.stored_issues(spark, sf), ["doc_id"])


@query("p02_tallies", (
    f"{ISSUES} SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE severity = '{v}') AS {v}" for v in report.SEVERITIES) + ", "
    + ", ".join(f"count(*) FILTER (WHERE category = '{v}') AS {v.replace('-', '_')}" for v in report.CATEGORIES) + " FROM issues GROUP BY doc_id"
))
def p02(spark, sf):
    return report.tallies(corpus.stored_issues(spark, sf), ["doc_id"], {"severity": report.SEVERITIES, "category": report.CATEGORIES})


_ELEMENTS_SQL = (
    "els AS (SELECT conv_id AS doc_id, turn + 1 AS page_index, role AS element_type, unnest(string_split(text, chr(10))) AS text FROM conversations)"
)


def elements(spark, sf) -> DataFrame:
    return corpus.turns(spark, sf).select("doc_id", "page_index", F.col("role").alias("element_type"), F.explode(F.split("raw_text", "\n", -1)).alias("text"))


@query("p03_content_statistics", (
    f"WITH {_ELEMENTS_SQL} SELECT doc_id, count(DISTINCT page_index) AS total_pages, count(*) AS total_elements, CAST(sum(length(text)) AS BIGINT) AS total_text_length, "
    "round(count(*)::DOUBLE / greatest(count(DISTINCT page_index), 1), 2) AS avg_elements_per_page FROM els GROUP BY doc_id"
))
def p03(spark, sf):
    return report.content_statistics(elements(spark, sf))


@query("p03_element_types", f"WITH {_ELEMENTS_SQL} SELECT doc_id, element_type, count(*) AS n FROM els GROUP BY ALL")
def p03_types(spark, sf):
    return report.element_type_counts(elements(spark, sf))


@query("p04_summary", (
    f"{ISSUES}, f AS (SELECT *, {_FAMILY} AS family FROM issues) SELECT doc_id, count(*) AS total_issues, "
    + ", ".join(f"count(*) FILTER (WHERE family = '{x}') AS {x}_issues" for x in ("grammar", "tone", "usage", "formatting", "filename"))
    + ", count(*) FILTER (WHERE suggestion <> '') AS issues_with_suggestions FROM f WHERE family IS NOT NULL GROUP BY doc_id"
))
def p04(spark, sf):
    return report.summary(corpus.stored_issues(spark, sf))


@query("p05_families", f"{ISSUES} SELECT category, {_FAMILY} AS family, count(*) AS n FROM issues WHERE {_FAMILY} IS NOT NULL GROUP BY ALL")
def p05(spark, sf):
    i = corpus.stored_issues(spark, sf).withColumn("family", report.family(F.col("category"))).where("family is not null")
    return i.groupBy("category", "family").agg(F.count(F.lit(1)).alias("n"))


@query("p06_by_rule", f"{ISSUES} SELECT doc_id, {_FAMILY} AS family, rule_name, count(*) AS n, min(coalesce(page_index, -1)) AS first_page FROM issues WHERE {_FAMILY} IS NOT NULL GROUP BY ALL")
def p06(spark, sf):
    i = corpus.stored_issues(spark, sf).withColumns({"page_index": F.coalesce("page_index", F.lit(-1)), "element_index": F.lit(0), "found_text": F.col("rule_name")})
    nested = report.by_rule_lists(i)
    return nested.groupBy("doc_id", "family", "rule_name").agg(
        F.sum(F.size("issues")).alias("n"), F.min(F.get("issues", F.lit(0))["page_index"]).alias("first_page")
    )


@query("p07_by_slide", f"{ISSUES} SELECT doc_id, coalesce(page_index, -1) AS page_index, count(*) AS n FROM issues GROUP BY ALL")
def p07(spark, sf):
    return report.by_slide(corpus.stored_issues(spark, sf))


@query("p08_top_rules", f"{ISSUES} SELECT rule_name, count(*) AS n FROM issues GROUP BY rule_name ORDER BY n DESC, rule_name LIMIT 10")
def p08(spark, sf):
    return report.top_rules(corpus.stored_issues(spark, sf))


@query("p08_top_rules_per_category", (
    f"{ISSUES}, c AS (SELECT category, rule_name, count(*) AS n FROM issues GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, rule_name) AS rank FROM c) SELECT * FROM r WHERE rank <= 10"
))
def p08_per(spark, sf):
    return report.top_rules_per(corpus.stored_issues(spark, sf), ["category"]).withColumn("rank", F.col("rank").cast("long"))


@query("p09_document_summary", (
    f"WITH {_ELEMENTS_SQL}, p AS (SELECT doc_id, page_index, count(*) FILTER (WHERE length(text) > 40) AS n FROM els GROUP BY ALL) SELECT doc_id, count(*) AS total_pages, count(*) FILTER (WHERE n > 0) AS pages_with_content, CAST(sum(n) AS BIGINT) AS total_elements FROM p GROUP BY doc_id"
))
def p09(spark, sf):
    pages = elements(spark, sf).groupBy("doc_id", "page_index").agg(F.count_if(F.length("text") > 40).alias("element_count"))
    return report.document_summary(pages)


_N = {c: f"count(*) FILTER (WHERE category = '{c}')" for c in lx.CATEGORY_WEIGHTS}


def rounded(x: str, digits: int) -> str:
    """Half-up on the shortest decimal form of the double, as Spark rounds."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def score_sql(issues: str, documents: str) -> str:
    """CTEs ``counts`` and ``scored`` from tables ``issues(doc_id, category)`` and ``documents(doc_id, total_pages)``."""
    slot = lambda c: "n_" + c.replace("-", "_")
    weights = " + ".join(f"CASE WHEN {slot(c)} > 0 THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for c, w in lx.CATEGORY_WEIGHTS.items())
    lost = lambda c: f"least({slot(c)} * 1.0::DOUBLE * factor, 100.0::DOUBLE)"
    weighted = " + ".join(
        f"CASE WHEN {slot(c)} > 0 THEN (100.0::DOUBLE - {lost(c)}) * ({w}::DOUBLE / weights * 100.0::DOUBLE / 100.0::DOUBLE) ELSE 0.0::DOUBLE END" for c, w in lx.CATEGORY_WEIGHTS.items()
    )
    detail = ", ".join(f"CASE WHEN {slot(c)} > 0 THEN {rounded(f'(100.0::DOUBLE - {lost(c)})', 1)} END AS score_{slot(c)[2:]}" for c in lx.CATEGORY_WEIGHTS)
    return (
        f"counts AS (SELECT doc_id, count(*) AS total_issues, {', '.join(f'{n} AS {slot(c)}' for c, n in _N.items())} FROM {issues} GROUP BY doc_id), "
        f"base AS (SELECT d.doc_id, d.total_pages, coalesce(total_issues, 0) AS total_issues, {', '.join(f'coalesce({slot(c)}, 0) AS {slot(c)}' for c in _N)} FROM {documents} d LEFT JOIN counts c ON c.doc_id = d.doc_id), "
        f"w AS (SELECT *, 0.0::DOUBLE + {weights} AS weights, total_issues::DOUBLE / greatest(total_pages, 1) AS per_page, 1.0::DOUBLE + total_issues::DOUBLE / greatest(total_pages, 1) * 0.1::DOUBLE AS factor FROM base), "
        f"raw AS (SELECT *, CASE WHEN weights = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE + {weighted} END AS s FROM w), "
        f"scored AS (SELECT doc_id, total_pages, total_issues, {rounded('s', 1)} AS overall_score, {bands_sql('s', 1, 'F')} AS grade, {bands_sql('s', 2, 'Poor')} AS status, {rounded('per_page', 2)} AS issues_per_page, {rounded('factor', 2)} AS complexity, {detail} FROM raw)"
    )


def bands_sql(x: str, i: int, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {b[0]} THEN '{b[i]}'" for b in lx.GRADE_BANDS) + f" ELSE '{last}' END"


_DOCS_SQL = f"WITH {corpus.STORED_ISSUES_SQL}, docs AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS total_pages FROM orders), "


def scored_documents(spark, sf) -> DataFrame:
    return readers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 4).alias("total_pages"))


@query("p10_quality_score", f"{_DOCS_SQL} {score_sql('issues', 'docs')} SELECT * FROM scored")
def p10(spark, sf):
    """Scores of all documents from their stored issues; documents without issues score 100."""
    return score.quality_scores(scored_documents(spark, sf), score.category_counts(corpus.stored_issues(spark, sf)))


_BIG_DOCS = (
    f"WITH {corpus.STORED_ISSUES_SQL.replace('issues AS', 'small AS')}, issues AS (SELECT doc_id // 20 AS doc_id, category FROM small), "
    "docs AS (SELECT DISTINCT o_orderkey // 20 AS doc_id, o_orderkey // 20 % 40 + 1 AS total_pages FROM orders), "
)


@query("p11_grades", f"{_BIG_DOCS} {score_sql('issues', 'docs')} SELECT doc_id, overall_score, grade, status FROM scored")
def p11(spark, sf):
    """Twenty orders to a document of up to forty pages, so that every grade occurs."""
    big = F.floor(F.col("doc_id") / 20).alias("doc_id")
    docs = scored_documents(spark, sf).select(big).distinct().withColumn("total_pages", F.col("doc_id") % 40 + 1)
    issues = corpus.stored_issues(spark, sf).select(big, "category")
    return score.quality_scores(docs, score.category_counts(issues)).select("doc_id", "overall_score", "grade", "status")


@query("p12_deductions", (
    f"{_DOCS_SQL} {score_sql('issues', 'docs')}, long AS (" + " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS category, n_{c.replace('-', '_')} AS issues, {w}::DOUBLE AS w, weights, factor FROM w" for c, w in lx.CATEGORY_WEIGHTS.items()
    ) + ") SELECT doc_id, category, issues, " + f"{rounded('(w / weights * 100.0::DOUBLE)', 2)} AS weight, {rounded('(-least(issues * factor, 100.0::DOUBLE))', 1)} AS deduction, {rounded('(100.0::DOUBLE - least(issues * factor, 100.0::DOUBLE))', 1)} AS category_score FROM long WHERE issues > 0"
))
def p12(spark, sf):
    return score.deductions(scored_documents(spark, sf), score.category_counts(corpus.stored_issues(spark, sf)))


@query("p13_simple_score", (
    f"{ISSUES}, t AS (SELECT doc_id, count(*) * 20 AS total FROM issues GROUP BY doc_id), s AS (SELECT *, greatest(0.0::DOUBLE, 100.0::DOUBLE - total::DOUBLE / 10) AS score FROM t) "
    "SELECT doc_id, total, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 70 THEN 'Good' ELSE 'Needs Improvement' END AS band FROM s"
))
def p13(spark, sf):
    t = corpus.stored_issues(spark, sf).groupBy("doc_id").agg((F.count(F.lit(1)) * 20).alias("total"))
    s = t.withColumn("score", score.simple_score(F.col("total")))
    return s.withColumn("band", score.simple_band(F.col("score")))


@query("p14_severity_share", (
    f"{ISSUES}, c AS (SELECT doc_id, coalesce(severity, 'unknown') AS severity, count(*) AS n FROM issues GROUP BY ALL) SELECT *, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY doc_id), 1) AS percent FROM c"
))
def p14(spark, sf):
    return report.severity_share(corpus.stored_issues(spark, sf), ["doc_id"])


@query("p15_categories", f"{ISSUES} SELECT DISTINCT category FROM issues")
def p15(spark, sf):
    return corpus.stored_issues(spark, sf).select("category").distinct()


@query("c15_findings_filter", (
    f"{ISSUES} SELECT 'both' AS which, count(*) AS n FROM issues WHERE severity = 'warning' AND category = 'tone' UNION ALL SELECT 'severity', count(*) FROM issues WHERE severity = 'warning' UNION ALL SELECT 'all', count(*) FROM issues"
))
def c15(spark, sf):
    i = corpus.stored_issues(spark, sf)
    cases = {"both": ("warning", "tone"), "severity": ("warning", "all"), "all": ("all", "all")}
    counts = i.agg(*[F.count_if(report.finding_filter(*c)).alias(w) for w, c in cases.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(w).alias("which"), F.col(w).alias("n")) for w in cases])))


@query("s16_found_text_display", f"WITH {corpus.LINES_SQL} SELECT src, key, ord, CASE WHEN length(text) > 80 THEN concat(substr(text, 1, 80), '...') ELSE text END AS shown FROM lines")
def s16(spark, sf):
    """Text as a findings table shows it."""
    return corpus.lines(spark, sf).select("src", "key", "ord", tx.ellipsis("text").alias("shown"))


@query("p22_union_of_families", (
    f"{ISSUES} SELECT {_FAMILY} AS family, count(*) AS n, count(score) AS n_scored FROM (SELECT *, CASE WHEN category = 'tone' THEN 1.0 END AS score FROM issues) WHERE {_FAMILY} IS NOT NULL GROUP BY 1"
))
def p22(spark, sf):
    """All families in one table, in one pass; a column that only one family has is null for the others."""
    i = corpus.stored_issues(spark, sf).withColumn("family", report.family(F.col("category"))).where("family is not null")
    out = i.withColumn("score", F.when(F.col("family") == "tone", 1.0))
    return out.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"))


@query("p23_distinct_terms", "SELECT user_id, event_type AS term_key, min(event_id) AS pos, arg_min(event_type, event_id) AS term FROM events GROUP BY user_id, event_type")
def p23(spark, sf):
    e = readers.table(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("term"))
    return flatten.dedupe_terms(e, ["user_id"])


@query("p24_longest_terms", "SELECT p_name AS term FROM part GROUP BY p_name ORDER BY length(p_name) DESC, p_name")
def p24(spark, sf):
    return readers.table(spark, sf, "part").select(F.col("p_name").alias("term")).distinct().orderBy(F.length("term").desc(), "term")


# --- fleet -----------------------------------------------------------------------------------------------------------------

@query("p16_overview", (
    f"WITH {corpus.USERS_SQL}, {corpus.SESSIONS_SQL}, {corpus.UPLOADS_SQL}, {corpus.ANALYSES_SQL} SELECT * FROM (SELECT count(*) AS users_total, count(*) FILTER (WHERE is_active) AS users_active, count(*) FILTER (WHERE NOT is_active) AS users_inactive, "
    f"count(*) FILTER (WHERE role = 'admin') AS admins, count(*) FILTER (WHERE role = 'user') AS regular_users, count(*) FILTER (WHERE last_login >= {_NOW} - INTERVAL 24 HOUR) AS logins_24h, count(*) FILTER (WHERE last_login >= {_NOW} - INTERVAL 7 DAY) AS logins_7d FROM users), "
    f"(SELECT count(*) FILTER (WHERE expires_at > {_NOW}) AS sessions_active FROM sessions), (SELECT count(*) AS documents_total, count(processed_at) AS documents_processed, count(*) - count(processed_at) AS documents_pending FROM uploads), "
    "(SELECT count(*) AS analyses_total, CAST(sum(total_issues) AS BIGINT) AS issues_total FROM analyses)"
))
def p16(spark, sf):
    return fleet.overview(corpus.users(spark, sf), corpus.sessions(spark, sf), corpus.uploads(spark, sf), corpus.analyses(spark, sf), NOW)


@query("p17_user_page", (
    f"WITH {corpus.USERS_SQL} SELECT *, (SELECT count(*) FROM users) AS total FROM (SELECT * FROM users ORDER BY last_login DESC NULLS LAST, id LIMIT 100 OFFSET 40)"
))
def p17(spark, sf):
    return fleet.user_page(corpus.users(spark, sf), 100, 40)


@query("p18_recent_logins", f"WITH {corpus.USERS_SQL} SELECT id, email, display_name, role, last_login, is_active FROM users ORDER BY last_login DESC NULLS LAST, id LIMIT 20")
def p18(spark, sf):
    return fleet.recent_logins(corpus.users(spark, sf))


@query("p19_active_sessions", (
    f"WITH {corpus.USERS_SQL}, {corpus.SESSIONS_SQL}, top AS (SELECT * FROM sessions WHERE expires_at > {_NOW} ORDER BY created_at DESC, id LIMIT 50) "
    "SELECT top.id AS session_id, coalesce(email, 'Unknown') AS user_email, coalesce(display_name, 'Unknown') AS user_name, created_at, expires_at, ip_address, substr(user_agent, 1, 100) AS user_agent FROM top LEFT JOIN users u ON u.id = top.user_id"
))
def p19(spark, sf):
    return fleet.active_sessions(corpus.sessions(spark, sf), corpus.users(spark, sf), NOW)


@query("p20_recent_documents", (
    f"WITH {corpus.USERS_SQL}, {corpus.UPLOADS_SQL}, {corpus.ANALYSES_SQL}, top AS (SELECT * FROM uploads ORDER BY uploaded_at DESC, id DESC LIMIT 50), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id, total_issues, grammar_issues, tone_issues, processing_time_seconds) AS r FROM analyses) "
    "SELECT top.id, original_filename, document_type, file_size_bytes AS size_bytes, round(file_size_bytes / 1048576.0::DOUBLE, 2) AS size_mb, uploaded_at, processed_at, processed_at IS NOT NULL AS is_processed, email AS uploader_email, display_name AS uploader_name, "
    "total_issues, grammar_issues, tone_issues, processing_time_seconds FROM top LEFT JOIN users u ON u.id = top.user_id LEFT JOIN f ON f.document_id = top.id AND r = 1"
))
def p20(spark, sf):
    return fleet.recent_documents(corpus.uploads(spark, sf), corpus.users(spark, sf), corpus.analyses(spark, sf))


@query("p21_history", (
    f"WITH {corpus.UPLOADS_SQL} SELECT id AS file_id, original_filename AS filename, processed_at FROM uploads WHERE processed_at IS NOT NULL ORDER BY processed_at DESC, id DESC LIMIT 10"
))
def p21(spark, sf):
    done = corpus.uploads(spark, sf).where("processed_at is not null").orderBy(F.desc("processed_at"), F.desc("id")).limit(10)
    return done.select(F.col("id").alias("file_id"), F.col("original_filename").alias("filename"), "processed_at")


_LOGIN_SQL = "logins AS (SELECT user_id * 11 AS oid, concat(event_type, '@example.org') AS email, props AS display_name, CASE WHEN value > 20 THEN 'admin' ELSE 'user' END AS role, ts FROM events)"


@query("p25_user_upsert", (
    f"WITH {corpus.USERS_SQL}, {_LOGIN_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY ts DESC, email DESC, display_name DESC, role DESC) AS r, min(ts) OVER (PARTITION BY oid) AS first_ts, count(*) OVER (PARTITION BY oid) AS n FROM logins), "
    "n AS (SELECT * FROM l WHERE r = 1), e AS (SELECT id AS oid, email, display_name, role, TIMESTAMP '2020-01-01 00:00:00' AS created_at, last_login, is_active FROM users) "
    "SELECT coalesce(e.oid, n.oid) AS oid, coalesce(n.email, e.email) AS email, coalesce(n.display_name, e.display_name) AS display_name, coalesce(n.role, e.role) AS role, coalesce(e.created_at, n.first_ts) AS created_at, "
    "coalesce(CASE WHEN e.created_at IS NOT NULL OR n.n > 1 THEN n.ts END, e.last_login) AS last_login, CASE WHEN n.oid IS NOT NULL THEN TRUE ELSE e.is_active END AS is_active FROM e FULL JOIN n ON e.oid = n.oid"
))
def p25(spark, sf):
    existing = corpus.users(spark, sf).select(F.col("id").alias("oid"), "email", "display_name", "role", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"), "last_login", "is_active")
    e = readers.table(spark, sf, "events")
    logins = e.select((F.col("user_id") * 11).alias("oid"), F.concat("event_type", F.lit("@example.org")).alias("email"), F.col("props").alias("display_name"), F.when(F.col("value") > 20, "admin").otherwise("user").alias("role"), "ts")
    table = snapshots.Snapshot(spark, sinks.shared_folder(spark, "users"), ["oid"], 16)
    table.apply(0, existing, fleet.upsert_users)
    for _ in range(2):  # a change set that is sent again counts once
        table.apply(1, logins, fleet.upsert_users)
    return table.read()


@query("p26_status_changes", (
    f"WITH {corpus.USERS_SQL}, ch AS (SELECT user_id * 11 AS id, bool_and(event_type <> 'error') AS new FROM events GROUP BY user_id) "
    "SELECT u.id, coalesce(CASE WHEN u.id <> 22 OR new THEN new END, is_active) AS is_active FROM users u LEFT JOIN ch ON ch.id = u.id"
))
def p26(spark, sf):
    """Users with an error event are switched off, the others with events on; user 22 is the actor."""
    changes = readers.table(spark, sf, "events").select((F.col("user_id") * 11).alias("id"), (F.col("event_type") != "error").alias("is_active"))
    table = snapshots.Snapshot(spark, sinks.shared_folder(spark, "status"), ["id"], 16)
    table.apply(0, corpus.users(spark, sf).select("id", "is_active"), fleet.apply_status)
    table.apply(1, changes, lambda users, new: fleet.apply_status(users, new, F.lit(22)))
    return table.read()


@query("p27_session_purge", f"WITH {corpus.SESSIONS_SQL} SELECT count(*) FILTER (WHERE expires_at < {_NOW}) AS purged, count(*) FILTER (WHERE NOT expires_at < {_NOW}) AS kept FROM sessions")
def p27(spark, sf):
    return fleet.purge_count(corpus.sessions(spark, sf), NOW)


@query("p27_live_sessions", f"WITH {corpus.SESSIONS_SQL} SELECT id, user_id, expires_at FROM sessions WHERE NOT expires_at < {_NOW}")
def p27_live(spark, sf):
    return fleet.live_sessions(corpus.sessions(spark, sf), NOW).select("id", "user_id", "expires_at")


_LOG_SQL = (
    "logs AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END AS level, CASE WHEN user_id % 10 = 0 THEN 'uvicorn.access.http' ELSE 'app' END AS component FROM events)"
)


def logs(spark, sf, events=None) -> DataFrame:
    e = readers.table(spark, sf, "events") if events is None else events
    t = F.col("event_type")
    return e.select(
        "event_id", "ts", F.when(t == "error", "ERROR").when(t == "view", "DEBUG").when(t == "click", "WARNING").otherwise("INFO").alias("level"),
        F.when(F.col("user_id") % 10 == 0, "uvicorn.access.http").otherwise("app").alias("component"),
    )


@query("c17_log_filter", f"WITH {_LOG_SQL} SELECT event_id, level FROM logs WHERE component <> 'uvicorn.access.http' AND level <> 'DEBUG'")
def c17(spark, sf):
    return progress.visible_logs(logs(spark, sf)).select("event_id", "level")
