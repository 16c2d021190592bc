"""Queries for sources, sinks, flattening and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import naming, visual
from proseaudit.functions import text as tx
from proseaudit.operators import flatten, protect, report, segment, suggest
from proseaudit.plans import corpus, review
from proseaudit.plans import oracle as o
from proseaudit.plans.registry import query
from proseaudit.sources import readers, schemas, sinks

LONG = lambda c: F.col(c).cast("long").alias(c)

# --- conversations as nested documents ---------------------------------------------------------------------

_TURN_SQL = (
    "turns AS (SELECT conv_id AS doc_id, turn + 1 AS page_index, role, text AS raw_text, string_split(text, chr(10)) AS l FROM conversations), "
    "els AS (SELECT doc_id, page_index, role, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS ord, unnest(l) AS text FROM turns)"
)


def _nested(spark, sf, page) -> DataFrame:
    """One row per conversation with its turns as a page array, in order."""
    t = corpus.turns(spark, sf).select("doc_id", F.struct(F.col("page_index").alias("o"), page.alias("p")).alias("x"))
    pages = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"])
    return t.groupBy("doc_id").agg(pages.alias("pages"))


def _through_files(df: DataFrame, column: str, name: str, read) -> DataFrame:
    """Write the column as a document on each line of JSON files, and read them with one of the library's readers."""
    out = sinks.shared_folder(df.sparkSession, "documents")
    df.select("doc_id", F.col(column).alias(name)).write.json(out)
    return read(df.sparkSession, out, lines=True)


def normalized(spark, sf) -> DataFrame:
    none = F.lit(None)
    item = lambda t, i: F.struct(
        t.alias("text"),
        F.struct(F.col("page_index").alias("page_or_slide_index"), F.col("role").alias("element_type"), i.alias("element_index")).alias("locator"),
        F.lit(1.0).alias("confidence"), F.lit("pptx").alias("source_type"),
    )
    page = F.struct(
        F.col("page_index").alias("index"), F.concat(F.lit("Turn "), F.col("page_index").cast("string")).alias("title"),
        F.when(F.col("role") == "assistant", F.col("raw_text")).otherwise(none).alias("notes"),
        F.concat(F.upper("role"), F.lit(" layout")).alias("layout_info"),
        F.transform(F.split("raw_text", "\n", -1), item).alias("elements"),
    )
    return _through_files(_nested(spark, sf, page), "pages", "pages", readers.normalized_documents)


@query("a01_normalized_json", f"WITH {_TURN_SQL} SELECT doc_id, page_index, ord, role AS element_type, text FROM els")
def a01(spark, sf):
    return flatten.elements(normalized(spark, sf)).select("doc_id", LONG("page_index"), LONG("ord"), "element_type", "text")


_TYPE = o.cases({"user": "title", "assistant": "content", "system": "notes"}, "role", "'other'")
_TYPE_OUT = o.cases({"user": "title", "assistant": "paragraph", "system": "notes"}, "role", "'paragraph'")


def _raw_type():
    return F.when(F.col("role") == "user", "title").when(F.col("role") == "assistant", "content").when(F.col("role") == "system", "notes").otherwise("other")


def raw_slides(spark, sf) -> DataFrame:
    item = lambda t, i: F.struct(
        t.alias("text"),
        F.struct(F.col("page_index").alias("slide_index"), _raw_type().alias("element_type"), F.lit(0).alias("element_index"), i.alias("paragraph_index"), F.lit(1).alias("bullet_level")).alias("locator"),
        F.struct(F.lit("Lato").alias("font_name"), F.lit(14.0).alias("font_size"), F.lit("#FFFFFF").alias("font_color")).alias("formatting"),
    )
    slide = F.struct(F.col("page_index").alias("slide_index"), F.transform(F.split("raw_text", "\n", -1), item).alias("content_elements"), F.lit("TITLE").alias("layout_name"))
    return _through_files(_nested(spark, sf, slide), "pages", "slides", readers.slide_documents)


@query("a02_slide_json", (
    f"WITH {_TURN_SQL} SELECT doc_id, page_index, ord, {_TYPE_OUT} AS element_type, CASE WHEN ord = 0 THEN 'top' WHEN ord <= 2 THEN 'middle' ELSE 'bottom' END AS position, "
    "'Lato' AS font_name, CAST(1 AS BIGINT) AS hierarchy_level, text FROM els"
))
def a02(spark, sf):
    e = flatten.elements(readers.from_slides(raw_slides(spark, sf)))
    return e.select("doc_id", LONG("page_index"), LONG("ord"), "element_type", "position", "fmt.font_name", F.col("fmt.hierarchy_level").cast("long").alias("hierarchy_level"), "text")


def raw_pages(spark, sf) -> DataFrame:
    item = lambda t, i: F.struct(
        t.alias("text"), F.lit(0.7).alias("confidence"),
        F.struct(F.col("page_index"), i.alias("paragraph_index"), F.when(i == 1, "heading").otherwise("paragraph").alias("element_type"), F.lit("top").alias("position")).alias("locator"),
    )
    page = F.struct(F.col("page_index"), F.transform(F.split("raw_text", "\n", -1), item).alias("elements"))
    return _through_files(_nested(spark, sf, page), "pages", "pages", readers.page_documents)


@query("a03_page_json", (
    f"WITH {_TURN_SQL} SELECT doc_id, page_index, ord, CASE WHEN ord = 1 THEN 'heading' ELSE 'paragraph' END AS element_type, 0.7::DOUBLE AS confidence, "
    "'Page size: Unknown' AS layout_info, text FROM els"
))
def a03(spark, sf):
    return flatten.elements(readers.from_pages(raw_pages(spark, sf))).select("doc_id", LONG("page_index"), LONG("ord"), "element_type", "confidence", "layout_info", "text")


@query("b14_page_title", (
    f"WITH {_TURN_SQL}, t AS (SELECT doc_id, page_index, max(text) FILTER (WHERE ord = 1) AS h, max(text) FILTER (WHERE ord = 0) AS f FROM els GROUP BY doc_id, page_index) "
    "SELECT doc_id, page_index, coalesce(h, CASE WHEN length(f) < 100 AND NOT ends_with(f, '.') THEN f END) AS title FROM t"
))
def b14(spark, sf):
    return flatten.pages(readers.from_pages(raw_pages(spark, sf))).select("doc_id", LONG("page_index"), "title")


@query("a04_shape_fallback", (
    f"WITH {_TURN_SQL}, kept AS (SELECT doc_id, page_index, ord, {o.squeeze('text')} AS t FROM els) "
    "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE count(t) FILTER (WHERE length(t) >= 3) END AS n_texts, "
    "CASE WHEN doc_id % 3 = 2 THEN '' ELSE coalesce(string_agg(t, '|' ORDER BY page_index, ord) FILTER (WHERE length(t) >= 3), '') END AS joined FROM kept GROUP BY doc_id"
))
def a04(spark, sf):
    """A third of the conversations as pages, a third as slides, a third as neither."""
    elements = F.transform(F.split("raw_text", "\n", -1), lambda t: F.struct(t.alias("text")))
    nested = _nested(spark, sf, F.struct(elements.alias("elements")))
    slides = F.transform("pages", lambda p: F.struct(p["elements"].alias("content_elements")))
    k = F.col("doc_id") % 3
    docs = nested.withColumn(
        "json",
        F.when(k == 0, F.to_json(F.struct("pages"))).when(k == 1, F.to_json(F.struct(slides.alias("slides")))).otherwise("{}"),
    )
    return readers.document_texts(docs, "json").select(
        "doc_id", F.size("texts").cast("long").alias("n_texts"), F.array_join("texts", "|").alias("joined")
    )


# --- uploads ------------------------------------------------------------------------------------------------------

_EXT_OK = "document_type IN ('.pptx', '.pdf')"


@query("a05_type_routing", f"WITH {corpus.UPLOADS_SQL} SELECT id, CASE WHEN {_EXT_OK} THEN substr(document_type, 2) END AS document_type FROM uploads")
def a05(spark, sf):
    return readers.accept_uploads(corpus.uploads(spark, sf)).select("id", "document_type")


@query("a06_size_guard", (
    f"WITH {corpus.UPLOADS_SQL} SELECT coalesce(CASE WHEN NOT {_EXT_OK} THEN 'unsupported_type' WHEN file_size_bytes > 52428800 THEN 'too_large' END, 'accepted') AS outcome, count(*) AS n FROM uploads GROUP BY 1"
))
def a06(spark, sf):
    ok, quarantine = sinks.split_uploads(readers.accept_uploads(corpus.uploads(spark, sf)))
    a = ok.groupBy(F.lit("accepted").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    q = quarantine.groupBy(F.col("reject_reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(q)


def term_json(spark, sf) -> DataFrame:
    """A protection document per part: repeats in other case, a scalar, a blank and a missing kind."""
    n, k = F.col("p_name"), F.col("p_partkey")
    json = F.concat(
        F.lit('{"protected_names": ["'), n, F.lit('", "'), F.upper(n), F.lit('", " ", "'), F.col("p_brand"), F.lit('"], "numbers": '),
        k.cast("string"), F.lit(', "ids": ["id  '), k.cast("string"), F.lit('"], "dates": null}'),
    )
    return readers.table(spark, sf, "part").select(k.alias("doc_id"), json.alias("json"))


_TERMS_SQL = (
    "terms AS (SELECT p_partkey AS doc_id, 'protected_names' AS kind, 0 AS pos, p_name AS term FROM part UNION ALL "
    "SELECT p_partkey, 'protected_names', 3, p_brand FROM part UNION ALL SELECT p_partkey, 'numbers', 0, CAST(p_partkey AS VARCHAR) FROM part "
    "UNION ALL SELECT p_partkey, 'ids', 0, concat('id ', CAST(p_partkey AS VARCHAR)) FROM part)"
)


@query("b21_protection_terms", f"WITH {_TERMS_SQL} SELECT doc_id, kind, CAST(pos AS BIGINT) AS pos, term FROM terms")
def b21(spark, sf):
    return readers.protection_terms(term_json(spark, sf), "json").select("doc_id", "kind", LONG("pos"), "term")


@query("a07_protection_cache", f"WITH {_TERMS_SQL} SELECT doc_id, count(*) AS n_terms, doc_id % 2 = 1 AS is_missing FROM terms GROUP BY doc_id")
def a07(spark, sf):
    """Save the terms of the even documents, load the cache, find the documents it lacks."""
    out = sinks.shared_folder(spark, "protection")
    terms = readers.protection_terms(term_json(spark, sf), "json")
    sinks.save_protection(terms.where("doc_id % 2 = 0"), out, buckets=8)
    cached = spark.read.parquet(out)
    missing = protect.uncached(terms.select("doc_id").distinct(), cached).select("doc_id", F.lit(True).alias("m"))
    counts = terms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"))
    return counts.join(missing, "doc_id", "left").select("doc_id", "n_terms", F.coalesce("m", F.lit(False)).alias("is_missing"))


@query("a08_template_catalogue", "SELECT DISTINCT lower(concat('Acme ', p_name, ' Template')) AS template FROM part")
def a08(spark, sf):
    """A catalogue of templates, written from the part names as JSON lines with a name column, and read back."""
    out = sinks.shared_folder(spark, "templates")
    named = readers.table(spark, sf, "part").select(F.concat(F.lit("Acme "), F.col("p_name"), F.lit(" Template")).alias("name"))
    named.select(F.lit("pptx").alias("document_type"), "name").write.json(out)
    return spark.read.schema("document_type string, name string").json(out).select(F.lower("name").alias("template")).distinct()


@query("a09_report_sink", (
    f"WITH {corpus.STORED_ISSUES_SQL} SELECT doc_id, count(*) FILTER (WHERE category IN ('grammar','word-list','tone','usage','formatting','filename')) AS total_issues, "
    "count(*) FILTER (WHERE category = 'tone') AS tone_issues FROM issues GROUP BY doc_id HAVING count(*) FILTER (WHERE category IN ('grammar','word-list','tone','usage','formatting','filename')) > 0"
))
def a09(spark, sf):
    """Nested reports written as JSON lines and read back."""
    issues = corpus.stored_issues(spark, sf).withColumn("element_index", F.lit(0)).withColumn("found_text", F.col("rule_name"))
    docs = issues.where(report.family(F.col("category")).isNotNull()).select("doc_id").distinct()
    totals, nested = report.nested_report(docs, issues, docs.withColumn("total_pages", F.lit(1)))
    out = sinks.shared_folder(spark, "reports")
    sinks.write_reports(totals, f"{out}/totals")
    sinks.write_reports(nested, f"{out}/issues")
    items = spark.read.schema("doc_id long, issues_by_category array<struct<family:string,issues:array<struct<severity:string>>>>").json(f"{out}/issues")
    listed = items.select("doc_id", F.explode("issues_by_category").alias("c")).where("c.family = 'tone'").groupBy("doc_id").agg(F.sum(F.size("c.issues")).alias("tone_issues"))
    totals = spark.read.schema("doc_id long, total_issues long").json(f"{out}/totals")
    return totals.join(listed, "doc_id", "left").select("doc_id", "total_issues", F.coalesce("tone_issues", F.lit(0)).alias("tone_issues"))


@query("a10_append_sink", f"WITH {corpus.STORED_ISSUES_SQL} SELECT category, 2 * count(*) AS n FROM issues GROUP BY category")
def a10(spark, sf):
    """Two appends to a partitioned table."""
    out = sinks.shared_folder(spark, "issues")
    rows = corpus.stored_issues(spark, sf)
    sinks.append_table(rows, out, ["category"])
    sinks.append_table(rows, out, ["category"])
    return spark.read.parquet(out).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("a11_relational_scan", (
    f"WITH {corpus.USERS_SQL}, {corpus.SESSIONS_SQL}, {corpus.UPLOADS_SQL}, {corpus.ANALYSES_SQL}, {corpus.STORED_ISSUES_SQL} "
    "SELECT 'users' AS name, count(*) AS n FROM users UNION ALL SELECT 'sessions', count(*) FROM sessions UNION ALL SELECT 'uploads', count(*) FROM uploads "
    "UNION ALL SELECT 'analyses', count(*) FROM analyses UNION ALL SELECT 'issues', count(*) FROM issues"
))
def a11(spark, sf):
    frames = {"users": corpus.users, "sessions": corpus.sessions, "uploads": corpus.uploads, "analyses": corpus.analyses, "issues": corpus.stored_issues}
    out = None
    for name, make in frames.items():
        row = make(spark, sf).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("a12_history", (
    f"WITH {corpus.UPLOADS_SQL}, {corpus.ANALYSES_SQL}, top AS (SELECT * FROM uploads ORDER BY uploaded_at DESC, id DESC LIMIT 10) "
    "SELECT top.id AS file_id, original_filename AS filename, processed_at, coalesce(min(total_issues), 0) AS total_issues FROM top LEFT JOIN analyses a ON a.document_id = top.id GROUP BY ALL"
))
def a12(spark, sf):
    top = corpus.uploads(spark, sf).orderBy(F.desc("uploaded_at"), F.desc("id")).limit(10)
    few = F.broadcast(top.select(F.col("id").alias("document_id")))
    a = corpus.analyses(spark, sf).join(few, "document_id", "left_semi").groupBy("document_id").agg(F.min("total_issues").alias("t"))
    return top.join(a, F.col("id") == F.col("document_id"), "left").select(
        F.col("id").alias("file_id"), F.col("original_filename").alias("filename"), "processed_at", F.coalesce("t", F.lit(0)).alias("total_issues")
    )


# --- flatten ------------------------------------------------------------------------------------------------------------

@query("b01_flatten", f"WITH {_TURN_SQL} SELECT doc_id, page_index, count(*) AS n_elements, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM els GROUP BY doc_id, page_index")
def b01(spark, sf):
    return flatten.elements(normalized(spark, sf)).groupBy("doc_id", F.col("page_index").cast("long").alias("page_index")).agg(
        F.count(F.lit(1)).alias("n_elements"), F.sum(F.length("text")).alias("n_chars")
    )


@query("b02_speaker_notes", (
    f"WITH {_TURN_SQL} SELECT doc_id, page_index, ord, role AS element_type, text FROM els UNION ALL "
    f"SELECT doc_id, page_index, CAST(len(l) AS BIGINT), 'notes', raw_text FROM turns WHERE role = 'assistant' AND {o.strip('raw_text')} <> ''"
))
def b02(spark, sf):
    docs = normalized(spark, sf)
    return flatten.with_notes(flatten.elements(docs), flatten.pages(docs), include=True).select("doc_id", LONG("page_index"), LONG("ord"), "element_type", "text")


@query("b03_slide_formatting", f"WITH {_TURN_SQL} SELECT doc_id, count(*) AS n, count(*) AS n_lato, CAST(0 AS BIGINT) AS n_bold_known FROM els GROUP BY doc_id")
def b03(spark, sf):
    e = flatten.elements(readers.from_slides(raw_slides(spark, sf)))
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("fmt.font_name") == "Lato") & (F.col("fmt.color") == "#FFFFFF")).alias("n_lato"), F.count("fmt.is_bold").alias("n_bold_known"))


@query("b04_page_formatting", f"WITH {_TURN_SQL} SELECT doc_id, count(*) AS n, count(*) AS n_unknown_format FROM els GROUP BY doc_id")
def b04(spark, sf):
    e = flatten.elements(readers.from_pages(raw_pages(spark, sf)))
    unknown = F.col("fmt.font_name").isNull() & F.col("fmt.font_size").isNull() & F.col("fmt.color").isNull()
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(unknown).alias("n_unknown_format"))


@query("b05_element_types", f"SELECT {_TYPE} AS raw_type, {_TYPE_OUT} AS element_type, count(*) AS n FROM conversations GROUP BY 1, 2")
def b05(spark, sf):
    t = corpus.turns(spark, sf).withColumn("raw_type", _raw_type())
    return t.groupBy("raw_type", visual.element_type(F.col("raw_type")).alias("element_type")).agg(F.count(F.lit(1)).alias("n"))


@query("b06_slide_position", (
    f"WITH {corpus.LINES_SQL} SELECT src, key, ord, CASE WHEN ord = 0 THEN 'top' WHEN ord <= 2 THEN 'middle' ELSE 'bottom' END AS position FROM lines"
))
def b06(spark, sf):
    return corpus.lines(spark, sf).select("src", "key", "ord", visual.slide_position(F.col("ord")).alias("position"))


# --- segmentation of whole documents ---------------------------------------------------------------------------------------

# Greedy packing as a list reduction: the state is the open piece and the finished ones.
_PACK = (
    "list_reduce(list_transform(string_split({s}, '¦'), lambda x: {{'cur': x, 'packs': []::VARCHAR[]}}), "
    "lambda acc, x: CASE WHEN acc.cur <> '' AND length(acc.cur) + length(x.cur) > 500 THEN {{'cur': x.cur, 'packs': list_append(acc.packs, trim(acc.cur))}} "
    "ELSE {{'cur': CASE WHEN acc.cur = '' THEN x.cur ELSE concat(acc.cur, ' ', x.cur) END, 'packs': acc.packs}} END)"
)


def pieces_sql(p: str) -> str:
    split = o.sub(p, f"([.!?]){o.WS}+([A-Z])", r"\1¦\2")
    packed = _PACK.format(s=split)
    g = lx.BULLET_GLYPHS
    numbers = f"string_split(regexp_replace({p}, '\\n({o.WS}*[0-9]+\\.{o.WS}+)', '¦\\1', 'g'), '¦')"
    bullets = f"string_split(regexp_replace({p}, '\\n({o.WS}*[{g}]{o.WS})', '¦\\1', 'g'), '¦')"
    return (
        f"CASE WHEN length({p}) > 1000 THEN list_append(({packed}).packs, trim(({packed}).cur)) "
        f"WHEN regexp_matches({p}, '(?m)^{o.WS}*[{g}]{o.WS}+') THEN {bullets} "
        f"WHEN regexp_matches({p}, '(?m)^{o.WS}*[0-9]+\\.{o.WS}+') THEN {numbers} ELSE [{p}] END"
    )


def elements_sql(pages: str) -> str:
    """CTEs from ``pages(doc_id, page_index, raw_text)`` to ``elements``."""
    named = " OR ".join(f"contains(lower(text), '{w}')" for w in lx.HEADING_WORDS)
    caption = " OR ".join(f"contains(lower(text), '{w}')" for w in lx.CAPTION_WORDS)
    heading = (
        "((length(text) < 100 AND NOT regexp_matches(text, '[.!?]$')) OR (length(text) < 50 AND regexp_matches(text, '\\p{Lu}') AND NOT regexp_matches(text, '\\p{Ll}')) "
        f"OR (length(text) < 80 AND regexp_matches(text, '^\\p{{Lu}}') AND ({named})))"
    )
    bullet = f"regexp_matches(text, '^{o.WS}*[{lx.BULLET_GLYPHS}]{o.WS}+')"
    number = f"regexp_matches(text, '^{o.WS}*[0-9]+\\.{o.WS}+')"
    is_caption = f"(length(text) < 100 AND ({caption}))"
    pick = lambda h, b, n, c, p: f"CASE WHEN {heading} THEN {h} WHEN {bullet} THEN {b} WHEN {number} THEN {n} WHEN {is_caption} THEN {c} ELSE {p} END"
    return (
        f"pgs AS ({pages}), paras AS (SELECT doc_id, page_index, generate_subscripts(l, 1) AS pi, unnest(l) AS p FROM "
        f"(SELECT doc_id, page_index, string_split(replace(replace(raw_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || chr(10)) AS l FROM pgs WHERE {o.strip('raw_text')} <> '')), "
        f"cut AS (SELECT doc_id, page_index, pi, {pieces_sql('p')} AS ps FROM paras), "
        "flat AS (SELECT doc_id, page_index, pi, generate_subscripts(ps, 1) AS si, unnest(ps) AS raw FROM cut), "
        "numbered AS (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY pi, si) - 1 AS element_index, count(*) OVER (PARTITION BY doc_id, page_index) AS total, "
        f"{o.strip('raw')} AS text FROM flat), "
        f"elements AS (SELECT doc_id, page_index, element_index, {pick(repr('heading'), repr('bullet'), repr('bullet'), repr('caption'), repr('paragraph'))} AS element_type, "
        f"CAST({pick('0.9', '0.95', '0.9', '0.8', '0.7')} AS DOUBLE) AS confidence, "
        "CASE WHEN total <= 1 THEN 'middle' WHEN element_index < total * 0.3::DOUBLE THEN 'top' WHEN element_index > total * 0.7::DOUBLE THEN 'bottom' ELSE 'middle' END AS position, text "
        "FROM numbered WHERE text <> '')"
    )


DOC_PAGES_SQL = "SELECT doc_id, 1 AS page_index, text AS raw_text FROM documents"
# Lines of a document as blank-line separated paragraphs with Windows line ends, every fifth line a
# bullet and every seventh numbered, so that each way of refining a paragraph occurs.
_PREFIXED = "concat(CASE WHEN ord % 5 = 1 THEN '• ' WHEN ord % 7 = 3 THEN concat(CAST(ord AS VARCHAR), '. ') ELSE '' END, text)"
_MIXED_SQL = (
    f"SELECT key AS doc_id, 1 AS page_index, CASE WHEN key % 2 = 0 THEN string_agg({_PREFIXED}, chr(13) || chr(10) || chr(13) || chr(10) ORDER BY ord) "
    f"ELSE string_agg({_PREFIXED}, chr(10) ORDER BY ord) END AS raw_text FROM lines GROUP BY src, key"
)


def mixed_pages(spark, sf) -> DataFrame:
    prefix = F.when(F.col("ord") % 5 == 1, "• ").when(F.col("ord") % 7 == 3, F.concat(F.col("ord").cast("string"), F.lit(". "))).otherwise("")
    rows = F.sort_array(F.collect_list(F.struct("ord", F.concat(prefix, F.col("text")).alias("t"))))
    texts = F.transform(rows, lambda r: r["t"])
    glued = F.when(F.col("key") % 2 == 0, F.array_join("ts", "\r\n\r\n")).otherwise(F.array_join("ts", "\n"))
    return corpus.lines(spark, sf).groupBy("src", "key").agg(texts.alias("ts")).select(F.col("key").alias("doc_id"), F.col("src"), F.lit(1).alias("page_index"), glued.alias("raw_text"))


_OUT = "doc_id, element_index, element_type, confidence, position, text"


@query("b12_document_elements", f"WITH {elements_sql(DOC_PAGES_SQL)} SELECT {_OUT} FROM elements")
def b12(spark, sf):
    """Segmentation, classification and position of every document, as its one page of text."""
    return segment.elements_from_pages(review.document_pages(corpus.documents(spark, sf))).select(
        "doc_id", LONG("element_index"), "element_type", "confidence", "position", "text"
    )


@query("b15_mixed_pages", f"WITH {corpus.LINES_SQL}, {elements_sql(_MIXED_SQL + ' HAVING src = ' + repr('doc'))} SELECT {_OUT} FROM elements")
def b15(spark, sf):
    """The same with blank-line paragraphs, bullets and numbered lines, blank pieces dropped after numbering."""
    pages = mixed_pages(spark, sf).where("src = 'doc'").drop("src")
    return segment.elements_from_pages(pages).select("doc_id", LONG("element_index"), "element_type", "confidence", "position", "text")


@query("b08_paragraph_split", (
    f"WITH {corpus.LINES_SQL}, p AS ({_MIXED_SQL}) SELECT doc_id, CAST(length(raw_text) AS BIGINT) AS n_chars, "
    "CAST(len(string_split(replace(replace(raw_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || chr(10))) AS BIGINT) AS n_paragraphs FROM p"
))
def b08(spark, sf):
    return mixed_pages(spark, sf).select(
        "doc_id", F.length("raw_text").cast("long").alias("n_chars"), F.size(segment.paragraphs(F.col("raw_text"))).cast("long").alias("n_paragraphs")
    )


_REFINE_SQL = f"WITH {corpus.LINES_SQL}, p AS (SELECT doc_id, replace(raw_text, chr(13) || chr(10) || chr(13) || chr(10), chr(10)) AS raw_text FROM ({_MIXED_SQL})), r AS (SELECT doc_id, raw_text, {pieces_sql('raw_text')} AS ps FROM p WHERE @where) SELECT doc_id, CAST(len(ps) AS BIGINT) AS n_pieces, md5(array_to_string(ps, '|')) AS digest FROM r"


def _register_refine(name, where_sql, where):
    @query(name, _REFINE_SQL.replace("@where", where_sql))
    def build(spark, sf):
        one_break = F.replace(F.col("raw_text"), F.lit("\r\n\r\n"), F.lit("\n"))
        p = mixed_pages(spark, sf).withColumn("raw_text", one_break).where(where(F.col("raw_text"))).select("doc_id", F.transform(F.array("raw_text"), segment.refine).alias("x"))
        ps = F.flatten("x")
        return p.select("doc_id", F.size(ps).cast("long").alias("n_pieces"), F.md5(F.array_join(ps, "|")).alias("digest"))


_G = lx.BULLET_GLYPHS
_register_refine("b09_refine_long", "length(raw_text) > 1000", lambda c: F.length(c) > 1000)
_register_refine("b10_refine_bullets", f"length(raw_text) <= 1000 AND regexp_matches(raw_text, '(?m)^{o.WS}*[{_G}]{o.WS}+')", lambda c: (F.length(c) <= 1000) & c.rlike(segment.BULLET_LINE))
_register_refine(
    "b11_refine_numbered", f"length(raw_text) <= 1000 AND NOT regexp_matches(raw_text, '(?m)^{o.WS}*[{_G}]{o.WS}+')",
    lambda c: (F.length(c) <= 1000) & ~c.rlike(segment.BULLET_LINE),
)


@query("b13_heading_test", (
    f"WITH {corpus.LINES_SQL} SELECT src, key, ord FROM lines WHERE (length(text) < 100 AND NOT regexp_matches(text, '[.!?]$')) OR (length(text) < 50 AND regexp_matches(text, '\\p{{Lu}}') AND NOT regexp_matches(text, '\\p{{Ll}}')) "
    "OR (length(text) < 80 AND regexp_matches(text, '^\\p{Lu}') AND (contains(lower(text), 'chapter') OR contains(lower(text), 'section') OR contains(lower(text), 'introduction') OR contains(lower(text), 'conclusion')))"
))
def b13(spark, sf):
    return corpus.lines(spark, sf).where(segment.is_heading(F.col("text"))).select("src", "key", "ord")


@query("b07_page_position", f"WITH {elements_sql(DOC_PAGES_SQL)} SELECT doc_id, position, count(*) AS n FROM elements GROUP BY doc_id, position")
def b07(spark, sf):
    return b12(spark, sf).groupBy("doc_id", "position").agg(F.count(F.lit(1)).alias("n"))


_SEP = "\n\n---PAGE BREAK---\n\n"


@query("b17_combined_text", (
    f"WITH {corpus.LINES_SQL}, t AS (SELECT src, key, ord, {o.squeeze('text')} AS s FROM lines) "
    f"SELECT src, key, count(*) AS n_texts, md5(string_agg(s, {o.lit(_SEP)} ORDER BY ord)) AS digest FROM t WHERE length(s) >= 3 GROUP BY src, key"
))
def b17(spark, sf):
    return flatten.collected_texts(corpus.lines(spark, sf), ["ord"], ["src", "key"]).select("src", "key", "n_texts", F.md5("combined").alias("digest"))


@query("b16_collected_texts", f"WITH {corpus.LINES_SQL}, t AS (SELECT src, key, ord, {o.squeeze('text')} AS s FROM lines) SELECT src, key, ord, s AS text FROM t WHERE length(s) >= 3")
def b16(spark, sf):
    return corpus.lines(spark, sf).select("src", "key", "ord", tx.squeeze("text").alias("text")).where(F.length("text") >= 3)


@query("b18_fixed_chunks", (
    "SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, substr(text, CAST(i * 20000 + 1 AS BIGINT), 20000) AS chunk FROM "
    "(SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 20000.0) AS BIGINT))) AS i FROM documents)"
))
def b18(spark, sf):
    return corpus.documents(spark, sf).select("doc_id", F.inline(segment.chunks(F.col("text"), 2000))).select("doc_id", LONG("chunk_index"), "chunk")


@query("b19_word_chunks", (
    "WITH RECURSIVE c AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, text AS rest, CAST(NULL AS VARCHAR) AS chunk FROM documents UNION ALL "
    "SELECT doc_id, i + 1, substr(rest, length(cut) + 1), cut FROM (SELECT doc_id, i, rest, CASE WHEN length(rest) <= 1500 THEN rest "
    "WHEN regexp_matches(substr(rest, 752, 749), ' ') THEN regexp_extract(substr(rest, 1, 1500), '(?s)^(.*) [^ ]*$', 1) ELSE substr(rest, 1, 1500) END AS cut FROM c WHERE rest <> '')) "
    "SELECT doc_id, i - 1 AS chunk_index, chunk FROM c WHERE i > 0"
))
def b19(spark, sf):
    """Chunks of 1500 characters cut at the last space past the middle."""
    return corpus.documents(spark, sf).select("doc_id", F.posexplode(segment.word_chunks(F.col("text"), 1500)).alias("chunk_index", "chunk")).select("doc_id", LONG("chunk_index"), "chunk")


@query("b20_ordered_dedupe", (
    f"WITH t AS (SELECT user_id, lower({o.squeeze('term')}) AS k, event_id AS pos, {o.squeeze('term')} AS term FROM (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE concat(' ', event_type, '  x ') END AS term FROM events)) "
    "SELECT user_id, k AS term_key, min(pos) AS pos, arg_min(term, pos) AS term FROM t WHERE term <> '' GROUP BY user_id, k"
))
def b20(spark, sf):
    e = readers.table(spark, sf, "events")
    term = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit("  x ")))
    return flatten.dedupe_terms(e.select("user_id", F.col("event_id").alias("pos"), term.alias("term")), ["user_id"])


@query("b22_header_rows", (
    "SELECT l_orderkey AS table_id, count(*) FILTER (WHERE l_linenumber = 1 AND l_discount > 0.05) >= max(l_linenumber) // 2 AS has_header FROM lineitem GROUP BY l_orderkey"
))
def b22(spark, sf):
    """Order lines as table cells: line 1 is row 0, bold by discount."""
    cells = readers.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row_index"), F.col("l_linenumber").alias("columns"),
        (F.col("l_discount") > 0.05).alias("is_bold"),
    )
    return flatten.header_tables(cells, ["table_id"])


_RUN_SQL = (
    "runs AS (SELECT l_orderkey AS par, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS o, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('font', CAST(l_partkey % 5 AS VARCHAR)) END AS font_name, "
    "CASE WHEN l_suppkey % 2 = 0 THEN l_quantity END AS font_size, CASE WHEN l_tax > 0.02 THEN l_discount > 0.05 END AS is_bold, CASE WHEN l_tax > 0.05 THEN l_discount > 0.02 END AS is_italic, "
    "CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN 'default' ELSE concat('theme:ACCENT_', CAST(l_partkey % 6 + 1 AS VARCHAR)) END AS color FROM lineitem)"
)


def runs(spark, sf) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return readers.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("par"), (F.col("l_linenumber").cast("long") * 1000000000 + p * 10000 + s).alias("run_index"),
        F.when(p % 3 != 0, F.concat(F.lit("font"), (p % 5).cast("string"))).alias("font_name"),
        F.when(s % 2 == 0, F.col("l_quantity")).alias("font_size"),
        F.when(F.col("l_tax") > 0.02, F.col("l_discount") > 0.05).alias("is_bold"),
        F.when(F.col("l_tax") > 0.05, F.col("l_discount") > 0.02).alias("is_italic"),
        F.lit(None).cast("boolean").alias("is_underline"),
        F.when(p % 4 == 1, "default").when(p % 4 > 1, F.concat(F.lit("theme:ACCENT_"), (p % 6 + 1).cast("string"))).alias("color"),
    )


_ROLLED = (
    f"WITH {_RUN_SQL}, rolled AS (SELECT par, arg_min(font_name, o) FILTER (WHERE font_name IS NOT NULL) AS font_name, arg_min(font_size, o) FILTER (WHERE font_size IS NOT NULL) AS font_size, "
    "bool_or(is_bold) AS is_bold, bool_or(is_italic) AS is_italic, arg_min(color, o) FILTER (WHERE color <> 'default') AS color FROM runs GROUP BY par) "
)


@query("b23_run_rollup", f"{_ROLLED} SELECT * FROM rolled")
def b23(spark, sf):
    return flatten.paragraph_format(runs(spark, sf), ["par"]).drop("is_underline")


@query("b24_theme_colours", (
    f"{_ROLLED} SELECT par, color, CASE WHEN color IS NOT NULL AND par % 25 = n_nationkey THEN printf('#%02X%02X%02X', n_nationkey, n_regionkey, CAST(right(color, 1) AS INTEGER)) END AS rgb "
    "FROM rolled LEFT JOIN nation ON par % 25 = n_nationkey"
))
def b24(spark, sf):
    """Colours of the rolled-up paragraphs against 25 themes of six accents each."""
    paragraphs = flatten.paragraph_format(runs(spark, sf), ["par"]).withColumn("doc_id", F.col("par") % 25)
    n = readers.table(spark, sf, "nation")
    slots = F.explode(F.array(*[F.struct(F.lit(f"accent{i}").alias("slot"), F.lit(i).alias("i")) for i in range(1, 7)])).alias("s")
    themes = n.select("n_nationkey", "n_regionkey", slots).select(
        F.col("n_nationkey").cast("long").alias("doc_id"), "s.slot", visual.rgb_hex(F.col("n_nationkey"), F.col("n_regionkey"), F.col("s.i")).alias("rgb")
    )
    return flatten.resolve_theme_colours(paragraphs, themes).select("par", "color", "rgb")


@query("b25_rgb_hex", "SELECT p_partkey, printf('#%02X%02X%02X', p_partkey % 256, p_size, CAST(floor(p_retailprice) AS BIGINT) % 256) AS hex, printf('#%06X', p_partkey) AS int_hex FROM part")
def b25(spark, sf):
    k = F.col("p_partkey")
    return readers.table(spark, sf, "part").select(
        "p_partkey", visual.rgb_hex(k % 256, F.col("p_size"), F.floor("p_retailprice").cast("long") % 256).alias("hex"), visual.rgb_int_hex(k).alias("int_hex")
    )


@query("b26_layouts", "SELECT user_id AS doc_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS layouts FROM events GROUP BY user_id")
def b26(spark, sf):
    pages = readers.table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("layout_info"))
    return flatten.layouts(pages).select("doc_id", F.array_join("layouts", ",").alias("layouts"))


_STEM = "regexp_replace(original_filename, '([^.])\\.[^.]+$', '\\1')"
_CLEAN = f"substr(replace(trim(regexp_replace({_STEM}, '[^\\p{{L}}\\p{{N}} \\-_]', '', 'g')), ' ', '_'), 1, 50)"


@query("b27_storage_name", (
    f"WITH {corpus.UPLOADS_SQL} SELECT id, concat(CASE WHEN id >= 1000 THEN CAST(id AS VARCHAR) ELSE lpad(CAST(id AS VARCHAR), 3, '0') END, '_', {_CLEAN}, document_type) AS storage_name FROM uploads"
))
def b27(spark, sf):
    return corpus.uploads(spark, sf).select("id", naming.storage_name(F.col("original_filename"), F.col("id")).alias("storage_name"))


@query("b28_next_ids", (
    f"WITH {corpus.UPLOADS_SQL}, done AS (SELECT coalesce(max(id), 0) AS top FROM uploads WHERE processed_at IS NOT NULL) "
    "SELECT id, top + row_number() OVER (ORDER BY id) AS next_id FROM uploads, done WHERE processed_at IS NULL"
))
def b28(spark, sf):
    """Numbers for the unprocessed uploads, after the highest processed one."""
    up = corpus.uploads(spark, sf)
    top = up.where("processed_at is not null").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    placed = suggest.number_lines(up.where("processed_at is null").select("id"), [], ["id"], 1 << 62)
    return placed.select("id", (F.lit(top) + F.col("line")).alias("next_id"))


@query("b29_location", f"WITH {_TURN_SQL} SELECT doc_id, page_index, ord, concat('slide ', CAST(page_index AS VARCHAR), ' - element ', CAST(ord AS VARCHAR)) AS location FROM els")
def b29(spark, sf):
    return flatten.elements(normalized(spark, sf)).select("doc_id", LONG("page_index"), LONG("ord"), flatten.location(F.col("page_index"), F.col("ord")).alias("location"))


@query("b30_metadata", (
    f"WITH {corpus.UPLOADS_SQL} SELECT id AS doc_id, concat('/in/', original_filename) AS file_path, CASE WHEN id % 2 = 0 THEN original_filename END AS original_filename, "
    "CASE WHEN id % 3 = 0 THEN CAST(id % 10 + 1 AS BIGINT) ELSE CAST(7 AS BIGINT) END AS total_pages FROM uploads"
))
def b30(spark, sf):
    k = F.col("id")
    none = F.lit(None).cast("string")
    docs = corpus.uploads(spark, sf).select(
        k.alias("doc_id"), F.when(k % 2 == 0, F.col("original_filename")).alias("name"), F.col("document_type"),
        F.struct(
            F.concat(F.lit("/in/"), F.col("original_filename")).alias("file_path"), none.alias("title"), none.alias("author"), none.alias("creator"),
            none.alias("creation_date"), F.when(k % 3 == 0, k % 10 + 1).when(k % 3 == 1, F.lit(0)).cast("int").alias("total_pages"),
        ).alias("metadata"),
        F.struct(F.lit(7).alias("total_pages")).alias("extraction_info"), none.alias("normalized_at"),
    )
    return flatten.metadata(docs, original="name").select("doc_id", "file_path", "original_filename", F.col("total_pages").cast("long").alias("total_pages"))


@query("b31_megabytes", f"WITH {corpus.UPLOADS_SQL} SELECT id, CASE WHEN file_size_bytes > 0 THEN round(file_size_bytes / 1048576.0::DOUBLE, 2) ELSE 0.0 END AS size_mb FROM uploads")
def b31(spark, sf):
    from proseaudit.operators import fleet

    return corpus.uploads(spark, sf).select("id", fleet.megabytes(F.col("file_size_bytes")).alias("size_mb"))


