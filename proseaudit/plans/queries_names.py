"""Queries for visual formatting, file names and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import naming, visual
from proseaudit.operators import filenames, formatting, stage, templates
from proseaudit.plans import oracle as o
from proseaudit.plans.registry import query
from proseaudit.sources import readers

LONG = lambda c: F.col(c).cast("long").alias(c)

# --- slides: an order is a deck, an order line an element ---------------------------------------------------

_TEXTS = (
    "Causal Analysis Framework Overview", "March 2025", "Jane Doe", "Jane Doe, Ann Poe", "Zoe Fox and Al Ng", "notes", "x",
    "Tech Lead: Bo Li", "Manager: sam", "A slide title that goes on and on over far more than the fifteen words it may have here",
    "two\nlines of text", "plain body text of a slide",
)
_SIZES = (40.0, 22.0, 14.5, None, 17.0, 28.0, 12.0)
_FONTS = ("Lato", "Arial", None, "", "Lato")
_COLOURS = ("#FFF", "theme:LIGHT_2", "theme:DARK_1", "", "#123456", None, "theme:LIGHT_1", "#555555", "#2d86c1", "color_type:None")


def _sql_list(values) -> str:
    def one(v):
        return "NULL" if v is None else ("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if isinstance(v, str) else f"{v}::DOUBLE")
    return "[" + ", ".join(one(v) for v in values) + "]"


def _pick(values, n):
    kind = "double" if any(isinstance(v, float) for v in values) else "string"
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (n % len(values) + 1).cast("int"))


def _pick_sql(values, n: str) -> str:
    return f"{_sql_list(values)}[CAST({n} % {len(values)} + 1 AS INTEGER)]"


def slides(spark, sf) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return readers.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_rank"), F.col("l_linenumber").alias("page_index"),
        (p % 4).alias("ord"), p.alias("k"), _pick(_TEXTS, p).alias("text"),
        F.struct(_pick(_FONTS, s).alias("font_name"), _pick(_SIZES, p + s).alias("font_size"), _pick(_COLOURS, p * 3 + s).alias("color")).alias("fmt"),
        F.when(s % 4 == 0, "Title Slide").when(s % 4 == 1, "Content").alias("layout_info"),
    )


_SLIDES_SQL = (
    f"slides AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page_rank, l_linenumber AS page_index, l_partkey % 4 AS ord, l_partkey AS k, {_pick_sql(_TEXTS, 'l_partkey')} AS text, "
    f"{_pick_sql(_FONTS, 'l_suppkey')} AS font, {_pick_sql(_SIZES, '(l_partkey + l_suppkey)')} AS size, {_pick_sql(_COLOURS, '(l_partkey * 3 + l_suppkey)')} AS colour, "
    "CASE WHEN l_suppkey % 4 = 0 THEN 'Title Slide' WHEN l_suppkey % 4 = 1 THEN 'Content' END AS layout_info FROM lineitem)"
)
_COLOUR_SQL = (
    f"CASE WHEN colour IS NULL OR colour = '' THEN 'unknown' WHEN colour IN ({', '.join(o.lit(c) for c in lx.COLOUR_NAMES)}) THEN {o.cases(lx.COLOUR_NAMES, 'colour')} "
    f"WHEN starts_with(colour, '#') AND upper(colour) IN ({', '.join(o.lit(c) for c in lx.HEX_NAMES)}) THEN {o.cases(lx.HEX_NAMES, 'upper(colour)')} "
    "WHEN contains(upper(colour), 'LIGHT') OR contains(upper(colour), 'WHITE') THEN 'white' WHEN contains(upper(colour), 'TEXT') OR contains(upper(colour), 'DARK') THEN 'dark_gray' ELSE colour END"
)
_TOKENS = f"list_filter(regexp_split_to_array(trim(text), '{o.WS}+'), lambda w: w <> '')"
_NAMES_N = f"len(list_filter({_TOKENS}, lambda w: regexp_matches(w, '^\\p{{Lu}}')))"
_JOINED = "(contains(lower(text), ',') OR contains(lower(text), ' and ') OR contains(text, '&') OR contains(text, ';'))"
_MONTH_ALT = "|".join(lx.MONTHS + lx.MONTH_ABBREVIATIONS)
_ROLE_SQL = (
    "CASE WHEN length(trim(text)) < 2 THEN NULL WHEN ord <= 1 AND length(text) > 20 THEN 'Title' "
    f"WHEN regexp_matches({o.mark('lower(text)')}, '‹({_MONTH_ALT})›') OR regexp_matches({o.mark('text')}, '‹(19|20)[0-9]{{2}}›') THEN 'Month and Year' "
    "WHEN contains(lower(text), 'technical lead') OR contains(lower(text), 'tech lead') OR contains(lower(text), 'tl:') THEN 'Technical Lead' "
    f"WHEN {_NAMES_N} BETWEEN 2 AND 3 AND NOT {_JOINED} AND len({_TOKENS}) <= 4 THEN 'Technical Lead' "
    "WHEN contains(lower(text), 'project manager') OR contains(lower(text), 'pm:') OR contains(lower(text), 'lead:') OR contains(lower(text), 'manager:') THEN 'Project Manager' "
    f"WHEN {_JOINED} AND {_NAMES_N} >= 3 THEN 'Project Manager' END"
)
_ROLE_SIZE = o.cases({"Title": 40.0, "Month and Year": 14.0, "Technical Lead": 17.0, "Project Manager": 28.0}, "role")


@query("l07_colour_names", f"WITH {_SLIDES_SQL} SELECT doc_id, page_index, ord, k, {_COLOUR_SQL} AS colour FROM slides")
def l07(spark, sf):
    return slides(spark, sf).select("doc_id", LONG("page_index"), "ord", "k", visual.colour_name(F.col("fmt.color")).alias("colour"))


@query("l02_title_roles", f"WITH {_SLIDES_SQL}, r AS (SELECT doc_id, page_index, ord, k, {_ROLE_SQL} AS role FROM slides) SELECT *, CAST({_ROLE_SIZE} AS DOUBLE) AS expected FROM r WHERE role IS NOT NULL")
def l02(spark, sf):
    r = slides(spark, sf).withColumn("r", visual.title_role(F.col("text"), F.col("ord"))).where("r is not null")
    return r.select("doc_id", LONG("page_index"), "ord", "k", F.col("r.role").alias("role"), F.col("r.size").alias("expected"))


@query("l01_title_layout", f"WITH {_SLIDES_SQL} SELECT doc_id, page_index, concat('Layout: ', coalesce(layout_info, '')) AS found_text FROM slides WHERE page_rank = 0 AND NOT contains(upper(coalesce(layout_info, '')), 'TITLE')")
def l01(spark, sf):
    return formatting.layout_issues(slides(spark, sf)).select("doc_id", LONG("page_index"), "found_text")


_CHECKS = (
    f"WITH {_SLIDES_SQL}, r AS (SELECT *, {_ROLE_SQL} AS role, {_COLOUR_SQL} AS cname FROM slides), q AS (SELECT *, CAST({_ROLE_SIZE} AS DOUBLE) AS want, "
    f"page_rank = 0 AND role IS NOT NULL AS known, page_rank > 0 AND ord = 0 AS title, page_rank > 0 AND ord > 0 AND length(trim(text)) >= 10 AS body, "
    f"font <> '' AND font <> 'Lato' AS wrong_font, cname NOT IN ('white', 'unknown') AS odd FROM r), "
    "hits AS ("
)
_HITS = (
    ("title_slide_font_size", "warning", "known AND abs(size - want) > 1", "concat(text, ' (size ', CAST(size AS VARCHAR), ')')"),
    ("title_slide_font_name", "warning", "known AND wrong_font", "concat(text, ' (font: ', font, ')')"),
    ("title_slide_color", "info", "known AND odd", "concat(text, ' (color: ', cname, ')')"),
    ("slide_title_font_size", "warning", "title AND abs(size - 22.0) > 1", "concat(text, ' (size ', CAST(size AS VARCHAR), ')')"),
    ("slide_title_font_name", "warning", "title AND wrong_font", "concat(text, ' (font: ', font, ')')"),
    ("slide_title_color", "info", "title AND odd", "concat(text, ' (color: ', cname, ')')"),
    ("slide_title_single_line", "suggestion", f"title AND (contains(text, chr(10)) OR len({_TOKENS}) > 15)", "text"),
    ("body_text_font_size", "info", "body AND abs(size - 14.0) > 1", "concat(text, ' (size ', CAST(size AS VARCHAR), ')')"),
    ("body_text_font_name", "info", "body AND wrong_font", "concat(text, ' (font: ', font, ')')"),
    ("body_text_color", "warning", "body AND cname = 'white'", "concat(text, ' (color: ', cname, ')')"),
)


def _register_checks(name, prefix):
    chosen = [h for h in _HITS if h[0].startswith(prefix)]
    sql = _CHECKS + " UNION ALL ".join(
        f"SELECT doc_id, page_index, ord, '{r}' AS rule_name, '{s}' AS severity, {found} AS found_text FROM q WHERE {where}" for r, s, where, found in chosen
    ) + ") SELECT * FROM hits"

    @query(name, sql)
    def build(spark, sf):
        out = formatting.element_issues(slides(spark, sf)).where(F.col("rule_name").startswith(prefix))
        return out.select("doc_id", LONG("page_index"), "ord", "rule_name", "severity", "found_text")


_register_checks("l03_title_slide_format", "title_slide")
_register_checks("l05_slide_titles", "slide_title")
_register_checks("l06_body_text", "body_text")

_LAST = f"lower(({_TOKENS})[-1])"


@query("l04_manager_order", (
    f"WITH {_SLIDES_SQL}, r AS (SELECT *, {_ROLE_SQL} AS role FROM slides), one AS (SELECT doc_id, page_index, k AS ord, text, {_LAST} AS last FROM r WHERE role = 'Project Manager' AND page_index <= 99), "
    "g AS (SELECT doc_id, count(*) AS n, string_agg(text, ', ' ORDER BY ord, text) AS found, string_agg(text, ', ' ORDER BY last, ord, text) AS wanted FROM one GROUP BY doc_id) "
    "SELECT doc_id, found AS found_text, concat('In order: ', wanted) AS suggestion FROM g WHERE n > 1 AND found <> wanted"
))
def l04(spark, sf):
    """Every line of an order counts as an element of its title slide; the part number is the position."""
    deck = slides(spark, sf).withColumns({"_o": F.col("ord"), "page_rank": F.lit(0), "page_index": F.lit(1)})
    role = visual.title_role(F.col("text"), F.col("_o"))["role"]
    managers = deck.where(role == "Project Manager").withColumn("ord", F.col("k"))
    # positions past the first two keep the role test of the operator in step with the one above
    return formatting.manager_order_issues(managers).select("doc_id", "found_text", "suggestion")


@query("l08_font_usage", f"WITH {_SLIDES_SQL} SELECT doc_id, count(DISTINCT font) AS n_fonts, count(*) FILTER (WHERE font IS NOT NULL AND font <> 'Lato') AS n_other_font FROM slides GROUP BY doc_id")
def l08(spark, sf):
    return formatting.font_usage(slides(spark, sf))


# --- file names ------------------------------------------------------------------------------------------------

_NAMES = (
    "acme {n} -apr 5 2025 -js.pptx", "acme {n} -apr 2025 -final.pptx", "draft acme {n} -apr 4 2025 -js.pdf", "northco {n} -apr 5 2025.pdf",
    "Acme {n} -Apr 5 2025 -JS.pptx", "acme {n} may 2 2025 ab.pptx", "acme {n} -dec 15 2025 -final.pptx", "acme {n} draft -jan 8 2025 -mf.pptx",
    "acme-{n}-feb-2025-final.pptx", "acme {n} for john -apr 2025 -final.pptx", "acme report {n} v2 -jun 5 2025 -ab+ml.pptx", "{n}_final-v2.pptx",
    "acme {n} -apr 5 2025 -js -ml.pptx", "",
)


def names(spark, sf) -> DataFrame:
    p = stage.dealt_out(readers.table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    filled = F.array(*[F.concat(*[x for piece in [t.split("{n}")] for i, s in enumerate(piece) for x in ([F.col("p_name")] if i else []) + [F.lit(s)]]) for t in _NAMES])
    return p.select(F.col("p_partkey").alias("id"), F.posexplode(filled).alias("v", "name")).withColumn("v", F.col("v").cast("long"))


_NAMES_SQL = (
    "names AS (SELECT p_partkey AS id, generate_subscripts(l, 1) - 1 AS v, unnest(l) AS name FROM (SELECT p_partkey, ["
    + ", ".join("concat(" + ", p_name, ".join(o.lit(s) for s in t.split("{n}")) + ")" for t in _NAMES)
    + "] AS l FROM part)), stems AS (SELECT *, regexp_replace(name, '\\.[^.]+$', '') AS s FROM names)"
)
_DATED = r".+\s+-[a-z]{3}\s+\d{1,2}\s+\d{4}"
_CLASS_SQL = (
    f"CASE WHEN regexp_matches(s, '^acme\\s+{_DATED}\\s+-[a-z]{{2,3}}$') THEN 'working' WHEN regexp_matches(s, '^acme\\s+.+\\s+-[a-z]{{3}}\\s+\\d{{4}}\\s+-final$') THEN 'final' "
    f"WHEN regexp_matches(s, '^draft\\s+acme\\s+{_DATED}\\s+-[a-z]{{2,3}}$') THEN 'draft' WHEN regexp_matches(s, '^[a-z\\s]+{_DATED}$') THEN 'external' END"
)


@query("m01_naming_class", f"WITH {_NAMES_SQL} SELECT id, v, {_CLASS_SQL} AS name_class FROM stems WHERE s <> ''")
def m01(spark, sf):
    return names(spark, sf).where("name <> ''").select("id", "v", naming.naming_class(naming.stem(F.col("name"))).alias("name_class"))


_DEFECTS_SQL = {
    "lead_word_case": r"regexp_matches(s, '(?i)^(?:draft\s+)?acme\b') AND NOT regexp_matches(s, '^(?:[dD][rR][aA][fF][tT]\s+)?acme\b')",
    "no_hyphen_before_date": rf"regexp_matches(s, '(?i)[^-](?:\s|^)(?:{_MONTH_ALT})\s+(?:\d{{1,2}}\s+)?\d{{4}}')",
    "day_in_final": r"regexp_matches(s, '(?i)-[a-z]{3}\s+\d{1,2}\s+\d{4}\s+-final$')",
    "draft_not_first": r"regexp_matches(s, '(?i)\bdraft\b') AND NOT regexp_matches(s, '(?i)^draft\b')",
    "dash_between_words": "regexp_matches(s, '(?i)[a-z]-[a-z]')",
    "person_phrase": r"regexp_matches(s, '(?i)\b(?:for|by)\s+[a-z]+')",
    "version_text": r"regexp_matches(s, '(?i)\bv\d+\b|\bversion\b')",
    "joined_initials": r"regexp_matches(s, '(?i)-[a-z]{2,3}\+[a-z]{2,3}')",
    "initials_case": r"regexp_matches(s, '-[A-Z]{2,3}(?:\s|$)')",
}


@query("m02_naming_defects", f"WITH {_NAMES_SQL} " + " UNION ALL ".join(f"SELECT id, v, '{k}' AS defect FROM stems WHERE {w}" for k, w in _DEFECTS_SQL.items()))
def m02(spark, sf):
    return names(spark, sf).select("id", "v", F.explode(naming.naming_defects(naming.stem(F.col("name")))).alias("defect"))


_FOLDERS = ("01 - {n}", "1 - {n}", "1.1 - {n}", "01-{n}", "{n}", "00 - archive", "012 {n}")


def folders(spark, sf) -> DataFrame:
    p = stage.dealt_out(readers.table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    filled = F.array(*[F.concat(F.lit(t.partition("{n}")[0]), F.col("p_name") if "{n}" in t else F.lit("")) for t in _FOLDERS])
    return p.select(F.col("p_partkey").alias("id"), F.posexplode(filled).alias("v", "name")).withColumn("v", F.col("v").cast("long"))


_FOLDER_SQL = "CASE v WHEN 0 THEN '' WHEN 1 THEN 'one_digit_number' WHEN 2 THEN 'decimal_number' WHEN 3 THEN 'no_spaced_dash' WHEN 4 THEN 'no_number' WHEN 5 THEN '' ELSE 'malformed' END"


@query("m03_folder_names", f"WITH f AS (SELECT p_partkey AS id, unnest(range(0, {len(_FOLDERS)})) AS v FROM part) SELECT id, v, {_FOLDER_SQL} AS defects FROM f")
def m03(spark, sf):
    return folders(spark, sf).select("id", "v", F.array_join(naming.folder_defects(F.col("name")), ",").alias("defects"))


# What each spelling parses to: month, day, year, initials; the title is the part name, with one word more in v 10.
_PARTS = [
    ("apr", "5", "2025", "js"), ("apr", "", "2025", ""), ("apr", "4", "2025", "js"), ("apr", "5", "2025", ""), ("apr", "5", "2025", "js"),
    ("may", "2", "2025", "ab"), ("dec", "15", "2025", ""), ("jan", "8", "2025", "mf"), ("feb", "", "2025", ""), ("apr", "", "2025", ""),
    ("jun", "5", "2025", "ab"), ("", "", "", ""), ("apr", "5", "2025", "js"),
]


def _part(i, name):
    return "CASE v " + " ".join(f"WHEN {v} THEN {o.lit(p[i] or '[' + name + ']')}" for v, p in enumerate(_PARTS)) + " END"


_OPTIONS_SQL = (
    f"{_NAMES_SQL}, parts AS (SELECT id, v, name, s, CASE v WHEN 3 THEN concat('northco ', p_name) WHEN 10 THEN concat('report ', p_name) ELSE p_name END AS title, {_part(0, 'month')} AS mon, {_part(1, 'day')} AS d, "
    f"{_part(2, 'year')} AS y, {_part(3, 'initials')} AS ini FROM stems JOIN part ON id = p_partkey WHERE name <> ''), "
    "opts AS (SELECT *, [concat('draft acme ', title, ' -', mon, ' ', d, ' ', y, ' -', ini), concat('acme ', title, ' -', mon, ' ', d, ' ', y, ' -', ini), "
    "concat('acme ', title, ' -', mon, ' ', d, ' ', y, ' -', ini, ' -xx'), concat('acme ', title, ' -', mon, ' ', y, ' -final')] AS options FROM parts)"
)


@query("m04_name_options", f"WITH {_OPTIONS_SQL} SELECT id, v, generate_subscripts(options, 1) - 1 AS option, unnest(options) AS suggestion FROM opts")
def m04(spark, sf):
    opts = naming.name_options(naming.name_parts(F.col("name")))
    return names(spark, sf).where("name <> ''").select("id", "v", F.posexplode(opts).alias("option", "suggestion")).withColumn("option", F.col("option").cast("long"))


@query("m05_option_compliance", f"WITH {_OPTIONS_SQL} SELECT id, v, list_contains(list_transform(options, lambda x: lower(trim(x))), lower(trim(s))) AS compliant FROM opts")
def m05(spark, sf):
    opts = naming.name_options(naming.name_parts(F.col("name")))
    return names(spark, sf).where("name <> ''").select("id", "v", naming.is_one_of(naming.stem(F.col("name")), opts).alias("compliant"))


@query("m06_name_issues", (
    f"WITH {_OPTIONS_SQL} SELECT id * 100 + v AS doc_id, name AS found_text, concat('Option 1: ', options[1], chr(10), 'Option 2: ', options[2], chr(10), 'Option 3: ', options[3], chr(10), 'Option 4: ', options[4]) AS suggestion "
    "FROM opts WHERE NOT list_contains(list_transform(options, lambda x: lower(trim(x))), lower(trim(s)))"
))
def m06(spark, sf):
    docs = names(spark, sf).select((F.col("id") * 100 + F.col("v")).alias("doc_id"), F.nullif("name", F.lit("")).alias("original_filename"))
    return filenames.name_issues(docs).select("doc_id", "found_text", "suggestion")


@query("m07_name_source", f"WITH {_NAMES_SQL} SELECT id, v, CASE WHEN name <> '' AND v % 2 = 0 THEN name WHEN v % 3 <> 2 THEN concat('file', CAST(v AS VARCHAR), '.pdf') END AS shown FROM names")
def m07(spark, sf):
    original = F.when(F.col("v") % 2 == 0, F.col("name"))
    path = F.when(F.col("v") % 3 != 2, F.concat(F.lit("/a/b/file"), F.col("v").cast("string"), F.lit(".pdf")))
    return names(spark, sf).select("id", "v", naming.display_name(original, path).alias("shown"))


@query("m08_batch_check", (
    f"WITH {_NAMES_SQL}, f AS (SELECT p_partkey AS id, unnest(range(0, {len(_FOLDERS)})) AS v FROM part) "
    f"SELECT id, v, 'file' AS type, {_CLASS_SQL} AS name_class, CASE WHEN name = '' THEN 'Empty name provided' END AS error FROM stems UNION ALL "
    f"SELECT id, v, 'folder', CASE WHEN {_FOLDER_SQL} = '' THEN 'folder' END, NULL FROM f"
))
def m08(spark, sf):
    items = names(spark, sf).withColumn("type", F.lit("file")).unionByName(folders(spark, sf).withColumn("type", F.lit("folder")))
    return filenames.check_names(items, kind="type").select("id", "v", "type", "name_class", "error")


_CLEAN = "replace(replace(lower(s), '_', ' '), '-', ' ')"
for _w in lx.NAME_FILLERS:
    _CLEAN = f"replace({_CLEAN}, '{_w}', '')"
_CLEAN = f"trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g'))"


@query("m09_matching_name", f"WITH {_NAMES_SQL} SELECT id, v, {_CLEAN} AS clean FROM stems")
def m09(spark, sf):
    return names(spark, sf).select("id", "v", naming.matching_name(F.col("name")).alias("clean"))


_TEMPLATES = [f"{lx.LEAD_WORD} {suffix}" for suffix, _ in lx.TEMPLATE_KEYWORDS]
_FILES = ("acme ipr template.pptx", "{n} overview.pptx", "{n}_general_summary.pptx", "acme standrd templte.pptx", "{n}.pptx", "acme project {n}.pptx")


def files(spark, sf) -> DataFrame:
    p = stage.dealt_out(readers.table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    filled = F.array(*[F.concat(F.lit(t.partition("{n}")[0]), F.col("p_name") if "{n}" in t else F.lit(""), F.lit(t.partition("{n}")[2])) for t in _FILES])
    return p.select(F.col("p_partkey").alias("id"), F.posexplode(filled).alias("v", "filename")).withColumn("v", F.col("v").cast("long"))


_FILES_SQL = (
    "files AS (SELECT p_partkey AS id, generate_subscripts(l, 1) - 1 AS v, unnest(l) AS filename FROM (SELECT p_partkey, ["
    + ", ".join("concat(" + ", p_name, ".join(o.lit(s) for s in t.split("{n}")) + ")" for t in _FILES)
    + f"] AS l FROM part)), stems AS (SELECT *, regexp_replace(filename, '\\.[^.]+$', '') AS s FROM files), clean AS (SELECT id, v, {_CLEAN} AS clean FROM stems)"
)
_KEYWORD_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(clean, '{w}')" for w in words) + f" THEN '{lx.LEAD_WORD} {suffix}'" for suffix, words in lx.TEMPLATE_KEYWORDS
) + " END"
_EDIT = "1 - levenshtein(clean, t)::DOUBLE / greatest(length(clean), length(t), 1)"
_OPEN_SQL = (
    f"{_FILES_SQL}, open_names AS (SELECT DISTINCT clean FROM clean WHERE clean NOT IN ({', '.join(o.lit(t) for t in _TEMPLATES)}) AND {_KEYWORD_SQL} IS NULL), "
    f"pairs AS (SELECT clean, t FROM open_names, (SELECT unnest({[t for t in _TEMPLATES]}) AS t))"
)
_BEST = "best AS (SELECT clean, t, ratio FROM (SELECT clean, t, {r} AS ratio, row_number() OVER (PARTITION BY clean ORDER BY {r} DESC, t) AS r FROM {f}) WHERE r = 1)"
# Of all texts in a, longest and earliest first, the first that is in b; then the same for what is before and after it.
_LONGEST = (
    "list_filter(flatten(list_transform(range(least(length(a), length(b)), 0, -1), lambda n: list_transform(range(1, length(a) - n + 2), lambda i: substr(a, i, n)))), "
    "lambda s: contains(b, s))[1]"
)
_BLOCKS_SQL = (
    f"{_OPEN_SQL}, "
    f"blocks(clean, t, a, b) AS (SELECT clean, t, clean, t FROM pairs UNION ALL SELECT clean, t, CASE WHEN side = 0 THEN substr(a, 1, instr(a, s) - 1) ELSE substr(a, instr(a, s) + length(s)) END, "
    f"CASE WHEN side = 0 THEN substr(b, 1, instr(b, s) - 1) ELSE substr(b, instr(b, s) + length(s)) END FROM (SELECT *, {_LONGEST} AS s FROM blocks WHERE a <> '' AND b <> ''), (VALUES (0), (1)) v(side) WHERE s IS NOT NULL), "
    f"ratios AS (SELECT clean, t, 2.0::DOUBLE * coalesce(sum(length({_LONGEST})), 0) / (length(clean) + length(t)) AS x FROM blocks GROUP BY clean, t), {_BEST.format(r='x', f='ratios')}"
)


@query("m10_template_match", (
    f"WITH RECURSIVE {_BLOCKS_SQL} SELECT id, v, CASE WHEN c.clean IN ({', '.join(o.lit(t) for t in _TEMPLATES)}) THEN c.clean ELSE coalesce({_KEYWORD_SQL.replace('clean', 'c.clean')}, CASE WHEN ratio >= 0.6 THEN t END, '{lx.LEAD_WORD} standard template') END AS template, "
    f"CASE WHEN c.clean IN ({', '.join(o.lit(t) for t in _TEMPLATES)}) THEN 'exact' WHEN {_KEYWORD_SQL.replace('clean', 'c.clean')} IS NOT NULL THEN 'keyword' WHEN ratio >= 0.6 THEN 'fuzzy' ELSE 'default' END AS strategy "
    "FROM clean c LEFT JOIN best b ON c.clean = b.clean"
))
def m10(spark, sf):
    return templates.match_templates(files(spark, sf), _TEMPLATES).select("id", "v", "template", "strategy")


def _open_names(spark, sf) -> DataFrame:
    clean = files(spark, sf).withColumn("clean", naming.matching_name(F.col("filename")))
    return clean.where(~F.col("clean").isin(*_TEMPLATES) & templates.keyword_template(F.col("clean")).isNull())


@query("m11_edit_ratio", f"WITH {_OPEN_SQL}, {_BEST.format(r=_EDIT, f='pairs')} SELECT clean, t AS template, round(ratio, 6) AS ratio FROM best")
def m11(spark, sf):
    return templates.best_by_ratio(_open_names(spark, sf), _TEMPLATES).withColumn("ratio", F.round("ratio", 6))


@query("m11_block_ratio", f"WITH RECURSIVE {_BLOCKS_SQL} SELECT clean, t AS template, round(ratio, 6) AS ratio FROM best")
def m11_blocks(spark, sf):
    return templates.best_by_ratio(_open_names(spark, sf), _TEMPLATES, ratio=templates.block_ratio).withColumn("ratio", F.round("ratio", 6))


@query("m12_template_lookup", (
    f"WITH {_FILES_SQL} SELECT id, v, replace(lower(filename), '.pptx', '') AS key, replace(lower(filename), '.pptx', '') IN ({', '.join(o.lit(t) for t in _TEMPLATES)}) AS found FROM files"
))
def m12(spark, sf):
    """Look-up of a template by name, here the file name with the template suffix."""
    cat = spark.createDataFrame([(t,) for t in _TEMPLATES], "key string").withColumn("found", F.lit(True))
    keyed = files(spark, sf).withColumn("key", templates.template_key(F.replace(F.col("filename"), F.lit(".pptx"), F.lit(".JSON"))))
    return keyed.join(F.broadcast(cat), "key", "left").select("id", "v", "key", F.coalesce("found", F.lit(False)).alias("found"))


