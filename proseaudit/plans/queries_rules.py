"""Queries over lines of text: gates, spans, grammar, word list, tone, usage, catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseaudit.functions import gates, rewrite, spans
from proseaudit.functions import lexicons as lx
from proseaudit.functions import text as tx
from proseaudit.operators import catalogue, protect, rules, segment, sentiment, stage
from proseaudit.plans import corpus
from proseaudit.plans import oracle as o
from proseaudit.plans.registry import query
from proseaudit.sources import readers, sinks

MARKED = f"WITH {corpus.LINES_SQL}, marked AS (SELECT *, {o.mark('text')} AS t FROM lines) "


def rewritten(lines: DataFrame, name: str, new: Column) -> DataFrame:
    """The lines that a rewrite changes; it runs once for each line."""
    return stage.settle(lines.withColumn(name, new), [name]).where(F.col(name) != F.col("text")).select("src", "key", "ord", name)


def from_lines(select: str, where: str = "TRUE") -> str:
    columns = f", {select}" if select else ""
    return f"{MARKED} SELECT src, key, ord{columns} FROM marked WHERE {where}"


def changed(expression: str, where: str = "TRUE") -> str:
    return (
        f"{MARKED} SELECT src, key, ord, suggestion FROM (SELECT src, key, ord, text, {expression} AS suggestion "
        f"FROM marked WHERE {where}) WHERE suggestion <> text"
    )


# --- gates -----------------------------------------------------------------------------------------------

def label_heading(x: str) -> str:
    return o.has(x, rf"^{o.WS}*[A-Z][A-Za-z0-9 /&\-()]+:{o.WS}*$")


def swot(t: str) -> str:
    words = ["strength", "strengths", "weakness", "weaknesses", "opportunity", "opportunities", "threat", "threats"]
    return o.has(t, rf"(?i)^{o.WS}*(‹key›{o.WS}+)?(‹(?:{'|'.join(words)})›(?:/‹risks?›)?)[:\-]?{o.WS}*$")


def short_title(x: str, t: str) -> str:
    return (
        f"({o.has(x, f'^{o.WS}*[^{o.WS[1:]}+(?:{o.WS}+[^{o.WS[1:]}+){{0,3}}{o.WS}*$')}"
        rf" AND ((regexp_matches({x}, '\p{{L}}') AND NOT regexp_matches({x}, '(^|[^\p{{L}}])\p{{Ll}}') AND NOT regexp_matches({x}, '\p{{L}}\p{{Lu}}'))"
        rf" OR (regexp_matches({x}, '\p{{Lu}}') AND NOT regexp_matches({x}, '\p{{Ll}}')))"
        rf" AND NOT regexp_matches({x}, '\p{{N}}') AND NOT {o.has(t, '(?i)' + o.any_m(lx.NON_NOUN_WORDS))})"
    )


def heading_like(x: str, t: str, with_swot: bool = True) -> str:
    test = f"{label_heading(x)} OR {short_title(x, t)}"
    return f"({test} OR {swot(t)})" if with_swot else f"({test})"


def sentence_like(x: str, t: str) -> str:
    return f"(regexp_matches({o.strip(x)}, '[.!?]$') OR {o.has(t, '(?i)' + o.any_m(lx.VERB_WORDS))})"


def quoted(x: str) -> str:
    s = o.strip(x)
    return (
        f"(regexp_matches({s}, '(?s)^[“\"‘''].*[”\"’'']$') OR regexp_matches({s}, '^[“\"]') OR regexp_matches({s}, '[”\"]$') "
        f"OR contains({s}, '…”') OR contains({s}, '\"…\"'))"
    )


NEGATION = "(?i)" + o.any_m(lx.NEGATORS)
NEGATIVE = rf"(?i)‹(?:not|no|cannot)›{o.WS}+‹"
PASSIVE = rf"(?i)‹(?:is|are|was|were|been|being)›{o.WS}+‹{o.W}+(?:ed|en)›"
HEDGING = "(?i)" + o.any_m(lx.HEDGES)
NEUTRAL = "(?i)" + o.any_m(lx.NEUTRAL_DOMAIN_WORDS)

_GATES = {
    "c02_label_heading": (gates.is_labelled_heading, label_heading("text")),
    "c03_swot_heading": (gates.is_swot_heading, swot("t")),
    "c04_short_title": (gates.is_short_title, short_title("text", "t")),
    "c05_heading_like": (gates.is_heading_like, heading_like("text", "t")),
    "c08_quoted_block": (gates.is_quoted, quoted("text")),
    "c11_negation": (gates.has_negation, o.has("t", NEGATION)),
    "c12_neutral_domain_word": (gates.has_neutral_domain_word, o.has("t", NEUTRAL)),
    "c13_passive": (gates.is_passive, o.has("t", PASSIVE)),
    "c14_hedging": (gates.has_hedging, o.has("t", HEDGING)),
}


def _register_gate(name, test, sql):
    @query(name, from_lines("", sql))
    def build(spark, sf):
        return corpus.lines(spark, sf).where(test(F.col("text"))).select("src", "key", "ord")


for _name, (_test, _sql) in _GATES.items():
    _register_gate(_name, _test, _sql)


@query("c01_minimum_text", f"WITH {corpus.LINES_SQL} SELECT src, key, count(*) AS n_lines FROM lines WHERE length({o.strip('text')}) >= 3 GROUP BY src, key")
def c01(spark, sf):
    return corpus.lines(spark, sf).where(gates.long_enough(F.col("text"))).groupBy("src", "key").agg(F.count(F.lit(1)).alias("n_lines"))


@query("c07_sentence_like", (
    f"{MARKED} SELECT src, key, count(*) FILTER (WHERE {sentence_like('text', 't')}) AS n_yes, "
    f"count(*) FILTER (WHERE NOT {sentence_like('text', 't')}) AS n_no FROM marked GROUP BY src, key"
))
def c07(spark, sf):
    yes = gates.is_sentence_like(F.col("text"))
    return corpus.lines(spark, sf).groupBy("src", "key").agg(F.count_if(yes).alias("n_yes"), F.count_if(~yes).alias("n_no"))


_BODY = rf"^([A-Z][A-Za-z0-9 /&\-()]+:){o.WS}*([^\n]+)$"


@query("c06_heading_body_split", (
    f"{MARKED} SELECT src, key, ord, CASE WHEN {label_heading('text')} THEN {o.strip('text')} ELSE regexp_extract({o.strip('text')}, {o.lit(_BODY)}, 1) END AS heading, "
    f"CASE WHEN {label_heading('text')} THEN '' ELSE regexp_extract({o.strip('text')}, {o.lit(_BODY)}, 2) END AS body, "
    f"CASE WHEN {label_heading('text')} THEN {o.strip('text')} ELSE concat(regexp_extract({o.strip('text')}, {o.lit(_BODY)}, 1), ' ', {o.strip(f'regexp_extract({o.strip(chr(116)+chr(101)+chr(120)+chr(116))}, {o.lit(_BODY)}, 2)')}) END AS joined "
    f"FROM marked WHERE {label_heading('text')} OR {o.has(o.strip('text'), _BODY)}"
))
def c06(spark, sf):
    c = F.col("text")
    parts = corpus.lines(spark, sf).withColumns({"heading": gates.heading_part(c), "body": gates.body_part(c)})
    return parts.where("heading is not null").select(
        "src", "key", "ord", "heading", "body", gates.reattach(F.col("heading"), F.col("body")).alias("joined")
    )


_PROTECT = ["health", "SHIP", ""]
_prot = o.strip("lower(text)")


@query("c10_text_protection", from_lines(
    "", f"{_prot} <> '' AND (contains({_prot}, 'health') OR contains({_prot}, 'ship') OR contains('health', {_prot}) OR contains('ship', {_prot}))"
))
def c10(spark, sf):
    terms = F.array(*[F.lit(t) for t in _PROTECT])
    return corpus.lines(spark, sf).where(gates.text_protected(F.col("text"), terms)).select("src", "key", "ord")


@query("c16_required_keys", "SELECT event_id, contains(props, '\"k\":') AS has_k, FALSE AS has_both FROM events")
def c16(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return readers.table(spark, sf, "events").select(
        "event_id", gates.has_required_keys(m, ["k"]).alias("has_k"), gates.has_required_keys(m, ["k", "id"]).alias("has_both")
    )


# --- spans ---------------------------------------------------------------------------------------------------

_RUN = "[0-9]+|[^0-9]+"


@query("d00_spans", (
    f"WITH {corpus.LINES_SQL}, runs AS (SELECT src, key, ord, regexp_extract_all(text, '{_RUN}') AS r FROM lines WHERE regexp_matches(text, '[0-9]')), "
    "each AS (SELECT src, key, ord, r, unnest(range(1, len(r) + 1)) AS i FROM runs) "
    "SELECT src, key, ord, CAST(length(array_to_string(r[1:i-1], '')) AS BIGINT) AS start_at, "
    "CAST(length(array_to_string(r[1:i], '')) AS BIGINT) AS end_at, r[i] AS span FROM each WHERE regexp_matches(r[i], '^[0-9]')"
))
def d00(spark, sf):
    """Offsets of every digit run."""
    hits = corpus.lines(spark, sf).where(F.col("text").rlike("[0-9]"))
    found = hits.select("src", "key", "ord", F.explode(spans.located(F.col("text"), "[0-9]+")).alias("s"))
    return found.select(
        "src", "key", "ord", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), F.col("s.text").alias("span")
    )


# --- grammar --------------------------------------------------------------------------------------------------------

def contractions_sql(t: str, skip_lower: tuple = ()) -> str:
    out = t
    for short, long in lx.CONTRACTIONS.items():
        word, _, tail = short.partition("'")
        head, rest = word[0], word[1:]
        end = f"(?i:{rest})›''‹(?i:{tail})›" if rest else f"›''‹(?i:{tail})›"
        out = f"regexp_replace({out}, '‹{head.upper()}{end}', {o.lit(long.capitalize())}, 'g')"
        if short not in skip_lower:
            out = f"regexp_replace({out}, '‹{head}{end}', {o.lit(long)}, 'g')"
    return o.unmark(out)


_NUMBER_RUNS = (
    f"WITH {corpus.LINES_SQL}, runs AS (SELECT src, key, ord, text, regexp_extract_all(text, '[0-9.,]+|[^0-9.,]+') AS r FROM lines WHERE regexp_matches(text, '[0-9]')), "
    "each AS (SELECT src, key, ord, text, r, unnest(range(1, len(r) + 1)) AS i FROM runs), "
    "numbers AS (SELECT src, key, ord, text, i, r[i] AS piece, CASE WHEN regexp_matches(r[i], '^[0-9]{1,2}$') THEN array_to_string(r[1:i-1], '') END AS pre, "
    "CASE WHEN regexp_matches(r[i], '^[0-9]{1,2}$') THEN array_to_string(r[i+1:], '') END AS post FROM each)"
)
_CODE = "(regexp_matches(pre, '[A-Za-z]-?[A-Za-z]\\n?$') OR regexp_matches(post, '^[A-Za-z-]'))"
_PAGE = f"regexp_matches(right(pre, 3), '(?i)(^|{o.WS})pp?\\.?\\n?$')"
_RANGE = "(regexp_matches(pre, '[-–]$') OR regexp_matches(post, '^[-–]'))"
_OPEN = f"(?:{o.WS}|[\"''“‘(\\[{{])*"
_START = f"regexp_matches(pre, '(^|[.!?:;]){_OPEN}$')"
_SCALE = f"regexp_matches(post, '(?i)^{o.NW}*(percent|million|billion|trillion)($|{o.NW})')"
_WORDS = {str(n): lx.number_word(n).capitalize() for n in range(1, 100)}
_CONTEXTS = {
    "e07_code_token": (rules.in_code_token, _CODE),
    "e08_page_reference": (rules.is_page_ref, _PAGE),
    "e09_numeric_range": (rules.in_range, _RANGE),
    "e10_sentence_start": (rules.at_sentence_start, _START),
}


def _register_context(name, test, sql):
    @query(name, (
        f"{_NUMBER_RUNS} SELECT src, key, ord, count(*) AS n_numbers, count(*) FILTER (WHERE {sql}) AS n_true FROM numbers "
        "WHERE pre IS NOT NULL GROUP BY src, key, ord"
    ))
    def build(spark, sf):
        c = F.col("text")
        hits = corpus.lines(spark, sf).where(c.rlike(rules.SHORT_NUMBER))
        z = hits.select("src", "key", "ord", F.posexplode(spans.zipped(c, rules.SHORT_NUMBER)).alias("i", "s")).where("s.m is not null")
        span = spans.Span(F.col("s.m"), F.col("s.g"), F.col("s.n"), F.col("s.p"), F.coalesce("s.f", F.lit("")), F.col("i") == 0)
        return z.groupBy("src", "key", "ord").agg(F.count(F.lit(1)).alias("n_numbers"), F.count_if(test(span)).alias("n_true"))


for _name, (_test, _sql) in _CONTEXTS.items():
    _register_context(_name, _test, _sql)

_SPELL_SQL = (
    f"{_NUMBER_RUNS}, rebuilt AS (SELECT src, key, ord, any_value(text) AS text, string_agg(CASE WHEN pre IS NOT NULL AND {_START} AND NOT {_CODE} AND NOT {_PAGE} "
    f"AND NOT {_RANGE} AND NOT {_SCALE} THEN coalesce({o.cases(_WORDS, 'ltrim(piece, chr(48))')}, piece) ELSE piece END, '' ORDER BY i) AS suggestion FROM numbers GROUP BY src, key, ord) "
    "SELECT src, key, ord, suggestion FROM rebuilt WHERE suggestion <> text"
)
_GROUP_SQL = (
    f"WITH {corpus.LINES_SQL}, runs AS (SELECT src, key, ord, text, regexp_extract_all(text, '[0-9.]+|[^0-9.]+') AS r FROM lines WHERE regexp_matches(text, '[0-9]{{4}}')), "
    "each AS (SELECT src, key, ord, text, r, unnest(range(1, len(r) + 1)) AS i FROM runs), "
    "digits AS (SELECT src, key, ord, text, i, r[i] AS piece, regexp_extract(r[i], '^[0-9]{4,}') AS num, "
    "concat(coalesce(r[i-2], ''), coalesce(r[i-1], '')) AS pre, coalesce(r[i+1], '') AS nxt FROM each), "
    "cut AS (SELECT *, substr(piece, length(num) + 1) AS tail, CAST(CASE WHEN num = '' THEN '0' ELSE num END AS HUGEINT) AS val FROM digits), "
    "rebuilt AS (SELECT src, key, ord, any_value(text) AS text, string_agg(CASE WHEN num <> '' AND NOT regexp_matches(tail, '^\\.[0-9]') "
    "AND NOT (val BETWEEN 1900 AND 4000) AND NOT regexp_matches(pre, '[A-Za-z]-?[A-Za-z]\\n?$') AND NOT (tail = '' AND regexp_matches(nxt, '^[A-Za-z-]')) "
    f"AND NOT regexp_matches(right(pre, 3), '(?i)(^|{o.WS})pp?\\.?\\n?$') THEN concat(format('{{:,}}', val), tail) ELSE piece END, '' ORDER BY i) AS suggestion FROM cut GROUP BY src, key, ord) "
    "SELECT src, key, ord, suggestion FROM rebuilt WHERE suggestion <> text"
)
_Q = "[\"''’”]"
_QUOTES_SQL = (
    f"regexp_replace(regexp_replace(text, '({_Q}){o.WS}*([.,])|([;:])({_Q})', '\\2\\1\\4\\3', 'g'), 'x^', '', 'g')"
)
_PREFERRED_SQL = o.unmark(_chain := "t")
for _wrong, _right in sorted(lx.PREFERRED_TERMS.items(), key=lambda kv: (-len(kv[0]), kv[0])):
    _chain = o.sub(_chain, "(?i)" + o.m(_wrong), _right)
_PREFERRED_SQL = o.unmark(_chain)


def abbreviations_sql(t: str) -> str:
    out = t
    for a, b in (("e", "g"), ("i", "e")):
        out = o.sub(out, rf"(?i)(‹{a}›)\.(‹{b}›)\.({o.WS}*,)", r"\1¤.\2.\3")
        out = o.sub(out, rf"(?i)‹{a}›\.‹{b}›\.", f"{a}.{b}.,")
    return o.unmark(o.sub(out, "¤", ""))


_REWRITES = {
    "e01_contractions": ("contractions", changed(contractions_sql("t"))),
    "e02_and_or": ("and_or", changed(o.unmark(o.sub("t", "(?i)‹and›/‹or›", "or")))),
    "e03_ampersand": ("ampersand", changed(o.sub("text", f"{o.WS}+&{o.WS}+", " and "))),
    "e04_numerals_spell_out": ("numerals_spell_out", _SPELL_SQL),
    "e05_numerals_commas": ("numerals_commas", _GROUP_SQL),
    "e11_period_spacing": ("period_spacing", changed(o.sub("text", "([.!?]) {2,}", r"\1 "))),
    "e12_quotation_marks": ("quotation_marks", changed(_QUOTES_SQL)),
    "e13_hyphens": ("hyphens", changed(o.sub("text", "—|-{2,}", "–"))),
    "f03_word_list": ("word_list", changed(abbreviations_sql(_chain))),
}


def _register_rewrite(name, rule, sql):
    @query(name, sql)
    def build(spark, sf):
        return rules.detect(corpus.lines(spark, sf), [rule], text="text", scope=None).select("src", "key", "ord", "suggestion")


for _name, (_rule, _sql) in _REWRITES.items():
    _register_rewrite(_name, _rule, _sql)


@query("e06_probable_year", (
    f"WITH {corpus.LINES_SQL}, n AS (SELECT src, key, ord, list_filter(list_transform(regexp_extract_all(text, '[0-9.]+'), lambda x: regexp_extract(x, '^[0-9]{{4,}}')), lambda x: x <> '') AS v FROM lines) "
    "SELECT src, key, ord, CAST(len(v) AS BIGINT) AS n_numbers, CAST(len(list_filter(v, lambda x: CAST(x AS HUGEINT) BETWEEN 1900 AND 4000)) AS BIGINT) AS n_years FROM n WHERE len(v) > 0"
))
def e06(spark, sf):
    c = F.col("text")
    hits = corpus.lines(spark, sf).where(c.rlike(rules.LONG_NUMBER)).withColumn("v", spans.matches(c, rules.LONG_NUMBER))
    return hits.select(
        "src", "key", "ord", F.size("v").cast("long").alias("n_numbers"),
        F.size(F.filter("v", rules.is_probable_year)).cast("long").alias("n_years"),
    )


@query("c09_span_protection", changed(
    f"CASE WHEN key % 2 = 0 THEN {contractions_sql('t', skip_lower=(chr(99) + 'an' + chr(39) + 't',))} ELSE {contractions_sql('t')} END"
))
def c09(spark, sf):
    """Contractions with ``can't`` protected in the even rows."""
    terms = F.when(F.col("key") % 2 == 0, F.array(F.lit("can't"), F.lit(""))).otherwise(F.expr("cast(array() as array<string>)"))
    df = corpus.lines(spark, sf).withColumn("terms", terms)
    return rules.detect(df, ["contractions"], text="text", scope=None, terms="terms").select("src", "key", "ord", "suggestion")


@query("f01_preferred_terms", changed(_PREFERRED_SQL))
def f01(spark, sf):
    c = F.col("text")
    return (
        corpus.lines(spark, sf).where(c.rlike(rules.PREFERRED)).withColumn("suggestion", rules.prefer_terms(c))
        .where("suggestion <> text").select("src", "key", "ord", "suggestion")
    )


@query("f02_abbreviation_comma", changed(abbreviations_sql("t")))
def f02(spark, sf):
    c = F.col("text")
    return (
        corpus.lines(spark, sf).where(c.rlike(rules.ABBREVIATION)).withColumn("suggestion", rules.comma_after_abbreviation(c))
        .where("suggestion <> text").select("src", "key", "ord", "suggestion")
    )


@query("f04_term_table", (
    f"WITH {corpus.LINES_SQL}, terms AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT 'health care' UNION SELECT 'machine learning' UNION SELECT 'the'), "
    f"w AS (SELECT src, key, ord, regexp_extract_all(lower(text), '{o.W}+(?:[-'']{o.W}+)*') AS l FROM lines), "
    "g AS (SELECT src, key, ord, unnest(l) AS term FROM w UNION ALL "
    "SELECT src, key, ord, unnest(list_transform(range(1, len(l)), lambda i: concat(l[i], ' ', l[i+1]))) FROM w WHERE len(l) > 1 UNION ALL "
    "SELECT src, key, ord, unnest(list_transform(range(1, len(l) - 1), lambda i: concat(l[i], ' ', l[i+1], ' ', l[i+2]))) FROM w WHERE len(l) > 2) "
    "SELECT src, key, ord, term, upper(term) AS preferred, count(*) AS hits FROM g JOIN terms USING (term) GROUP BY src, key, ord, term"
))
def f04(spark, sf):
    """Term table of any size, here the part names and three phrases."""
    parts = readers.table(spark, sf, "part").select(F.col("p_name").alias("term"))
    extra = parts.select(F.explode(F.array(F.lit("health care"), F.lit("machine learning"), F.lit("the"))).alias("term"))
    terms = parts.unionByName(extra).distinct().withColumn("preferred", F.upper("term"))
    return protect.replace_by_table(corpus.lines(spark, sf), terms, ["src", "key", "ord"])


# --- tone ------------------------------------------------------------------------------------------------------------

_SENTS = (
    f"WITH {corpus.LINES_SQL}, headed AS (SELECT *, {o.mark('text')} AS t FROM lines), "
    f"body AS (SELECT src, key, ord, string_split({o.sub(o.strip('text'), f'([.!?]){o.WS}+', chr(92) + '1¦')}, '¦') AS l FROM headed WHERE {o.strip('text')} <> '' AND NOT {heading_like('text', 't')}), "
    "sents AS (SELECT src, key, ord, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS sent_index, unnest(l) AS s FROM body), "
    f"marked AS (SELECT *, {o.mark('s')} AS t FROM sents) "
)
_GATE = f"NOT {heading_like('s', 't')} AND {sentence_like('s', 't')} AND NOT {quoted('s')}"
_WEIGHT = "list_sum(list_transform(regexp_extract_all(lower(t), {p}), lambda x: {c}))".format(
    p=o.lit(o.any_m(lx.SENTIMENT_WEIGHTS)), c=o.cases({f"‹{k}›": v for k, v in lx.SENTIMENT_WEIGHTS.items()}, "x")
)
_TOTAL = f"coalesce({_WEIGHT}, 0.0)"
_COMPOUND = f"(CAST({_TOTAL} AS DOUBLE) / sqrt(CAST({_TOTAL} AS DOUBLE) * CAST({_TOTAL} AS DOUBLE) + 15.0))"


def sentences(spark, sf, hint: Column | None = None) -> DataFrame:
    """Sentences of all lines, or of those for which the cheap test ``hint`` on ``text`` holds."""
    lines = corpus.lines(spark, sf) if hint is None else corpus.lines(spark, sf).where(hint)
    body = lines.where((tx.strip("text") != "") & ~gates.is_heading_like(F.col("text")))
    return segment.sentences(body).withColumn("sent_index", F.col("sent_index").cast("long"))


@query("h01_sentences", f"{_SENTS} SELECT src, key, ord, sent_index, s AS sentence FROM marked")
def h01(spark, sf):
    return sentences(spark, sf).select("src", "key", "ord", "sent_index", "sentence")


@query("h02_negative_phrase", f"{_SENTS} SELECT src, key, ord, sent_index FROM marked WHERE {o.has('t', NEGATIVE)} AND {_GATE}")
def h02(spark, sf):
    c = F.col("sentence")
    return sentences(spark, sf).where(gates.has_negative_phrase(c) & rules.tone_gate(c)).select("src", "key", "ord", "sent_index")


@query("h03_sentiment", (
    f"{_SENTS} SELECT src, key, ord, sent_index, round({_COMPOUND}, 6) AS compound FROM marked WHERE {o.has('lower(t)', o.any_m(lx.SENTIMENT_WEIGHTS))} AND {_COMPOUND} <= -0.4"
))
def h03(spark, sf):
    harsh = lambda c: tx.let(F.lower(c), lambda low: tx.mentions(low, rules.HARSH))
    c = F.col("sentence")
    scored = sentences(spark, sf, harsh(F.col("text"))).where(harsh(c)).withColumn("_c", rules.sentiment(c))
    return (
        stage.settle(scored, ["_c"]).where(F.col("_c") <= lx.SENTIMENT_THRESHOLD)
        .select("src", "key", "ord", "sent_index", F.round("_c", 6).alias("compound"))
    )


_BENCH_WORDS_SQL = (
    f"lex AS (SELECT word, min(weight) AS weight FROM (SELECT word, (length(word) % 5 - 2) * 0.5::DOUBLE AS weight FROM (SELECT unnest(regexp_extract_all(lower(text), '{o.W}+')) AS word FROM benchmark) "
    f"UNION ALL SELECT unnest({list(lx.SENTIMENT_WEIGHTS)}), unnest({[float(v) for v in lx.SENTIMENT_WEIGHTS.values()]}::DOUBLE[])) GROUP BY word)"
)


@query("h03_lexicon_table", (
    f"{_SENTS}, {_BENCH_WORDS_SQL}, sums AS (SELECT src, key, ord, sent_index, sum(weight) AS s FROM (SELECT src, key, ord, sent_index, unnest(regexp_extract_all(lower(s), '{o.W}+')) AS word FROM marked) JOIN lex USING (word) GROUP BY ALL) "
    "SELECT src, key, ord, sent_index, round(s / sqrt(s * s + 15.0), 6) AS compound FROM sums WHERE s / sqrt(s * s + 15.0) <= -0.4"
))
def h03_lexicon(spark, sf):
    """Sentences that score low against a lexicon in files: the words of the benchmark with weights by their length, and the short list."""
    out = sinks.shared_folder(spark, "lexicon")
    words = readers.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"{tx.WORD}+"), F.lit(0))).alias("word")).distinct()
    words.select("word", ((F.length("word") % 5 - 2) * 0.5).alias("weight")).write.json(out)
    spark.createDataFrame(list(lx.SENTIMENT_WEIGHTS.items()), "word string, weight double").write.mode("append").json(out)
    scores = sentiment.lexicon_scores(sentences(spark, sf), readers.lexicon(spark, out), ["src", "key", "ord", "sent_index"])
    return scores.where(F.col("compound") <= lx.SENTIMENT_THRESHOLD).withColumn("compound", F.round("compound", 6))


_NEG_CASE = (
    f"(({o.has('t', NEGATIVE)}) OR ({_COMPOUND} <= -0.4 AND NOT ({o.has('t', NEUTRAL)} AND NOT {o.has('t', NEGATION)})))"
)


@query("h04_positive_language", (
    f"{_SENTS} SELECT src, key, ord, sent_index, 'warning' AS severity, CASE WHEN NOT {o.has('t', NEGATIVE)} THEN round({_COMPOUND}, 6) END AS score FROM marked WHERE {_NEG_CASE} AND {_GATE}"
))
def h04(spark, sf):
    found = rules.detect(sentences(spark, sf, rules.may_hold(F.col("text"), ["positive_language"])), ["positive_language"], text="sentence", scope=None)
    return found.select("src", "key", "ord", "sent_index", "severity", F.round("score", 6).alias("score"))


@query("h05_active_voice", f"{_SENTS} SELECT src, key, ord, sent_index, 'info' AS severity FROM marked WHERE ({o.has('t', PASSIVE)} OR {o.has('t', HEDGING)}) AND {_GATE}")
def h05(spark, sf):
    found = rules.detect(sentences(spark, sf, rules.may_hold(F.col("text"), ["active_voice"])), ["active_voice"], text="sentence", scope=None)
    return found.select("src", "key", "ord", "sent_index", "severity")


_LOW = o.strip("lower(text)")
_CONTEXT_SQL = f"CASE WHEN regexp_matches({_LOW}, '^(weakness|threat|risk)') THEN 'weakness' WHEN regexp_matches({_LOW}, '^(strength|opportunit)') THEN 'strength' END"
_LIMITED = "(" + " OR ".join(f"contains({_LOW}, {o.lit(x)})" for x in lx.LIMITATION_MARKS) + ")"


@query("h06_context_label", f"{MARKED} SELECT src, key, ord, {_CONTEXT_SQL} AS context FROM marked WHERE {_CONTEXT_SQL} IS NOT NULL")
def h06(spark, sf):
    return corpus.lines(spark, sf).withColumn("context", gates.rewrite_context(F.col("text"))).where("context is not null").select("src", "key", "ord", "context")


@query("h07_constraint_context", (
    f"{MARKED} SELECT src, key, ord, coalesce({_CONTEXT_SQL}, CASE WHEN {_LIMITED} THEN 'weakness' END, 'neutral') AS context, "
    f"CASE WHEN {_CONTEXT_SQL} = 'weakness' THEN 'keep_negative' WHEN {_CONTEXT_SQL} = 'strength' THEN 'keep_positive' "
    f"WHEN {_LIMITED} THEN 'keep_limitation' ELSE '' END AS note FROM marked"
))
def h07(spark, sf):
    c = F.col("text")
    return corpus.lines(spark, sf).select("src", "key", "ord", gates.constraint_context(c).alias("context"), gates.constraint_note(c).alias("note"))


def positive_sql(x: str, context: str) -> str:
    steps = [("(?i)" + o.m(p, f"{o.WS}+"), r) for p, r in lx.POSITIVE_REWRITES]
    spaces = (f"{o.WS}{{2,}}", " ")
    neutral = f"regexp_replace({o.fold(x, steps)}, '{spaces[0]}', ' ', 'g')"
    weak = f"regexp_replace({o.fold(x, [('(?i)‹vey›', 'very')])}, '{spaces[0]}', ' ', 'g')"
    return f"CASE WHEN {context} = 'weakness' THEN {weak} ELSE {neutral} END"


def unless_same(new: str, old: str) -> str:
    return f"CASE WHEN {o.strip(new)} <> '' AND {o.comparable(new)} <> {o.comparable(old)} THEN {new} ELSE {old} END"


def active_sql(x: str) -> str:
    ws = f"{o.WS}+"
    steps = [("(?i)" + o.m(p, ws), r) if r is not None else ("(?i)" + o.m(p, ws) + ws, "") for p, r in lx.HEDGE_STEPS]
    steps += [(rf"(?i)‹(?:is|are|was|were)›{ws}‹{done}›", does) for done, does in lx.PASSIVE_REWRITES]
    steps.append((rf"(?i)‹being›{ws}‹({o.W}+ed|made|done)›", r"\1"))
    return o.squeeze(o.fold(x, steps))


@query("h08_positive_rewrite", (
    f"{MARKED}, c AS (SELECT *, coalesce({_CONTEXT_SQL}, 'neutral') AS context FROM marked), n AS (SELECT *, {positive_sql('text', 'context')} AS new FROM c), "
    f"r AS (SELECT src, key, ord, text, {unless_same('new', 'text')} AS rewritten FROM n) SELECT src, key, ord, rewritten FROM r WHERE rewritten <> text"
))
def h08(spark, sf):
    c = F.col("text")
    context = F.coalesce(gates.rewrite_context(c), F.lit("neutral"))
    return rewritten(corpus.lines(spark, sf), "rewritten", rewrite.positive(c, context))


@query("h09_active_rewrite", (
    f"{MARKED}, n AS (SELECT *, {active_sql('text')} AS new FROM marked), r AS (SELECT src, key, ord, text, {unless_same('new', 'text')} AS rewritten FROM n) "
    "SELECT src, key, ord, rewritten FROM r WHERE rewritten <> text"
))
def h09(spark, sf):
    return rewritten(corpus.lines(spark, sf), "rewritten", rewrite.active(F.col("text")))


# --- usage -------------------------------------------------------------------------------------------------------------

VAGUE = "(?i)" + o.any_m(lx.VAGUE_TIMES)
PEOPLE_ALL = "(?i)‹people›"
PEOPLE_OUT = rf"(?i)‹people›{o.WS}+‹(?:instead|rather|first|centered|centric)"
GENDERED = "(?i)" + o.any_m(lx.GENDERED_TERMS)
PRONOUN_ALL = "(?i)" + o.any_m(lx.GENDERED_PRONOUNS)
PRONOUN_OUT = "(?i)" + o.any_m(lx.GENDERED_PRONOUNS) + rf"{o.WS}+‹or› ‹(?:she|he)"
DISABILITY = "(?i)" + o.any_m(lx.DISABILITY_PHRASES)
PEOPLE_N = f"({o.count('t', PEOPLE_ALL)} - {o.count('t', PEOPLE_OUT)})"
PRONOUN_N = f"({o.count('t', PRONOUN_ALL)} - {o.count('t', PRONOUN_OUT)})"

_USAGE = {
    "i01_vague_time": (rules.VAGUE_TIME, o.count("t", VAGUE)),
    "i02_generic_people": (rules.GENERIC_PEOPLE, PEOPLE_N),
    "i03_gendered_terms": (rules.GENDERED, o.count("t", GENDERED)),
    "i04_gendered_pronouns": (rules.PRONOUN, PRONOUN_N),
    "i05_disability_phrases": (rules.DISABILITY, o.count("t", DISABILITY)),
}


def _register_count(name, pattern, sql):
    @query(name, f"{MARKED} SELECT src, key, ord, {sql} AS hits FROM marked WHERE {sql} > 0")
    def build(spark, sf):
        c = F.col("text")
        return corpus.lines(spark, sf).where(c.rlike(pattern)).select("src", "key", "ord", spans.count_matches(c, pattern).alias("hits"))


for _name, (_pattern, _sql) in _USAGE.items():
    _register_count(_name, _pattern, _sql)

SPECIFIC = f"({o.has('t', VAGUE)} OR {PEOPLE_N} > 0)"
INCLUSIVE = f"({o.has('t', GENDERED)} OR {PRONOUN_N} > 0 OR {o.has('t', DISABILITY)})"


@query("i06_usage_issues", (
    f"{MARKED} SELECT src, key, ord, 'specificity' AS rule_name, 'suggestion' AS severity FROM marked WHERE {SPECIFIC} AND NOT {heading_like('text', 't', False)} "
    f"UNION ALL SELECT src, key, ord, 'inclusivity', 'warning' FROM marked WHERE {INCLUSIVE} AND NOT {heading_like('text', 't', False)}"
))
def i06(spark, sf):
    return rules.detect(corpus.lines(spark, sf), ["specificity", "inclusivity"], text="text", scope=None).select("src", "key", "ord", "rule_name", "severity")


@query("i07_eligible_texts", (
    f"{MARKED} SELECT src, key, count(*) AS n FROM marked WHERE {o.strip('text')} <> '' AND NOT {heading_like('text', 't', False)} "
    f"AND NOT (contains({_LOW}, 'governance') OR contains('governance', {_LOW})) GROUP BY src, key"
))
def i07(spark, sf):
    df = corpus.lines(spark, sf).withColumn("terms", F.array(F.lit("Governance")))
    return rules.eligible_for_usage(df, "terms").groupBy("src", "key").agg(F.count(F.lit(1)).alias("n"))


_SPECIFIC_SQL = "text"
for _p, _r in reversed(lx.SPECIFICITY_REWRITES):
    _pat = "(?i)" + o.m(_p)
    _SPECIFIC_SQL = f"CASE WHEN {o.has('t', _pat)} THEN {o.unmark(o.sub('t', _pat, _r))} ELSE {_SPECIFIC_SQL} END"


@query("i08_specific_rewrite", changed(_SPECIFIC_SQL))
def i08(spark, sf):
    return rewritten(corpus.lines(spark, sf), "suggestion", rewrite.specific(F.col("text")))


INCLUSIVE_SQL = o.fold("text", [("(?i)" + o.m(p), r) for p, r in lx.INCLUSIVE_REWRITES])


@query("i09_inclusive_rewrite", changed(INCLUSIVE_SQL))
def i09(spark, sf):
    hit = corpus.lines(spark, sf).where(rewrite.may_exclude(F.col("text")))
    return rewritten(hit, "suggestion", rewrite.inclusive(F.col("text")))


# --- catalogue ------------------------------------------------------------------------------------------------------------

_FIELDS = [(r.name, r.category, r.severity, r.pattern is not None) for r in catalogue.CATALOGUE]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v).upper() if isinstance(v, bool) else o.lit(v) for v in row) + ")" for row in rows)


@query("t01_catalogue_filters", (
    f"WITH r(rule_name, category, severity, has_pattern) AS (VALUES {_values(_FIELDS)}), seen AS (SELECT concat('rule ', category) AS c, count(*) AS n FROM (SELECT {o.cases({'tone': 'voice', 'word-list': 'usage', 'filename': 'naming'}, 'category', 'category')} AS category FROM (SELECT {list(corpus._CATEGORY_CYCLE)}[CAST(l_partkey % {len(corpus._CATEGORY_CYCLE)} + 1 AS INTEGER)] AS category FROM lineitem)) GROUP BY 1) "
    "SELECT r.category AS category, count(*) AS n_rules, count(*) FILTER (WHERE severity = 'critical') AS n_critical, count(*) FILTER (WHERE has_pattern) AS n_pattern, any_value(coalesce(seen.n, 0)) AS n_issues "
    "FROM r LEFT JOIN seen ON seen.c = concat('rule ', r.category) GROUP BY r.category"
))
def t01(spark, sf):
    """Catalogue by category, its critical and pattern-bearing rules, and the issues stored under it."""
    cat = catalogue.catalogue(spark)
    base = cat.groupBy("category").agg(F.count(F.lit(1)).alias("n_rules"))
    critical = catalogue.select_rules(cat, critical=True).groupBy("category").agg(F.count(F.lit(1)).alias("n_critical"))
    pattern = catalogue.select_rules(cat, with_pattern=True).groupBy("category").agg(F.count(F.lit(1)).alias("n_pattern"))
    name = F.col("category")
    mapped = F.when(name == "tone", "voice").when(name == "word-list", "usage").when(name == "filename", "naming").otherwise(name)
    seen = corpus.stored_issues(spark, sf).groupBy(mapped.alias("category")).agg(F.count(F.lit(1)).alias("n_issues"))
    return base.join(critical, "category", "left").join(pattern, "category", "left").join(seen, "category", "left").fillna(0)


_w = f"‹{o.W}+›"
_PATTERN_SQL = {
    "avoid_mushy_language": o.count("t", rf"‹are›{o.WS}+(?:‹looking›{o.WS}+‹for|‹seeking|‹trying›{o.WS}+‹to)"),
    "specificity": o.count("t", o.any_m(["currently", "at this time", "presently", "right now", "people"])),
    "inclusivity": o.count("t", o.any_m(["waitress", "guys", "chairman", "mankind", "he", "she", "his", "her", "him", "disabled"])),
    "acronym_expansion": o.count("t", "‹[A-Z]{2,}›"),
    "oxford_comma": o.count("t", f"{_w},{o.WS}{_w}{o.WS}‹and›{o.WS}‹"),
    "en_dash_usage": o.count("t", "—|--"),
    "numeral_spelling": f"({o.count('t', '‹[1-9][0-9]?›')} - {o.count('t', f'‹[1-9][0-9]?›{o.WS}*(?:‹percent|%|‹million|‹billion)')})",
    "single_space_after_period": o.count("t", rf"\.{o.WS}{{2,}}"),
    "avoid_contractions": o.count("t", f"‹{o.W}+›'‹(?:t|re|ll|ve|d)›"),
    "avoid_and_or": o.count("t", "‹and›/‹or›"),
    "avoid_ampersand": o.count("t", f"{o.WS}&{o.WS}"),
    "avoid_etc": o.count("t", "‹etc›"),
    "avoid_second_person": o.count("t", o.any_m(["you", "your", "yours"])),
    "avoid_unnecessary_gerunds": o.count("t", o.any_m(["avoid using", "start using", "begin using"])),
}


@query("t02_pattern_scan", (
    f"{MARKED}, hits AS (" + " UNION ALL ".join(
        f"SELECT src, key, ord, {o.lit(n)} AS rule_name, {c} AS hits FROM marked" for n, c in _PATTERN_SQL.items()
    ) + ") SELECT src, key, ord, rule_name, hits FROM hits WHERE hits > 0"
))
def t02(spark, sf):
    return catalogue.pattern_hits(corpus.lines(spark, sf))


_SINGLE = {
    "t03_mushy_language": "avoid_mushy_language", "t04_acronyms": "acronym_expansion", "t05_oxford_comma": "oxford_comma",
    "t06_etc": "avoid_etc", "t07_second_person": "avoid_second_person", "t08_gerunds": "avoid_unnecessary_gerunds",
    "t09_en_dash": "en_dash_usage", "t09_numeral_spelling": "numeral_spelling", "t09_single_space": "single_space_after_period",
    "t09_contractions": "avoid_contractions", "t09_and_or": "avoid_and_or", "t09_ampersand": "avoid_ampersand",
    "t09_specificity": "specificity", "t09_inclusivity": "inclusivity",
}


def _register_single(name, rule):
    @query(name, f"{MARKED} SELECT src, key, ord, {_PATTERN_SQL[rule]} AS hits FROM marked WHERE {_PATTERN_SQL[rule]} > 0")
    def build(spark, sf):
        return catalogue.pattern_hits(corpus.lines(spark, sf), names=[rule]).drop("rule_name")


for _name, _rule in _SINGLE.items():
    _register_single(_name, _rule)


@query("t04_first_acronym_use", (
    f"{MARKED}, a AS (SELECT src, key, ord, text, unnest(list_distinct(regexp_extract_all(t, '‹([A-Z]{{2,}})›', 1))) AS acronym FROM marked) "
    "SELECT src, key, acronym, min(ord) AS first_ord, arg_min(contains(text, concat('(', acronym, ')')), ord) AS expanded FROM a GROUP BY src, key, acronym"
))
def t04_first(spark, sf):
    df = corpus.lines(spark, sf).withColumn("doc_id", F.struct("src", "key"))
    return catalogue.first_acronym_uses(df).select("doc_id.src", "doc_id.key", "acronym", "first_ord", "expanded")


_KIND = "CASE WHEN src = 'seed' AND ord % 3 = 0 THEN 'bullet' WHEN ord % 3 = 1 THEN 'title' ELSE 'paragraph' END"


@query("t10_declared_checks", (
    f"WITH {corpus.LINES_SQL}, k AS (SELECT *, {_KIND} AS kind FROM lines) SELECT src, key, "
    f"count(*) FILTER (WHERE kind = 'bullet' AND ends_with({o.strip('text')}, '.')) AS n_bullet_period, "
    f"count(*) FILTER (WHERE kind = 'title' AND regexp_matches(text, '(^|{o.WS})\\p{{Ll}}\\p{{L}}{{3,}}')) AS n_title_case, "
    "count(*) FILTER (WHERE regexp_matches(concat(text, chr(10), regexp_extract(text, '[^ ]*$')), '\\n[ \\t]*[^\\s]+[ \\t]*$')) AS n_hanging FROM k GROUP BY src, key"
))
def t10(spark, sf):
    """Rules declared without a pattern; lines get a hanging last word appended to test that one."""
    c = F.col("text")
    kind = F.when((F.col("src") == "seed") & (F.col("ord") % 3 == 0), "bullet").when(F.col("ord") % 3 == 1, "title").otherwise("paragraph")
    hanging = F.concat(c, F.lit("\n"), F.regexp_extract(c, "[^ ]*$", 0))
    return corpus.lines(spark, sf).groupBy("src", "key").agg(
        F.count_if(catalogue.bullet_ends_with_period(kind, c)).alias("n_bullet_period"),
        F.count_if(catalogue.breaks_title_case(kind, c)).alias("n_title_case"),
        F.count_if(catalogue.has_hanging_word(hanging)).alias("n_hanging"),
    )


