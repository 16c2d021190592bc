"""Queries for masking, facts, candidates, validation and the suggestion cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseaudit.functions import rewrite, validate
from proseaudit.functions import lexicons as lx
from proseaudit.functions import text as tx
from proseaudit.operators import protect, rules, suggest
from proseaudit.plans import corpus
from proseaudit.plans import oracle as o
from proseaudit.plans import queries_rules as qr
from proseaudit.plans.registry import query

MARKED = qr.MARKED


@query("k01_mask")
def k01(spark, sf):
    """Masked text and what was masked; lookaround in the patterns, so tested against plain Python instead of SQL."""
    return suggest.mask_text(corpus.lines(spark, sf)).where(F.size("mask_keys") > 0).select(
        "src", "key", "ord", "mask_text", F.array_join("mask_keys", " ").alias("keys"), F.array_join("mask_values", "|").alias("vals")
    )


@query("k02_unmask", f"WITH {corpus.LINES_SQL} SELECT src, key, count(*) AS n, count(*) AS n_restored FROM lines GROUP BY src, key")
def k02(spark, sf):
    """Masking and unmasking gives every line back."""
    m = suggest.mask_text(corpus.lines(spark, sf))
    back = rewrite.unmask(F.col("mask_text"), F.col("mask_keys"), F.col("mask_values"))
    return m.groupBy("src", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if(back == F.col("text")).alias("n_restored"))


def _ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_NAMES_SQL = f"list_transform(regexp_extract_all(t, '‹[A-Z][a-z]+›(?:{o.WS}+‹[A-Z][a-z]+›)*'), lambda v: {o.unmark('v')})"
# a percent sign belongs to the figure only when a word character follows it
_FIGURES_SQL = "list_transform(regexp_extract_all(t, '‹[0-9]+›(?:%‹)?'), lambda v: regexp_replace(v, '[‹›]', '', 'g'))"
_TECH_SQL = f"list_transform(regexp_extract_all(t, '‹(?:{'|'.join(lx.TECH_TERMS)})›'), lambda v: {o.unmark('v')})"
_PICKED = f"list_concat(list_concat({_NAMES_SQL}, {_FIGURES_SQL}), {_TECH_SQL})"


@query("k03_preserve_facts", (
    f"{MARKED}, p AS (SELECT src, key, ord, {_PICKED} AS picked FROM marked), d AS (SELECT src, key, ord, {_ordered_distinct('picked')} AS facts FROM p) "
    "SELECT src, key, ord, array_to_string(facts, '|') AS facts FROM d WHERE len(facts) > 0"
))
def k03(spark, sf):
    f = rewrite.facts(F.col("text"))
    return corpus.lines(spark, sf).select("src", "key", "ord", F.array_join(f, "|").alias("facts")).where("facts <> ''")


def seed_terms(spark, sf) -> DataFrame:
    """Two kinds of protected terms per seeded customer."""
    names = F.array(F.lit("health care"), F.lit("AI"), F.lit("staff"), F.lit("not there"))
    s = corpus.seeded(spark, sf).where("ord = 6")
    a = s.select("key", F.lit("technical_terms").alias("kind"), F.posexplode(names).alias("pos", "term"))
    b = s.select("key", F.lit("protected_names").alias("kind"), F.lit(0).alias("pos"), F.col("text").alias("term"))
    return a.unionByName(b)


@query("k04_occurring_terms", (
    f"WITH {corpus.LINES_SQL}, terms AS (SELECT c_custkey AS key, unnest(['health care', 'AI', 'staff', 'not there', c_name]) AS term FROM customer), "
    "hit AS (SELECT DISTINCT l.key, term FROM lines l JOIN terms t ON l.key = t.key AND contains(l.text, t.term) WHERE l.src = 'seed'), "
    "ranked AS (SELECT key, term, row_number() OVER (PARTITION BY key ORDER BY length(term) DESC, term) AS rank FROM hit) SELECT key, term, rank FROM ranked"
))
def k04(spark, sf):
    """Protected terms of each customer that occur in its sentences, longest first."""
    lines = corpus.seeded(spark, sf).select("key", "text")
    return protect.occurring_terms(lines, seed_terms(spark, sf), key="key").select("key", "term", F.col("rank").cast("long").alias("rank"))


@query("n06_contains_term", (
    f"WITH {corpus.LINES_SQL}, terms AS (SELECT DISTINCT p_brand AS term FROM part UNION SELECT 'staff' UNION SELECT 'AI' UNION SELECT '—' UNION SELECT c_name FROM customer) "
    "SELECT src, key, ord, term FROM lines JOIN terms ON contains(text, term)"
))
def n06(spark, sf):
    """Containment join of every line with brands, names and short terms, without comparing all pairs."""
    from proseaudit.sources import readers

    brands = readers.table(spark, sf, "part").select(F.col("p_brand").alias("term"))
    names = readers.table(spark, sf, "customer").select(F.col("c_name").alias("term"))
    extra = spark.createDataFrame([("staff",), ("AI",), ("—",)], "term string")
    terms = brands.unionByName(names).unionByName(extra).distinct()
    return protect.containing_terms(corpus.lines(spark, sf), terms, ["src", "key", "ord"])


@query("k05_micro_batches", (
    f"WITH {corpus.LINES_SQL}, n AS (SELECT src, key, ord, row_number() OVER (PARTITION BY src ORDER BY key, ord) - 1 AS i FROM lines) "
    "SELECT src, key, ord, i // 64 AS batch, i % 64 + 1 AS line FROM n"
))
def k05(spark, sf):
    """Batches of 64 per queue; one queue holds most of the rows."""
    items = corpus.lines(spark, sf).select("src", "key", "ord")
    return suggest.number_lines(items, ["src"], ["key", "ord"], 64).select("src", "key", "ord", "batch", "line")


_RESPONSE_SQL = (
    "CASE WHEN key % 3 = 0 THEN concat('Here you are:\\n1. \"', text, '\"\\n 2) no_change\\n2. second\\n3. ', text, ' !\\n1. late') "
    "WHEN key % 3 = 1 THEN concat('  ', text, ' \\n\\n''x''\\nNO_CHANGE') ELSE '' END"
).replace("\\n", "' || chr(10) || '")


def responses(spark, sf) -> DataFrame:
    """Numbered responses, plain ones and empty ones."""
    k, t = F.col("key") % 3, F.col("text")
    numbered = F.concat(F.lit('Here you are:\n1. "'), t, F.lit('"\n 2) no_change\n2. second\n3. '), t, F.lit(" !\n1. late"))
    plain = F.concat(F.lit("  "), t, F.lit(" \n\n'x'\nNO_CHANGE"))
    content = F.when(k == 0, numbered).when(k == 1, plain).otherwise("")
    return corpus.lines(spark, sf).select("src", "key", "ord", content.alias("content"))


def _dequote(x: str) -> str:
    return f"trim(trim({o.strip(x)}, '\"'), '''')"


_HAS_TEXT = f"{o.strip('text')} <> ''"


def _candidate_sql(line: str, raw: str, where: str) -> str:
    return (
        f"SELECT src, key, ord, CAST({line} AS BIGINT) AS line, {_dequote(raw)} AS candidate FROM lines "
        f"WHERE {where} AND upper({o.strip(raw)}) <> 'NO_CHANGE' AND {_dequote(raw)} <> ''"
    )


# Written out per shape. A numbered response: line 1 is the quoted text, the first use of 2 is a
# no_change and so hides the second, 3 is the text with a mark. A plain response: its non-blank lines
# in order, which shift up by one when the text is blank; but a text that is itself numbered makes
# the response a numbered one with that single line.
_QUOTED_TEXT = "concat('\"', text, '\"')"
_NUM = "'^\\s*(\\d+)[.)]\\s*(.+)$'"
_SELF_NUMBERED = f"regexp_matches(text, {_NUM})"


@query("k06_parse_candidates", (
    f"WITH {corpus.LINES_SQL} {_candidate_sql('1', _QUOTED_TEXT, 'key % 3 = 0')} UNION ALL "
    f"{_candidate_sql('3', 'concat(text, chr(32), chr(33))', 'key % 3 = 0')} UNION ALL "
    f"{_candidate_sql('1', 'text', f'key % 3 = 1 AND {_HAS_TEXT} AND NOT {_SELF_NUMBERED}')} UNION ALL "
    f"{_candidate_sql(f'regexp_extract(text, {_NUM}, 1)', f'regexp_extract(text, {_NUM}, 2)', f'key % 3 = 1 AND {_SELF_NUMBERED}')} UNION ALL "
    f"SELECT src, key, ord, CAST(CASE WHEN {_HAS_TEXT} THEN 2 ELSE 1 END AS BIGINT), 'x' FROM lines WHERE key % 3 = 1 AND NOT {_SELF_NUMBERED}"
))
def k06(spark, sf):
    return suggest.parse_candidates(responses(spark, sf), ["src", "key", "ord"]).select("src", "key", "ord", F.col("line").cast("long").alias("line"), "candidate")


@query("k07_parse_reported", (
    f"WITH {corpus.LINES_SQL} SELECT src, key, ord, CAST(ord + 1 AS BIGINT) AS line, concat('about ', CAST(key AS VARCHAR)) AS reason FROM lines WHERE key % 3 <> 2 "
    "UNION ALL SELECT src, key, ord, CAST(2 AS BIGINT), '' FROM lines WHERE key % 3 <> 2"
))
def k07(spark, sf):
    """Issues reported as JSON inside other text; a third of the responses is broken."""
    k = F.col("key")
    json = F.concat(
        F.lit('Sure: ```{"issues": [{"line": '), (F.col("ord") + 1).cast("string"), F.lit(', "reason": "about '), k.cast("string"),
        F.lit('"}, {"line": 2}]}``` done'),
    )
    df = corpus.lines(spark, sf).select("src", "key", "ord", F.when(k % 3 == 2, "no json").otherwise(json).alias("content"))
    return suggest.parse_reported(df, ["src", "key", "ord"]).select("src", "key", "ord", F.col("line").cast("long").alias("line"), "reason")


@query("n07_lines_to_items", (
    f"WITH {corpus.LINES_SQL}, n AS (SELECT src, key, ord, row_number() OVER (PARTITION BY src ORDER BY key, ord) - 1 AS i FROM lines) "
    "SELECT src, key, ord, concat('issue at ', CAST(i % 64 + 1 AS VARCHAR)) AS reason FROM n WHERE i % 64 + 1 IN (1, 64)"
))
def n07(spark, sf):
    """Reported line numbers joined back to the batch items; line 65 is out of range and finds nothing."""
    items = k05(spark, sf)
    reported = items.select("src", "batch").distinct().select(
        "src", "batch", F.explode(F.array(F.lit(1), F.lit(64), F.lit(65))).alias("line")
    ).withColumn("reason", F.concat(F.lit("issue at "), F.col("line").cast("string")))
    return items.join(reported, ["src", "batch", "line"]).select("src", "key", "ord", "reason")


@query("k08_comparable", f"WITH {corpus.LINES_SQL} SELECT src, key, ord, {o.comparable('text')} AS comparable FROM lines")
def k08(spark, sf):
    return corpus.lines(spark, sf).select("src", "key", "ord", tx.comparable("text").alias("comparable"))


@query("k09_finalize", f"WITH {corpus.LINES_SQL} SELECT src, key, ord, {o.finalize('text')} AS final FROM lines")
def k09(spark, sf):
    return corpus.lines(spark, sf).select("src", "key", "ord", tx.finalize_sentence("text").alias("final"))


# --- pairs of texts to validate -------------------------------------------------------------------------------

# Every line against variants of itself: the same, cut, tripled, two thirds of it, other words.
_VARIANTS_SQL = (
    "list_value(text, substr(text, 1, CAST(length(text) // 5 AS BIGINT)), concat(text, text, text), concat('No ', substr(text, 1, CAST(length(text) * 2 // 3 AS BIGINT))), "
    "concat('Completely different words might be here and it was taken ', CAST(key AS VARCHAR)), '')"
)
_PAIRS_SQL = (
    f"WITH {corpus.LINES_SQL}, pairs AS (SELECT src, key, ord, text AS a, generate_subscripts(v, 1) - 1 AS variant, unnest(v) AS b FROM (SELECT *, {_VARIANTS_SQL} AS v FROM lines)), "
    f"marked AS (SELECT *, {o.mark('a')} AS ta, {o.mark('b')} AS tb FROM pairs) "
)


def pairs(spark, sf) -> DataFrame:
    t, n = F.col("text"), F.length("text")
    variants = F.array(
        t, F.substring(t, F.lit(1), F.floor(n / 5).cast("int")), F.concat(t, t, t),
        F.concat(F.lit("No "), F.substring(t, F.lit(1), F.floor(n * 2 / 3).cast("int"))),
        F.concat(F.lit("Completely different words might be here and it was taken "), F.col("key").cast("string")), F.lit(""),
    )
    return corpus.lines(spark, sf).select("src", "key", "ord", t.alias("a"), F.posexplode(variants).alias("variant", "b")).withColumn("variant", F.col("variant").cast("long"))


def _long_words(t: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({t}), '‹[a-z]{{4,}}›'))"


def overlap_sql(ta: str, tb: str) -> str:
    a, b = _long_words(ta), _long_words(tb)
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len({a}) END"


def reason_sql(a: str, b: str, ta: str, tb: str, rule: str | None = None) -> str:
    extra = ""
    if rule:
        extra = (
            f"WHEN {rule} = 'positive_language' AND {o.has(tb, qr.NEGATION)} AND NOT {o.has(ta, qr.NEGATION)} THEN 'introduced_negation' "
            f"WHEN {rule} = 'active_voice' AND {o.has(tb, qr.PASSIVE)} AND NOT {o.has(ta, qr.PASSIVE)} THEN 'still_passive' "
            f"WHEN {rule} = 'active_voice' AND {o.has(tb, qr.HEDGING)} AND NOT {o.has(ta, qr.HEDGING)} THEN 'still_mushy' "
        )
    return (
        f"CASE WHEN {b} IS NULL OR {b} = '' OR length({o.strip(b)}) < 3 THEN 'empty_or_too_short' WHEN {o.comparable(a)} = {o.comparable(b)} THEN 'identical' "
        f"WHEN length({b}) > length({a}) * 2.5 THEN 'too_long' WHEN length({b}) < length({a}) * 0.25 THEN 'too_short' WHEN {overlap_sql(ta, tb)} < 0.2 THEN 'unrelated_content' "
        f"{extra}ELSE 'valid' END"
    )


@query("k10_lexical_overlap", f"{_PAIRS_SQL} SELECT src, key, ord, variant, round({overlap_sql('ta', 'tb')}, 6) AS overlap FROM marked")
def k10(spark, sf):
    return pairs(spark, sf).select("src", "key", "ord", "variant", F.round(validate.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("k11_validation", f"{_PAIRS_SQL} SELECT src, key, ord, variant, {reason_sql('a', 'b', 'ta', 'tb')} AS reason FROM marked")
def k11(spark, sf):
    return pairs(spark, sf).select("src", "key", "ord", "variant", validate.reason(F.col("a"), F.col("b")).alias("reason"))


_RULE_SQL = "CASE WHEN key % 2 = 0 THEN 'positive_language' ELSE 'active_voice' END"


@query("k12_rule_validation", f"{_PAIRS_SQL} SELECT src, key, ord, variant, {reason_sql('a', 'b', 'ta', 'tb', _RULE_SQL)} AS reason FROM marked")
def k12(spark, sf):
    rule = F.when(F.col("key") % 2 == 0, "positive_language").otherwise("active_voice")
    return pairs(spark, sf).select("src", "key", "ord", "variant", validate.reason(F.col("a"), F.col("b"), rule).alias("reason"))


_FACT_LIST = "['Customer Name', 'machine learning', 'care of', 'a b']"
_LOST = (
    f"len(list_filter({_FACT_LIST}, lambda f: len(list_filter(string_split(lower(f), ' '), lambda w: length(w) > 3)) > 0 "
    "AND len(list_filter(string_split(lower(f), ' '), lambda w: length(w) > 3 AND contains(lower(b), w))) = 0))"
)
_STRONG = " + ".join(f"CASE WHEN contains(lower(b), {o.lit(x)}) THEN 1 ELSE 0 END" for x in lx.STRENGTH_MARKS)
_WEAK = " OR ".join(f"contains(lower(b), {o.lit(x)})" for x in lx.WEAKNESS_MARKS)
_BOOSTED = "concat(b, ' strong and robust, to deliver')"


@query("k13_constraints", (
    f"{_PAIRS_SQL}, boosted AS (SELECT src, key, ord, variant, a, ta, {_BOOSTED} AS b, {o.mark(_BOOSTED)} AS tb FROM marked), base AS (SELECT *, {reason_sql('a', 'b', 'ta', 'tb')} AS r FROM boosted) "
    f"SELECT src, key, ord, variant, CASE WHEN r <> 'valid' THEN r WHEN key % 3 = 0 AND {_LOST} >= 2 THEN concat('missing_facts_', CAST({_LOST} AS VARCHAR)) "
    f"WHEN ({_STRONG}) >= 2 AND NOT ({_WEAK}) THEN 'flipped_weakness_to_strength' ELSE 'valid' END AS reason FROM base"
))
def k13(spark, sf):
    """Suggestions with strong words added, judged as rewrites of a weakness; a third must keep four facts."""
    facts = F.when(F.col("key") % 3 == 0, F.array(*[F.lit(x) for x in ("Customer Name", "machine learning", "care of", "a b")])).otherwise(F.expr("cast(array() as array<string>)"))
    b = F.concat(F.col("b"), F.lit(" strong and robust, to deliver"))
    p = pairs(spark, sf).withColumn("b", b)
    return p.select("src", "key", "ord", "variant", validate.constrained_reason(F.col("a"), F.col("b"), facts, F.lit("weakness")).alias("reason"))


# --- cascade ---------------------------------------------------------------------------------------------------------

def cascade(spark, sf) -> DataFrame:
    """Detected tone and usage issues; every fifth row has a good external candidate, every fifth a bad one."""
    tone_rules = ["positive_language", "active_voice"]
    sents = qr.sentences(spark, sf, rules.may_hold(F.col("text"), tone_rules)).withColumnRenamed("sentence", "t")
    tone = rules.detect(sents, tone_rules, text="t", scope=None)
    usage = rules.detect(corpus.lines(spark, sf).withColumn("sent_index", F.lit(-1).cast("long")), ["specificity", "inclusivity"], text="text", scope=None)
    found = tone.unionByName(usage)
    k = F.col("key") % 5
    candidate = F.when(k == 0, F.concat(F.col("found_text"), F.lit(" indeed"))).when(k == 1, F.lit("x"))
    return suggest.add_suggestions(found.withColumn("cand", candidate), "cand")


_LOST_FACTS = _LOST.replace(_FACT_LIST, "facts").replace("lower(b)", "lower(cand)")
_LIMITED_BODY = f"coalesce({qr._CONTEXT_SQL.replace('text', 'body')}, CASE WHEN {qr._LIMITED.replace('text', 'body')} THEN 'weakness' END, 'neutral')"
_FOUND_SQL = qr._SENTS + (
    f", found AS (SELECT src, key, ord, sent_index, s AS text, 'positive_language' AS rule_name FROM marked WHERE {qr._NEG_CASE} AND {qr._GATE} UNION ALL "
    f"SELECT src, key, ord, sent_index, s, 'active_voice' FROM marked WHERE ({o.has('t', qr.PASSIVE)} OR {o.has('t', qr.HEDGING)}) AND {qr._GATE} UNION ALL "
    f"SELECT src, key, ord, CAST(-1 AS BIGINT), text, 'specificity' FROM headed WHERE {qr.SPECIFIC} AND NOT {qr.heading_like('text', 't', False)} UNION ALL "
    f"SELECT src, key, ord, CAST(-1 AS BIGINT), text, 'inclusivity' FROM headed WHERE {qr.INCLUSIVE} AND NOT {qr.heading_like('text', 't', False)}), "
    f"split AS (SELECT *, regexp_extract({o.strip('text')}, {o.lit(qr._BODY)}, 1) AS heading, CASE WHEN regexp_matches({o.strip('text')}, {o.lit(qr._BODY)}) THEN regexp_extract({o.strip('text')}, {o.lit(qr._BODY)}, 2) ELSE {o.strip('text')} END AS body, {qr._CONTEXT_SQL} AS context FROM found), "
    "joined AS (SELECT *, CASE WHEN heading = '' THEN body ELSE concat(heading, ' ', body) END AS original FROM split), "
    f"tries AS (SELECT *, CASE rule_name WHEN 'positive_language' THEN {qr.positive_sql('body', 'coalesce(context, chr(110))')} WHEN 'active_voice' THEN {qr.active_sql('body')} "
    f"WHEN 'inclusivity' THEN {qr.INCLUSIVE_SQL.replace('text', 'body')} ELSE {{specific}} END AS new FROM (SELECT *, {o.mark('body')} AS t FROM joined)), "
    f"kept AS (SELECT *, CASE WHEN rule_name = 'specificity' THEN new ELSE {qr.unless_same('new', 'body')} END AS rewritten FROM tries), "
    f"full_text AS (SELECT *, {o.finalize('CASE WHEN heading = chr(0) OR heading = repeat(chr(32), 0) THEN rewritten ELSE concat(heading, chr(32), rewritten) END')} AS fallback, "
    f"CASE WHEN heading = '' THEN cand0 ELSE concat(heading, ' ', cand0) END AS cand1 FROM (SELECT *, CASE key % 5 WHEN 0 THEN concat(text, ' indeed') WHEN 1 THEN 'x' END AS cand0 FROM kept)), "
    f"finished AS (SELECT *, {o.finalize('cand1')} AS cand FROM full_text), "
    f"checked AS (SELECT *, {o.mark('original')} AS ta, {o.mark('fallback')} AS tb, {o.mark('cand')} AS tc, {o.mark('body')} AS t2 FROM finished), "
    f"fact AS (SELECT *, {_ordered_distinct('picked')} AS facts FROM (SELECT * EXCLUDE (t), t2 AS t, {_PICKED.replace('(t,', '(t2,')} AS picked FROM checked)), "
    f"judged AS (SELECT *, {reason_sql('original', 'fallback', 'ta', 'tb', 'rule_name')} AS fall_reason, CASE WHEN cand0 IS NULL THEN 'llm_no_parse' "
    f"WHEN rule_name IN ('positive_language', 'active_voice') THEN CASE WHEN {{plain}} <> 'valid' THEN {{plain}} WHEN {_LOST_FACTS} >= 2 THEN concat('missing_facts_', CAST({_LOST_FACTS} AS VARCHAR)) "
    f"WHEN {_LIMITED_BODY} = 'weakness' AND ({_STRONG.replace('lower(b)', 'lower(cand)')}) >= 2 AND NOT ({_WEAK.replace('lower(b)', 'lower(cand)')}) THEN 'flipped_weakness_to_strength' ELSE 'valid' END "
    f"ELSE {reason_sql('original', 'cand', 'ta', 'tc')} END AS cand_reason FROM fact), "
    "final AS (SELECT *, CASE WHEN cand_reason = 'valid' THEN 'external' WHEN fall_reason = 'valid' THEN 'fallback' ELSE 'no_improvement' END AS method, "
    "CASE WHEN cand_reason = 'valid' THEN cand WHEN fall_reason = 'valid' THEN fallback END AS suggestion FROM judged) "
)
_FOUND_SQL = _FOUND_SQL.replace("{plain}", reason_sql("original", "cand", "ta", "tc", "rule_name"))
_FOUND_SQL = _FOUND_SQL.replace("{specific}", qr._SPECIFIC_SQL.replace("ELSE text END", "ELSE body END"))
_REAL_SQL = f"suggestion IS NOT NULL AND suggestion <> '' AND {o.comparable('suggestion')} <> {o.comparable('text')}"


@query("k14_suggestion_cascade", f"{_FOUND_SQL} SELECT src, key, ord, sent_index, rule_name, method, suggestion FROM final")
def k14(spark, sf):
    """External candidate, else rule rewrite, else nothing."""
    return cascade(spark, sf).select("src", "key", "ord", "sent_index", "rule_name", "method", "suggestion")


@query("k14_external_candidates", f"{_FOUND_SQL} SELECT src, key, ord, sent_index, rule_name, method, suggestion, CASE WHEN cand_reason <> 'valid' THEN cand_reason END AS candidate_reject FROM final WHERE cand0 IS NOT NULL")
def k14_external(spark, sf):
    """Rows with a candidate: good ones are taken, bad ones fall back."""
    return cascade(spark, sf).where("cand is not null").select("src", "key", "ord", "sent_index", "rule_name", "method", "suggestion", "candidate_reject")


@query("k15_real_suggestions", f"{_FOUND_SQL} SELECT src, key, ord, sent_index, rule_name FROM final WHERE {_REAL_SQL}")
def k15(spark, sf):
    return suggest.keep_actionable(cascade(spark, sf)).select("src", "key", "ord", "sent_index", "rule_name")


@query("k16_rejection_tally", (
    f"{_FOUND_SQL} SELECT concat('fallback_', fall_reason) AS reason, count(*) AS n FROM final WHERE cand_reason <> 'valid' AND fall_reason <> 'valid' GROUP BY fall_reason "
    "UNION ALL SELECT CASE WHEN cand_reason IN ('llm_no_parse') THEN cand_reason ELSE concat('reject_', cand_reason) END, count(*) FROM final WHERE cand_reason <> 'valid' GROUP BY 1"
))
def k16(spark, sf):
    return suggest.rejection_tally(cascade(spark, sf))


@query("k17_analyzer_counts", f"{_FOUND_SQL} SELECT rule_name, count(*) AS total, count(*) FILTER (WHERE {_REAL_SQL}) AS with_suggestions FROM final GROUP BY rule_name")
def k17(spark, sf):
    real = validate.is_real(F.col("found_text"), F.col("suggestion"))
    return cascade(spark, sf).groupBy("rule_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(real).alias("with_suggestions"))
