"""Golden rows and invariants of the rewriting rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from proseaudit.functions import gates, rewrite, spans, validate
from proseaudit.functions import text as tx
from proseaudit.operators import catalogue, rules, sentiment, suggest
from proseaudit.sources import readers

GOLDEN = {
    "contractions": [("We can't ship", "We cannot ship"), ("Don't go", "Do not go"), ("CAN'T", "Cannot"), ("cant", None)],
    "and_or": [("docs and/or reports", "docs or reports"), ("and / or", None)],
    "ampersand": [("R & D", "R and D"), ("R&D", None)],
    "numerals_spell_out": [
        ("5 people attended", "Five people attended"), ("21 rows", "Twenty-one rows"), ("Total: 7 items", "Total: Seven items"),
        ("(9 left)", "(Nine left)"), ("We have 5 people", None), ("5-10 items", None), ("10 percent", None), ("3rd place", None),
        ("3.5 units", None), ("See p.5 now", None), ("See p. 5 now", "See p. Five now"),
    ],
    "numerals_commas": [
        ("We sold 12345 units", "We sold 12,345 units"), ("1500 units", "1,500 units"), ("4001 rows", "4,001 rows"), ("A12345", "A12,345"),
        ("In 2024 we", None), ("3999 rows", None), ("ID12345", None), ("5000GB", None), ("10000.50", None),
        ("4785380592391139", "4,785,380,592,391,139"),
    ],
    "period_spacing": [("One.  Two!   Three", "One. Two! Three"), ("One. Two", None)],
    "quotation_marks": [('He said "yes".', 'He said "yes."'), ('"a" , b', '"a," b'), ('use "x;" now', 'use "x"; now'), ("users', and", "users,' and")],
    "hyphens": [("a -- b—c - d", "a – b–c - d"), ("a-b", None)],
    "word_list": [
        ("health care and Machine Learning", "healthcare and Machine Learning"), ("user friendly", "user-friendly"),
        ("Use e.g. tools", "Use e.g., tools"), ("E.g. x", "e.g., x"), ("i.e., x", None),
    ],
}


@pytest.mark.parametrize("rule", sorted(GOLDEN))
def test_golden(spark, rule):
    rows = GOLDEN[rule]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.suggestion for r in rules.detect(df, [rule], text="t", scope=None).collect()}
    assert [got.get(i) for i in range(len(rows))] == [want for _, want in rows]


def test_protected_span(spark):
    df = spark.createDataFrame([(1, "We can't ship, don't", ["can't", ""]), (2, "We can't ship", ["can't"])], "i int, t string, p array<string>")
    got = {r.i: r.suggestion for r in rules.detect(df, ["contractions"], text="t", scope=None, terms="p").collect()}
    assert got == {1: "We can't ship, do not"}


def random_texts(n=400, seed=7):
    rng = random.Random(seed)
    pieces = ["can't", "Don't", "5", "12345", "2024", "p.", "pp", " & ", "and/or", "--", "—", ".  ", "! ", '"', "'", ",", ";", ":", " ", "  ", "é", "word", "A-", "%", "percent", "(", "0.5", "e.g.", "\n", "–"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("column", [rules.expand_contractions, rules.replace_and_or, rules.replace_ampersand, rules.single_space, rules.en_dashes])
def test_rewriting_twice_changes_nothing_more(one, column):
    # two ampersands that share their space are one match, so the second is left for the next pass
    texts = [t for t in random_texts(150, 3) if not re.search(r"&\s+&", t)]
    once = one(column, *texts)
    assert one(column, *once) == once


def test_offsets(one):
    texts = ["a12é345", "", "none", "9"]
    got = one(lambda c: spans.located(c, "[0-9]+"), *texts)
    assert [[(s.start, s.end, s.text) for s in r] for r in got] == [[m.span() + (m.group(),) for m in re.finditer("[0-9]+", t)] for t in texts]


MASKED = [
    ("Spend $5 by May 2, 2025", "Spend $[NUM_0] by May [NUM_1], [NUM_2]"), ("1,234.5 units of 12", "[NUM_0] units of [NUM_1]"), ("no figures here", "no figures here"),
    ("mail ann@mail.example.com today", "mail [LINK_0] today"), ("x9 stays, 9x too", "x9 stays, 9x too"), ("99999999999999999999", "[NUM_0]"), ("", ""),
]


def test_mask_and_unmask(spark):
    texts = [t for t, _ in MASKED] + random_texts(200, 5)
    df = suggest.mask_text(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    back = rewrite.unmask(F.col("mask_text"), F.col("mask_keys"), F.col("mask_values"))
    rows = df.select("i", "mask_text", back.alias("back")).orderBy("i").collect()
    assert [r.mask_text for r in rows[: len(MASKED)]] == [m for _, m in MASKED]
    assert [r.back for r in rows] == texts


def test_facts_are_all_kept_unless_limited(one):
    text = "Ann Lee, Bo Kay, Cy Dee and Di Fox met on 1, 2 and 3"
    assert one(rewrite.facts, text) == [["Ann Lee", "Bo Kay", "Cy Dee", "Di Fox", "1", "2", "3"]]
    assert one(lambda c: rewrite.facts(c, names=3, figures=2, terms=2, most=4), text) == [["Ann Lee", "Bo Kay", "Cy Dee", "1"]]


def test_gates(one):
    assert one(gates.has_negative_phrase, "The system is not user-friendly.", "No issues were found.", "We never ship late.", "We don't agree.", "We cannot ship.") == [True, True, False, False, True]
    assert one(gates.is_passive, "It was created", "It is broken", "It runs") == [True, True, False]
    assert one(gates.has_hedging, "It might be late") == [True]
    assert one(gates.is_heading_like, "Key Strengths", "Project Scope:", "We ship it now", "Release Notes") == [True, True, False, True]
    assert one(gates.is_quoted, '"Yes."', "He said yes", "'a'") == [True, False, True]


def test_rewrites(one):
    assert one(lambda c: tx.finalize_sentence(rewrite.active(c)), "It might be late", "We are looking for help") == ["It is late.", "We are seek help."]
    assert one(lambda c: tx.finalize_sentence(rewrite.positive(c)), "We do not have staff") == ["We lack staff."]
    assert one(lambda c: rewrite.positive(c, F.lit("weakness")), "We do not have staff") == ["We do not have staff"]
    assert one(rewrite.specific, "People currently wait") == ["People [as of Month Year] wait"]
    assert one(rewrite.inclusive, "The chairman is disabled") == ["The chairperson has a disability"]
    assert one(tx.finalize_sentence, "Hello world", "Title:") == ["Hello world.", "Title:"]


def test_validation(spark):
    pairs = [("a good text here", "A good text, here!"), ("short text", "short text " * 3), ("completely fine words", "unrelated content entirely"), ("abc def", None), ("some words again", "again some words now")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.r for r in df.select("i", validate.reason(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()]
    assert got == ["identical", "too_long", "unrelated_content", "empty_or_too_short", "valid"]


def test_candidates(spark):
    df = spark.createDataFrame([(1, "1. A\n2) B\n2. C"), (2, "x\n\n 'y'"), (3, "1. NO_CHANGE\n1. late"), (4, "")], "i int, content string")
    got = {(r.i, r.line): r.candidate for r in suggest.parse_candidates(df, ["i"]).collect()}
    assert got == {(1, 1): "A", (1, 2): "B", (2, 1): "x", (2, 2): "y"}


def test_cascade_prefers_a_valid_candidate(spark):
    df = spark.createDataFrame(
        [(1, "active_voice", "tone", "It was created by staff today.", "Staff created it today."), (2, "active_voice", "tone", "It was created by staff today.", "x"), (3, "inclusivity", "usage", "He waits.", None)],
        "i int, rule_name string, category string, found_text string, cand string",
    ).withColumns({"suggestion": F.lit(None).cast("string"), "method": F.lit("rule-based")})
    got = {r.i: (r.method, r.suggestion) for r in suggest.add_suggestions(df, "cand").collect()}
    assert got == {1: ("external", "Staff created it today."), 2: ("fallback", "It creates by staff today."), 3: ("no_improvement", None)}
    assert [r.i for r in suggest.keep_actionable(suggest.add_suggestions(df, "cand")).collect()] == [1, 2]


def test_user_rules_run_beside_the_built_in_ones(spark):
    mine = rules.Rule("shouting", "tone", "info", "No shouting", lambda c, low: c.rlike("!{2,}"), lambda c, terms: F.regexp_replace(c, "!{2,}", "!"))
    df = spark.createDataFrame([("No!! & yes",)], "t string")
    got = {r.rule_name: r.suggestion for r in rules.detect(df, ["ampersand", mine], text="t", scope=None).collect()}
    assert got == {"ampersand": "No!! and yes", "shouting": "No! & yes"}


def test_a_bad_rule_is_left_out(spark):
    bad = rules.Rule("bad", "tone", "info", "x", lambda c, low: F.col("no_such_column") > 1)
    worse = rules.Rule("worse", "tone", "info", "x", lambda c, low: 1 / 0)
    df = spark.createDataFrame([("R & D",)], "t string")
    with pytest.warns(UserWarning, match="left out"):
        got = rules.detect(df, ["ampersand", bad, worse], text="t", scope=None).collect()
    assert [r.rule_name for r in got] == ["ampersand"]


def test_sentiment_takes_any_lexicon(one):
    lexicon = {"dire": -3.0, "fine": 2.0}
    plain, strong, turned = one(lambda c: rules.sentiment(c, lexicon, {"very": 0.5}, ["not"]), "It is dire", "It is very dire", "It is not very dire")
    assert strong < plain < 0 < turned < 1
    assert one(lambda c: rules.sentiment(c, lexicon), "very fine") == [2 / 19 ** 0.5]


def test_a_rule_that_fails_on_one_value_gives_one_error_row(spark):
    """Everything else stands; the setting of the session does, too."""
    ratio = rules.Rule("ratio", "tone", "info", "x", lambda c, low: 10 / F.length(F.regexp_replace(c, "[^x]", "")) > 4)
    number = rules.Rule("number", "tone", "info", "x", lambda c, low: F.substring(c, 1, 1).cast("int") > 3, reason=lambda c: F.substring(c, 1, 1))
    df = spark.createDataFrame([(1, "R & D xx"), (2, "9 & no"), (3, "5 xxx can't")], "i int, t string")
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    found = rules.detect(df, ["ampersand", "contractions", ratio, number], text="t", scope=None)
    assert spark.conf.get("spark.sql.ansi.enabled") == ansi
    got = sorted((r.i, r.rule_name, r.category) for r in found.collect())
    assert got == [(1, "ampersand", "grammar"), (1, "number", rules.FAILED), (1, "ratio", "tone"), (2, "ampersand", "grammar"), (2, "number", "tone"), (2, "ratio", rules.FAILED), (3, "contractions", "grammar"), (3, "number", "tone")]
    assert rules.detect(df, [ratio], text="t", scope=None).count() == 2


@pytest.mark.parametrize("limit", [200_000, 0])
@pytest.mark.parametrize("modified", [False, True])
def test_lexicon_table_equals_the_pattern(spark, limit, modified):
    rng = random.Random(9)
    weights, more, turn = {"dire": -3.0, "fine": 2.0, "bad": -2.5, "énorme": 1.5}, {"very": 0.5, "really": 0.25}, ["not", "never"]
    words = [*weights, *more, *turn, "it", "is", "dires", "Fine", "BAD"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", ", ", "\t", "-", ". "]) for _ in range(rng.randrange(12))) for _ in range(400)] + ["", "not very dire", "dire"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sentence string")
    table = lambda d: spark.createDataFrame(list(d.items()), "word string, weight double")
    modifiers = {"boosters": table(more), "negators": turn} if modified else {}
    got = {r.i: r.compound for r in sentiment.lexicon_scores(df, table(weights), ["i"], limit=limit, **modifiers).collect()}
    plain = rules.sentiment(F.col("sentence"), weights, **({"boosters": more, "negators": turn} if modified else {}))
    want = {r.i: r.x for r in df.select("i", plain.alias("x")).collect()}
    assert all(abs(got.get(i, 0.0) - x) < 1e-12 for i, x in want.items()) and len(got) > 300


def test_words_of_a_small_lexicon_are_looked_up_within_the_row(spark):
    """Neither a join nor groups of sentences, whose number would fill the memory of a task; the joined forms give the same."""
    texts = ["bad fine", "BAD, bad\tbad", "fine", "none", "", None, "very bad", "not very fine", "even odd", "énorme"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sentence string")
    rows = [("bad", -2.5), ("bad", -0.5), ("fine", 2.0), ("énorme", 1.5), ("odd", None), (None, 1.0), ("even", 0.0)]
    lexicon = spark.createDataFrame(rows, "word string, weight double")
    boosters = spark.createDataFrame([("very", 0.5)], "word string, weight double")
    score = lambda s: s / (s * s + 15) ** 0.5
    plain = {0: -1.0, 1: -9.0, 2: 2.0, 6: -3.0, 7: 2.0, 8: 0.0, 9: 1.5}
    for more, sums in (({}, plain), ({"boosters": boosters, "negators": ["not"]}, plain | {6: -3.5, 7: -0.75 * 2.5}), ({"negators": ["not"]}, plain)):
        for sizes in ({}, {"inline": 0}, {"inline": 0, "limit": 0}):
            scores = sentiment.lexicon_scores(df, lexicon, ["i"], **sizes, **more)
            assert {r.i: round(r.compound, 12) for r in scores.collect()} == {i: round(score(s), 12) for i, s in sums.items()}, (more.keys(), sizes)
            used = scores._jdf.queryExecution().executedPlan().toString()
            assert any(x in used for x in ("Aggregate", "Join", "Exchange")) == bool(sizes)


def test_a_lexicon_is_a_constant_only_if_it_is_small(spark):
    lexicon = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("word"), (F.col("id") / 7 - 300).alias("weight"))
    df = spark.range(5000).select("id", F.concat(F.lit("a W"), "id").alias("sentence"))
    small, large = (sentiment.lexicon_scores(df, lexicon, ["id"], inline=n) for n in (5000, 4999))
    assert "Join" not in small._jdf.queryExecution().executedPlan().toString() and "Join" in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(small.collect()) == sorted(large.collect()) and small.count() == 5000


def test_no_word_of_a_lexicon_is_lost_in_the_constant(spark):
    """JSON readers end names at 50,000 characters; infinite weights, quotes and letters of two code units stand in JSON, too."""
    words = {"x" * 60_000: -1.0, "y" * 1000: -2.0, "\U0001d49c": 3.0, "endless": float("inf"), "\\\"'": 1.0, "tiny": 1e-300, "third": 1 / 3}
    for kept in (words, {w: x for w, x in words.items() if len(w) <= sentiment.LONGEST}, {}):
        lexicon = spark.createDataFrame(list(kept.items()), "word string, weight double")
        df = spark.createDataFrame([(i, f"a {w} b") for i, w in enumerate(words)], "i int, sentence string")
        got, want = ({r.i: repr(r.compound) for r in sentiment.lexicon_scores(df, lexicon, ["i"], inline=n).collect()} for n in (100, 0))
        assert got == want and len(got) == len(kept) - bool(kept)


def test_a_lexicon_of_ten_thousand_rows_from_a_folder(spark, tmp_path):
    out = str(tmp_path / "lexicon")
    spark.range(10_000).select(F.concat(F.lit(" W"), F.col("id").cast("string")).alias("word"), (F.col("id") % 7 - 3).cast("double").alias("weight")).write.json(out)
    spark.createDataFrame([("w5", -9.0), ("", 1.0), ("x", None), (None, 1.0)], "word string, weight double").write.mode("append").json(out)
    lexicon = readers.lexicon(spark, out)
    assert lexicon.count() == 10_000
    df = spark.createDataFrame([(1, "W5 and w9999 w9999x"), (2, "none")], "i int, sentence string")
    total = -9.0 + (9999 % 7 - 3)
    assert [tuple(r) for r in sentiment.lexicon_scores(df, lexicon, ["i"]).collect()] == [(1, total / (total * total + 15) ** 0.5)]


def test_catalogue(spark):
    cat = catalogue.catalogue(spark)
    assert cat.count() == 19 and catalogue.select_rules(cat, critical=True).count() == 5 and catalogue.select_rules(cat, with_pattern=True).count() == 14
    df = spark.createDataFrame([("you use AI, ML and APIs etc. — a &b and/or don't",)], "text string")
    got = {r.rule_name: r.hits for r in catalogue.pattern_hits(df).collect()}
    assert got == {"avoid_second_person": 1, "acronym_expansion": 2, "oxford_comma": 1, "avoid_etc": 1, "en_dash_usage": 1, "avoid_and_or": 1, "avoid_contractions": 1}
