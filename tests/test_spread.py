"""Work that does not depend on how few row groups a file has, and expressions that run once."""

from pyspark.sql import functions as F

from proseaudit.functions import gates, rewrite, validate
from proseaudit.functions import text as tx
from proseaudit.operators import protect, rules, segment, suggest
from proseaudit.plans import corpus, queries_names, queries_rules

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_sentences_of_one_row_group_go_to_all_tasks(spark):
    assert spark.read.parquet(f"{SF}/customer.parquet").rdd.getNumPartitions() == 1
    assert tasks(corpus.seeded(spark, SF)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert corpus.seeded(spark, SF).count() == len(corpus.SEEDS) * spark.read.parquet(f"{SF}/customer.parquet").count()


def test_names_of_one_row_group_go_to_all_tasks(spark):
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for made in (queries_names.names, queries_names.folders, queries_names.files):
        assert tasks(made(spark, SF)) == wanted


def test_split_at_is_split_and_no_pattern_is_compiled_for_each_row(spark):
    texts = ["", "a", "1a22b333", "11", "x1y", "a1", None, " 7 ", " 5 $1\\", f"a{tx.CUT}1 b {tx.CUT}22"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tx.split_at("t", "[0-9]+").alias("x"), F.split("t", "[0-9]+", -1).alias("y")).collect()
    assert all(r.x == r.y for r in got) and len(got) == len(texts)
    masked = suggest.mask_text(df.withColumnRenamed("t", "text"))
    back = masked.select("text", rewrite.unmask(F.col("mask_text"), F.col("mask_keys"), F.col("mask_values")).alias("b")).collect()
    assert all(r.text == r.b for r in back)
    assert tx.CUT in plan(masked)


def test_words_of_both_texts_are_taken_once(spark):
    pairs = [("some Words here again", "here are WORDS"), ("", "words"), ("abc", "words"), ("caféwords four5 over_it", "four"), ("alpha beta alpha", "beta gamma")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("o", validate.overlap(F.col("a"), F.col("b")))
    assert [round(r.o, 6) for r in df.collect()] == [0.5, 1.0, 1.0, 1.0, 0.5]
    assert plan(df).count("regexp_extract_all") == 2


def test_candidates_with_and_without_numbers(spark):
    rows = [(1, "1. a\r\n2) b\n\r\nplain\n99999999999. far"), (2, "first\r\r\n second "), (3, "x\n3. third")]
    got = suggest.parse_candidates(spark.createDataFrame(rows, "k long, content string"), ["k"]).collect()
    assert sorted((r.k, r.line, r.candidate) for r in got) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "first"), (2, 2, "second"), (3, 3, "third")]


def test_large_tables_that_look_small_as_files_are_not_broadcast(spark):
    texts = spark.range(3000).select("id", F.concat(F.lit("see Customer#"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(" now")).alias("text"))
    terms = texts.select(F.substr("text", F.lit(5), F.lit(18)).alias("term"))
    found = protect.containing_terms(texts, terms, ["id"], limit=10)
    assert found.count() == 3000 and found.join(texts, "id").where(F.contains("text", "term")).count() == 3000
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [piece" in joins and "BroadcastHashJoin [piece#" not in joins.replace("LeftOuter", "").split("SortMergeJoin [piece")[0]
    protected = terms.select(F.monotonically_increasing_id().alias("doc_id"), "term", F.lit("k").alias("kind"), F.lit(0).alias("pos"))
    hits = protect.occurring_terms(protected.select("doc_id", F.col("term").alias("text")), protected)
    assert "SortMergeJoin" in hits._jdf.queryExecution().executedPlan().toString() and hits.count() == 3000


def test_a_rewrite_runs_once_and_only_where_it_may_change_something(spark):
    made = queries_rules.i09(spark, SF)
    assert plan(made).count("chairperson") == 4  # two terms in the lines of documents and two in the seeded ones, not again in a filter
    texts = ["the CHAIRMAN and guys", "chairmanship", "", None, "plain", "it is Disabled"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", rewrite.inclusive(F.col("text")).alias("new"), rewrite.may_exclude(F.col("text")).alias("may")).collect()
    assert all(r.may for r in got if r.new != r.text) and [r.new for r in got if r.new != r.text] == ["the chairperson and people", "it has a disability"]


def test_lines_without_a_negative_or_harsh_word_are_not_cut_into_sentences(spark):
    rows = ["All fine. It is bad, awful!", "x. We do\tnot wait.", "good and great. strong", "It was taken. Ok.", "No", "perhaps so. We see.", None, "known. piano plays"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")
    for names in (["positive_language"], ["active_voice"], ["positive_language", "active_voice"]):
        units = segment.sentences(df)
        found = {r.id for r in rules.detect(units, names, text="sentence", scope=None).collect()}
        kept = {r.id for r in df.where(rules.may_hold(F.col("text"), names)).collect()}
        assert found and found <= kept and 2 not in kept and 7 not in kept
    for query in (queries_rules.h03, queries_rules.h04):
        tests = [line for line in plan(query(spark, SF)).split("\n") if "Filter" in line and "lower(text#" in line and "awful" in line]
        assert len(tests) == 2  # documents and seeded lines


def test_texts_are_trimmed_once_and_only_runs_of_spaces_are_replaced(spark):
    texts = ["  a\tb  c d ", '"Quoted text"', "Label: body ", "Label:", "", None, "x y", "a: b\nc", " Risk: no staff "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for made in (gates.heading_part, gates.body_part, gates.is_quoted, gates.rewrite_context, gates.constraint_context, gates.constraint_note):
        assert plan(df.select(made(F.col("t")))).count("trim(t#") == 1
    assert plan(df.select(tx.finalize_sentence("t"))).count("regexp_replace(t#") == 1
    got = df.select(tx.squeeze("t").alias("s"), gates.heading_part(F.col("t")).alias("h"), gates.body_part(F.col("t")).alias("b")).collect()
    assert [r.s for r in got] == ["a b c d", '"Quoted text"', "Label: body", "Label:", "", None, "x y", "a: b c", "Risk: no staff"]
    assert [r.h for r in got] == [None, None, "Label:", "Label:", None, None, None, None, "Risk:"]
    assert [r.b for r in got] == ["a\tb  c d", '"Quoted text"', "body", "", "", None, "x y", "a: b\nc", "no staff"]


def test_a_text_is_put_in_lower_case_once_for_all_words_looked_for(spark):
    df = spark.createDataFrame([("It FAILED", "a"), ("fail", "b"), ("fine", None), (None, "c")], "t string, u string")
    for made in (rewrite.positive(F.col("t")), rewrite.active(F.col("t")), validate.missing_facts(F.col("t"), F.array("u"))):
        assert plan(df.select(made)).split("\n")[0].count("array(lower(t#") <= 2 and plan(df.select(made)).count("Contains(lower(t#") == 0
    hit = tx.mentions(F.lower("t"), ["failed", "fail", "failure"])
    assert [r.h for r in df.select(hit.alias("h")).collect()] == [True, True, False, None] and plan(df.select(hit)).count("Contains(") == 1
    facts = F.array(F.lit("Acme Corp"), F.lit("fine day"), F.lit("ab"))
    assert [r.n for r in df.select(validate.missing_facts(F.col("t"), facts).alias("n")).collect()][:3] == [2, 2, 1]


def test_a_suggestion_is_judged_as_before_and_whole_texts_are_compared_last(spark):
    import re

    from proseaudit.functions import lexicons as lx

    def wanted(a, b, facts):
        comparable = lambda t: re.sub(r"[^\w\s]", "", t.lower()).strip()
        if b is None or len(b.strip()) < 3:
            return "empty_or_too_short"
        if comparable(a) == comparable(b):
            return "identical"
        if len(b) > len(a) * 2.5 or len(b) < len(a) * 0.25:
            return "too_long" if len(b) > len(a) * 2.5 else "too_short"
        x, y = (set(re.findall(r"(?<!\w)[a-z]{4,}(?!\w)", t.lower())) for t in (a, b))
        if x and y and len(x & y) / len(x) < 0.2:
            return "unrelated_content"
        low = b.lower()
        keys = [[w for w in f.lower().split() if len(w) > 3] for f in facts]
        lost = sum(bool(k) and not any(w in low for w in k) for k in keys)
        flipped = sum(m in low for m in lx.STRENGTH_MARKS) >= 2 and not any(m in low for m in lx.WEAKNESS_MARKS)
        return f"missing_facts_{lost}" if lost >= 2 else "flipped_weakness_to_strength" if flipped else "valid"

    words = ["".join(chr(97 + i // 26 ** k % 26) for k in range(3)) + "word" for i in range(60)]
    texts = [
        "", "  ", "ab", " a b ", "　xyz ", "a\n\nb", "The plan, was made.", "the plan was MADE!?", "the plan was mode", "the plan\nwas made \n", "a plan was made\n...",
        "ΟΔΟΣ", "οδος.", "οδοσ", "of ΟΔΟΣΣ", "漢字漢字漢", "漢字!漢字漢", "漢字漢字字", "İstan is here", "i̇stan is here",
        "Kelvin scale", "kelvin scale", "\U0001f600\U0001f600\U0001f600 good", "good \U0001f600", "x" * 10, "x" * 25, "x" * 26, "é" * 10, "é" * 26, "x" * 40, "é" * 9, "漢" * 41, "....,,,,....;;;;", "---- ----",
        "Strong and robust, to deliver", "Strong and robust, not to deliver", "a strong thing here", "It has few words, and has provided none", "foobar is here", "bar is where", "foo-bar_baz here", "well-known", "wellknown",
        " ".join(words[:35]), " ".join(words[:7] + [f"zz{w}" for w in words[:28]]), " ".join(words[:6] + [f"zz{w}" for w in words[:29]]), " ".join(words[:15]), " ".join(words[:3] + ["1234567"] * 10), " ".join(words[:2] + ["1234567"] * 10), " ".join(words[40:60]),
    ]
    facts = ["Customer Name", "machine learning", "a b"]
    df = spark.createDataFrame([(a, b) for a in texts for b in [*texts, None]], "a string, b string").repartition(4)
    a, b = F.col("a"), F.col("b")
    plain = validate.reason(a, b).alias("plain")
    judged = lambda *f: validate.constrained_reason(a, b, F.array(*[F.lit(x) for x in f]), F.lit("weakness"))
    got = df.select("a", "b", plain, judged().alias("none"), judged(*facts).alias("some")).collect()
    assert len(got) == len(texts) * (len(texts) + 1)
    for r in got:
        none = wanted(r.a, r.b, [])
        assert (r.plain, r.none, r.some) == ("valid" if none.startswith("flipped") else none, none, wanted(r.a, r.b, facts)), r
    assert {r.some for r in got} >= {"identical", "too_long", "too_short", "unrelated_content", "missing_facts_2"} and {r.none for r in got} >= {"flipped_weakness_to_strength", "valid"}
    assert spark.createDataFrame([(None, "some text")], "a string, b string").select(plain).first().plain == "valid"
    made = plan(df.select(judged(*facts)))
    assert made.count("lower(b#") == 2  # once for the whole comparison, which is behind a test of the ends, and once for all else
    assert "length(trim(" not in made and made.index("NOT RLIKE(lower(concat(") < made.index("regexp_replace(lower(a#")
