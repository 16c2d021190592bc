"""Removing repeated lines, exact or one word apart, with DataFrame functions only.

A line is a run of words between ``\\n``; lines of fewer than ``min_words`` words are left alone. Two lines are near if one word
inserted, deleted or replaced turns one into the other (similarity 0.8 or more, as lines have five words). A line is removed if an equal or near line stands
earlier, in a smaller document or higher up; lines are judged on the input, not on what is left.

Deletion neighbourhood: a line's variants are the line itself and the line without its i-th word. Near lines share a variant
that each made without a word, or without the same i-th word. So for a variant the earliest line by i is enough, and no pairs
are formed within a group. Lines that can have no near line make no variants: near lines share their first or their last half, and only lines
that share such a half with another distinct line go on. Equal lines are counted once throughout.

Defined cases: a null text stays null; an empty one stays empty; rows of equal id and text are one document; a null id
comes first. A text whose lines all go becomes empty. Other columns pass through; none of theirs may start with ``__line``.
Variants of a candidate line cost its words times its length; candidates with a hundred thousand words are slow, but not wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from proseaudit.llm import store


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not once for each use inside it."""
    return F.transform(F.array(value), body)[0]


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), "")


def plain(line: Column) -> Column:
    """The words with one space between them. Most lines are so already, which byte searches tell without cutting them into words."""
    odd = line.startswith(" ") | line.endswith(" ")
    for part in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd |= line.contains(part)
    return F.when(odd, F.array_join(words_of(line), " ")).otherwise(line)


def count_words(plain_line: Column) -> Column:
    spaces = F.octet_length(plain_line) - F.octet_length(F.replace(plain_line, F.lit(" "), F.lit("")))
    return F.when(plain_line == "", 0).otherwise(spaces + 1)


def first_words(plain_line: Column, n: Column) -> Column:
    """The first n words; without its last -n words where n is negative."""
    return F.call_function("substring_index", plain_line, F.lit(" "), n)


def left_out(plain_line: Column, n: Column, i: Column) -> Column:
    """The words, of which there are n, but for the one at place i, from 0."""
    head, tail = first_words(plain_line, i), first_words(plain_line, i - n + 1)
    return F.when(i == 0, tail).when(i == n - 1, head).otherwise(F.concat(head, F.lit(" "), tail))


def without(words: Column, i: Column) -> Column:
    """The words but for the one at place i, from 0."""
    return F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words)))


def keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("__line_key", F.xxhash64(F.col("doc_id").cast("string"), "text"))


def occurrences(documents: DataFrame, min_words: int) -> DataFrame:
    """One row per line: hash of its words, place, and the keys of its halves (for both lengths that a near line can share)."""
    lines = keyed(documents).select("doc_id", "__line_key", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    lines = lines.withColumn("words", plain(F.col("words"))).withColumn("n", count_words(F.col("words"))).where(F.col("n") >= min_words)
    m, less = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")

    def halves(m: Column) -> list[Column]:
        return [F.xxhash64(F.lit(side), m, first_words(F.col("words"), n)) for side, n in ((1, m), (2, -m))]

    (a, b), (c, d) = halves(m), [F.when(m != less, k) for k in halves(less)]
    return lines.select(F.xxhash64("words").alias("h"), F.struct("doc_id", F.col("__line_key").alias("key"), "line").alias("at"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))


def candidates(distinct: DataFrame) -> DataFrame:
    """Distinct lines that share a half with another one: hash, first place, and whether they share a first and a last half."""
    sides = F.array(*[F.struct(F.col(c).alias("half"), F.lit(c in "ac").alias("head")) for c in "abcd"])
    halves = distinct.select("h", F.inline(sides)).where("half IS NOT NULL")
    shared = halves.groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("half")
    which = halves.join(shared, "half", "left_semi").groupBy("h").agg(F.max("head").alias("head"), F.max(~F.col("head")).alias("tail"))
    return distinct.select("h", "at").join(which, "h")


def near(documents: DataFrame, candidate: DataFrame) -> DataFrame:
    """Hashes of candidate lines that have an earlier near line."""
    wanted = candidate.groupBy(F.col("at.key").alias("__line_key")).agg(F.collect_list(F.struct("h", "at", "head", "tail")).alias("wanted"))
    texts = keyed(documents.select("doc_id", "text")).join(wanted, "__line_key").select("wanted", "text")
    found = texts.select(F.explode(let(F.split("text", "\n"), lambda lines: F.transform("wanted", lambda x: F.struct(x["h"].alias("h"), x["at"].alias("at"), x["head"].alias("head"), x["tail"].alias("tail"), F.element_at(lines, x["at"]["line"] + 1).alias("words"))))).alias("x"))
    lines = store.written(found.select("x.h", "x.at", "x.head", "x.tail", plain(F.col("x.words")).alias("words")).dropDuplicates(["h"]).withColumn("n", count_words(F.col("words"))), "near-lines")
    n = F.col("n")
    half = F.floor((n - 1) / 2).cast("int")  # a line that shares only its first half differs after it, and the other way round
    first, last = F.when(F.col("tail"), 0).otherwise(half), n - F.when(F.col("head"), 1).otherwise(half + 1)
    variants = lines.select("h", "at", F.explode(F.transform(
        F.concat(F.array(F.lit(-1)), F.sequence(first, last)),
        lambda i: F.struct(i.alias("i"), F.xxhash64(F.when(i < 0, F.col("words")).otherwise(left_out(F.col("words"), n, i))).alias("v")))).alias("x"))
    variants = store.written(variants.select("h", "at", "x.i", "x.v"), "variants")
    first = variants.groupBy("v", "i").agg(F.min("at").alias("first"))
    by_variant = Window.partitionBy("v")  # at most one row for each word of the line
    whole = F.min(F.when(F.col("i") < 0, F.col("first"))).over(by_variant)
    best = F.when(F.col("i") < 0, F.min("first").over(by_variant)).otherwise(F.least("first", whole))
    earlier = variants.join(first.select("v", "i", best.alias("best")), ["v", "i"]).where("best < at").groupBy("h").agg(F.min("at").alias("at"), F.collect_set("best").alias("best"))
    other = lines.select(F.col("at").alias("best"), F.col("words").alias("other"))
    pairs = earlier.select("h", F.explode("best").alias("best")).join(other, "best").join(lines.select("h", "words"), "h")
    return pairs.where(let(F.split("words", " "), lambda a: let(F.split("other", " "), lambda b: one_apart(a, b)))).select("h").distinct()


def one_apart(a: Column, b: Column) -> Column:
    """Whether one word inserted, deleted or replaced turns a into b."""
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    same = F.size(a) == F.size(b)
    drop_one = F.exists(F.sequence(F.lit(0), F.size(longer) - 1), lambda i: without(longer, i) == F.when(same, without(shorter, i)).otherwise(shorter))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & drop_one


def removed_lines(documents: DataFrame, min_words: int = 5) -> DataFrame:
    """Line numbers to remove: ``__line_key``, ``__line_gone`` (ascending, from 0)."""
    with store.Scratch(documents.sparkSession) as scratch:
        found = store.written(occurrences(documents, min_words), "lines")
        distinct = store.written(found.groupBy("h").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in "abcd"]), "distinct-lines")
        gone = near(documents, candidates(distinct)).withColumn("near", F.lit(True))
        judged = store.written(distinct.select("h", F.col("at").alias("first"), "n").join(gone, "h", "left").where("n > 1 or near"), "judged-lines")
        total = distinct.agg(F.sum("n")).first()[0] or 0
        heavy = F.col("n") * 1000 >= total  # at most a thousand lines can be so frequent: their verdicts go to the rows
        often, rows = F.broadcast(judged.where(heavy)), found.select("h", "at")
        rows = rows.join(often, "h").union(rows.join(often.select("h"), "h", "left_anti").join(judged.where(~heavy), "h"))
        rows = rows.where("near or at > first").select("at.key", "at.line")
        gone = rows.groupBy(F.col("key").alias("__line_key")).agg(F.sort_array(F.collect_set("line")).alias("__line_gone"))
        return scratch.kept(gone, "removed-lines")


def dedup(documents: DataFrame, min_words: int = 5) -> DataFrame:
    """The documents without repeated lines, and ``__line_n`` (lines) and ``__line_removed`` (lines removed)."""
    rows = keyed(documents).join(removed_lines(documents, min_words), "__line_key", "left")

    def rest(lines: Column) -> Column:
        edge = F.concat(F.array(F.lit(-1)), F.col("__line_gone"), F.array(F.size(lines)))
        kept = let(edge, lambda e: F.flatten(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda j: F.slice(lines, F.element_at(e, j) + 2, F.element_at(e, j + 1) - F.element_at(e, j) - 1))))
        return F.array_join(kept, "\n")

    kept = F.when(F.col("__line_gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest))
    count = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return rows.withColumns({"__line_n": F.when(F.col("text").isNull(), 0).otherwise(count), "__line_removed": F.coalesce(F.size("__line_gone"), F.lit(0)), "text": kept}).drop("__line_key", "__line_gone")


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, i, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM lines),
long AS (SELECT doc_id, i, w FROM cut WHERE len(w) >= 5),
firsts AS (SELECT w, min({'d': doc_id, 'i': i}) AS a FROM long GROUP BY w),
variants AS (
  SELECT a, w AS v, -1 AS k FROM firsts
  UNION ALL SELECT a, w[:k - 1] || w[k + 1:], k FROM (SELECT a, w, unnest(range(1, len(w) + 1)) AS k FROM firsts)),
best AS (SELECT v, k, min(a) AS a FROM variants GROUP BY v, k),
near AS (
  SELECT DISTINCT x.a FROM variants x JOIN best b ON x.v = b.v AND (x.k = b.k OR x.k = -1 OR b.k = -1) WHERE b.a < x.a),
gone AS (
  SELECT l.doc_id, l.i FROM long l JOIN firsts f ON l.w = f.w LEFT JOIN near n ON n.a = f.a
  WHERE n.a IS NOT NULL OR f.a < {'d': l.doc_id, 'i': l.i})
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS INTEGER) AS n_lines,
  CAST(coalesce(g.n, 0) AS INTEGER) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
LEFT JOIN (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS t FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id) k ON k.doc_id = d.doc_id
"""
