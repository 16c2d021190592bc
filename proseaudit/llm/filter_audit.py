"""How filters interact: what each removes in every order they can be applied in.

1. Every document gets a mask with a bit for each filter that it fails. Equal texts are found by SHA-256 of the text; the smallest
   id of a text is a minimum that combines before the shuffle, so a text that a third of all rows hold is no hot group.
2. Documents are counted by part and mask: at most 32 mask cells for each part, whatever the number of documents.
3. A recursive CTE extends the prefixes of filter orders with each letter they have not used, joining the cells of the part and carrying the bits
   applied so far. A level of the recursion emits the metrics of that step. A part has 325 prefixes; the 120 orders share them.

Defined cases: a null or empty text has no words and fails A alone (and E where another row with a smaller id is empty too); a null
part is the empty string. A row whose id is null never fails E and makes no other row fail it; rows of equal id and text are not copies
of each other. A document with several label rows is good or toxic if one of them says so. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from proseaudit.llm import store, text

LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
CAPITALS = (np.arange(256) >= 65) & (np.arange(256) <= 90)
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def text_masks(documents: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, same`` (SHA-256 of the text) and the ``mask`` of the filters A to D, which see one text each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in text.slices(batches, "text"):
            words = text.Words(buf, offsets)
            n, row = np.diff(words.first), words.row
            salt = text.mix(np.arange(1, batch.num_rows + 1, dtype=np.uint64))
            kinds = np.bincount(row[np.unique(words.hash ^ salt[row], return_index=True)[1]], minlength=batch.num_rows)
            fails = (
                n < MIN_WORDS, 100 * kinds < DISTINCT_PERCENT * n,
                100 * text.counted(CAPITALS[buf], offsets) > CAPITAL_PERCENT * text.counted((buf & 0xC0) != 0x80, offsets),
                text.counted(SYMBOLS[buf], offsets) > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sum(f.astype(np.int32) << i for i, f in enumerate(fails)))], ["doc_id", "part", "same", "mask"])

    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(own, 256)).alias("same"), own.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, part string, same binary, mask int")


def cells(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and mask of all five filters."""
    flags = [F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*flags)
    rows = text_masks(documents, part).join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    by_id = rows.groupBy("doc_id", "same", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    kinds = by_id.groupBy("same", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("least.doc_id").over(Window.partitionBy("same"))  # at most four rows for each part that holds the text
    fresh = F.col("no_id") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = kinds.withColumn("fresh", fresh).select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))))
    return split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _total(value: str, condition: str) -> str:
    return f"aggregate(c.cells, 0L, (s, x) -> s + if({condition}, x.{value}, 0L))"


#: A document is lost at a step if it fails the step's filter and none that was applied before.
_LOST = "x.mask & f.bit != 0 AND x.mask & p.applied = 0"
RECURSION = f"""
WITH RECURSIVE prefixes(part, prefix, applied, {", ".join(METRICS)}) AS (
  SELECT part, '', 0, {", ".join(["0L"] * len(METRICS))} FROM {{cells}}
  UNION ALL
  SELECT p.part, p.prefix || f.letter, p.applied | f.bit,
    {_total("n", "x.mask & (p.applied | f.bit) = 0")}, {_total("n", _LOST)},
    {_total("n", "x.mask & f.bit != 0 AND x.mask & p.applied != 0")}, {_total("n", "x.mask = f.bit")},
    {_total("good", _LOST)}, {_total("toxic", _LOST)}
  FROM prefixes p JOIN {{filters}} f ON p.applied & f.bit = 0 JOIN {{cells}} c ON c.part = p.part)
SELECT * FROM prefixes WHERE prefix <> ''
"""


@contextlib.contextmanager
def no_row_limit(spark: SparkSession):
    """Within it, a recursion may have any number of rows; it ends as letters run out."""
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROW_LIMIT, before)


def prefixes(counted: DataFrame) -> DataFrame:
    """The metrics of the last step of every order prefix of every part, by recursion over the letters; written."""
    spark = counted.sparkSession
    packed = counted.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))  # 32 at most
    filters = spark.createDataFrame([(letter, 1 << i) for i, letter in enumerate(LETTERS)], "letter string, bit int")
    with no_row_limit(spark):
        return store.written(spark.sql(RECURSION, cells=store.written(packed, "cells"), filters=filters), "prefixes")


def audit(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, filter_order, step``, the metrics of that step, and ``shapley``; 600 rows for each part."""
    with store.Scratch(documents.sparkSession) as scratch:
        found = prefixes(cells(documents, labels, part))
        orders = found.where(F.length("prefix") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
        step = F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step")
        steps = orders.select("part", "filter_order", step).withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
        rows = steps.join(found, ["part", "prefix"])
        rows = rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))))  # 120 rows each
        return scratch.kept(rows.select("part", "filter_order", "step", *METRICS, "shapley"), "filter-audit")


SQL = r"""
WITH m AS (
  SELECT coalesce(d.source, '') AS part, coalesce(d.text, '') AS t, d.doc_id,
    list_filter(string_split_regex(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents d),
f AS (
  SELECT m.part, m.doc_id, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(m.doc_id > min(m.doc_id) OVER (PARTITION BY t), false) AS e
  FROM m),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, coalesce(sum(l.good), 0) AS good, coalesce(sum(l.toxic), 0) AS toxic
  FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY ALL),
letters(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT o, s AS step, bits[s] AS bit, list_sum([0] || bits[1:s - 1])::INT AS applied FROM orders, range(1, 6) r(s)),
rows AS (
  SELECT part, o AS filter_order, step, bit, sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit <> 0 AND mask & applied <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM rows
"""
