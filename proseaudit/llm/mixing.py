"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells of (source, language, topic). Raking multiplies the cells' weights, margin after margin, until
the sums by source, by language and by topic meet their targets. A document is then kept with the probability of its cell, the
ratio of the cell's weight to its tokens times a common factor that makes the expected tokens of the sample ``keep`` times those
of the corpus; probabilities that would pass 1 are 1, and the factor makes up for it. The draw is a hash of the document's id.

Cells are a small distributed table, one row per combination that occurs; the corpus is read twice, for counts and for the draw.

Defined cases: a null source or language is a value of its own (empty string in the result); a null or empty text has 0 tokens
and topic 0, and is kept like its cell, with probability 0 if the whole cell is empty. Rows with the same id are drawn alike. Input columns
named like one of the result (``OWN``) are replaced; all others pass through.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from proseaudit.llm import store, text, tokens

MARGINS = ("source", "lang", "topic")
#: Columns that the result has; columns of the input with these names are replaced.
OWN = ("__source", "__lang", "__topic", "__n", "__p", "__kept")


def topic_of(buf: np.ndarray, offsets: np.ndarray, topics: int) -> np.ndarray:
    """The vocabulary group that most long words of each text fall in: words of 7 bytes or more, grouped by hash; ties go to the lowest."""
    words = text.Words(buf, offsets)
    long = words.stop - words.start >= 7
    group = (words.hash[long] % np.uint64(topics)).astype(np.int64)
    rows = len(offsets) - 1
    return np.bincount(words.row[long] * topics + group, minlength=rows * topics).reshape(rows, topics).argmax(1)


def with_topic(documents: DataFrame, topics: int, vocabulary: str | None, text_column: str = "text") -> DataFrame:
    """Add ``__topic``, and ``__n`` (tokens) if a vocabulary is given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(vocabulary) if vocabulary else None
        for batch, buf, offsets in text.slices(batches, text_column, 1 << 21):
            found = [pa.array(topic_of(buf, offsets, topics).astype(np.int32))]
            if encoder:
                found.append(pa.array(np.diff(encoder.slice(buf, offsets)[1])))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "__topic", "__n"][: len(batch.columns) + len(found)])

    more = {"__topic": F.lit(0)} | ({"__n": F.lit(0).cast("bigint")} if vocabulary else {})
    schema = documents.sparkSession.createDataFrame([], documents.schema).withColumns(more).schema
    return documents.mapInArrow(run, schema)


def named(source: str, lang: str) -> list[Column]:
    return [F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("__lang")]


def rake(cells: DataFrame, targets: dict[str, dict], flatten: float, rounds: int, tolerance: float) -> DataFrame:
    """Cells (source, lang, topic, n) with weights ``w`` whose margins meet their targets, and ``deviation``: by how much, at most, the last
    round still had to correct a margin, as a share. It is below ``tolerance`` unless targets contradict each other; then there is a warning, too.

    A margin's target shares are the given ones (values that are not named get what is left, by their own share) or else its own
    shares to the power ``flatten``, so that large values lose and small ones gain.
    """
    cells = store.written(cells.where("n > 0"), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    cells = cells.withColumn("w", F.col("n").cast("double"))
    goals = {}
    for margin in MARGINS:
        own = cells.groupBy(margin).agg(F.sum("n").alias("n"))
        if targets.get(margin):
            pairs = targets[margin].items()
            wish = F.element_at(F.create_map(*[F.lit(x) for k, v in pairs for x in (str(k), float(v))]), F.col(margin).cast("string"))
            rest = max(0.0, 1.0 - float(sum(targets[margin].values())))
            unnamed = own.where(wish.isNull()).agg(F.sum("n")).first()[0] or 1
            share = F.coalesce(wish, rest * F.col("n") / F.lit(unnamed))
        else:
            share = F.pow(F.col("n") / F.lit(max(1, total)), F.lit(flatten))
        own = store.written(own.withColumn("goal", share), "goals")
        scale = own.agg(F.sum("goal")).first()[0] or 1.0
        goals[margin] = own.select(margin, (F.col("goal") * F.lit(total / scale)).alias("goal"))
    largest = 0.0
    for _ in range(rounds):
        off = None
        for margin in MARGINS:
            sums = cells.groupBy(margin).agg(F.sum("w").alias("sum")).join(goals[margin], margin).select(margin, (F.col("goal") / F.col("sum")).alias("by"))
            cells = cells.join(sums, margin).withColumn("w", F.col("w") * F.col("by"))
            off = F.abs(F.col("by") - 1) if off is None else F.greatest(off, F.abs(F.col("by") - 1))
            cells = cells.withColumn("off", off).drop("by")
            off = F.col("off")
        cells = store.written(cells, "cells")
        largest = cells.agg(F.max("off")).first()[0] or 0.0
        cells = cells.drop("off")
        if largest < tolerance:
            break
    else:
        warnings.warn(f"after {rounds} rounds of raking a margin was still {largest:.2g} off its target", stacklevel=2)
    return cells.withColumn("deviation", F.lit(float(largest)))


def calibrated(cells: DataFrame, keep: float) -> DataFrame:
    """Add the probability ``p``: the expected tokens are ``keep`` times the tokens of all cells."""
    total, weight = cells.agg(F.sum("n"), F.sum("w")).first()
    if not total:
        return cells.withColumn("p", F.lit(0.0))
    factor = keep * total / weight
    known = 0
    while True:  # as long as more cells reach probability 1, so it ends
        full = F.col("w") * factor >= F.col("n")
        fixed, free, reached = cells.agg(
            F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        if not free or reached <= known:
            break
        known, factor = reached, max(factor, (keep * total - fixed) / free)
    return cells.withColumn("p", F.least(F.lit(1.0), F.lit(factor) * F.col("w") / F.col("n")))


def drawn(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(
    documents: DataFrame, targets: dict[str, dict] | None = None, keep: float = 0.6, flatten: float = 0.7, topics: int = 16, rounds: int = 50,
    tolerance: float = 1e-4, seed: int = 11, vocabulary: str | None = None, source: str = "source", lang: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """(documents with ``__source, __lang, __topic, __p, __kept`` added, cells with their weights and probabilities)."""
    documents = documents.drop(*OWN)
    slim = documents.select(*named(source, lang), F.col("text").cast("string").alias("text"))
    counted = with_topic(slim, topics, vocabulary or tokens.vocabulary()).groupBy("__source", "__lang", "__topic").agg(F.sum("__n").alias("n"))
    cells = counted.select(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), "n")
    cells = store.written(calibrated(rake(cells, targets or {}, flatten, rounds, tolerance), keep), "cells")
    chances = cells.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), F.col("p").alias("__p"))
    rows = with_topic(documents.select("*", *named(source, lang)), topics, None)
    rows = rows.join(chances, ["__source", "__lang", "__topic"], "left").withColumn("__p", F.coalesce("__p", F.lit(0.0)))
    return rows.withColumn("__kept", drawn(F.col("doc_id"), seed) < F.col("__p")), cells
