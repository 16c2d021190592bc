"""Quality rules: fixed text statistics, and a classifier over hashed word and character n-grams.

The classifier is a logistic regression trained on labelled rows, calibrated on rows it was not trained on, and applied to
Arrow batches with a fixed threshold. Features are relative frequencies of hashed words, word pairs and character four-grams,
so they do not depend on the length of a text.

Defined cases: a null or empty text has no words and fails the base rules. Repeated rows and equal texts get equal results.
Labels that are null, or whose document is missing, are ignored; without labels, or with only one kind, the probability is the
smoothed share of good labels. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from proseaudit.llm import text

BITS = 16
SIZE = 3 << BITS
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SCORES = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean"


def statistics(buf: np.ndarray, offsets: np.ndarray, words: text.Words, sums: np.ndarray) -> dict[str, np.ndarray]:
    """Word, symbol and repetition counts of each row of a slice."""
    rows = len(offsets) - 1
    salt = text.mix(np.arange(1, rows + 1, dtype=np.uint64))
    code_points = words.inside & ((buf & 0xC0) != 0x80)

    breaks = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([breaks + 1, offsets[:-1]]))
    stop = np.sort(np.concatenate([breaks, offsets[1:]]))
    row = np.searchsorted(offsets, start, side="right") - 1
    # An empty row shares its offset with the next one; such a line has no word, so its row does not matter.
    full = np.searchsorted(words.start, start) < np.searchsorted(words.start, stop)
    start, stop, row = start[full], stop[full], row[full]
    keys = text.spans(sums, start, stop) ^ salt[row]
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False

    repeated = np.zeros(len(words.hash) + 1, np.int64)
    keys, at, owner = words.windows(WINDOW)
    keys ^= salt[owner]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    np.add.at(repeated, at[twice], 1)
    np.add.at(repeated, at[twice] + WINDOW, -1)
    return {
        "n_words": np.diff(words.first),
        "word_chars": text.counted(code_points, offsets),
        "n_symbols": text.counted(SYMBOLS[buf], offsets),
        "n_dup_lines": np.bincount(row[again], minlength=rows),
        "n_repeat_words": text.counted(np.cumsum(repeated[:-1]) > 0, words.first),
    }


def hashed(buf: np.ndarray, offsets: np.ndarray, words: text.Words, sums: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, row) of every word, word pair and character four-gram; the kinds use separate ranges of features."""
    shift = np.uint64(64 - BITS)
    pair, _, pair_row = words.windows(2)
    gram = text.windows(sums, 4)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(owner[: len(gram)] == owner[3: 3 + len(gram)])
    return [
        ((words.hash >> shift).astype(np.int32), words.row),
        ((pair >> shift).astype(np.int32) + (1 << BITS), pair_row),
        ((gram[inside] >> shift).astype(np.int32) + (2 << BITS), owner[inside]),
    ]


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features, an intercept, and the calibration ``sigmoid(slope * score + shift)``."""

    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, features: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
        score = np.zeros(rows)
        for feature, row in features:
            n = np.bincount(row, minlength=rows)
            score += np.bincount(row, self.weights[feature], minlength=rows) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -50, 50)))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000, seed: int = 7) -> Model:
    """Train on at most ``sample`` labelled rows, chosen by hash, four fifths for the weights and the rest for the calibration.

    The bounded sample goes to one task; the model, 768 KB, comes back to the driver.
    """
    ids = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y")).dropna()
        .groupBy("__id").agg(F.min("__y").alias("__y"))
        .orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(sample)
    )
    rows = documents.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "__id")
    features = rows.mapInArrow(_features, "id bigint, y int, feature binary, value binary")
    found = features.repartition(1).mapInArrow(_train, "weights binary, slope double, shift double").collect()
    return Model(np.frombuffer(found[0].weights, np.float32), found[0].slope, found[0].shift)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, offsets in text.slices(batches, "text"):
        sums = text.byte_sums(buf)
        parts = hashed(buf, offsets, text.Words(buf, offsets, sums), sums)
        out: list[tuple[bytes, bytes]] = []
        for i in range(batch.num_rows):
            found = []
            for feature, row in parts:
                lo, hi = np.searchsorted(row, [i, i + 1])
                which, n = np.unique(feature[lo:hi], return_counts=True)
                found.append((which, (n / max(1, hi - lo)).astype(np.float32)))
            out.append((np.concatenate([x[0] for x in found]).tobytes(), np.concatenate([x[1] for x in found]).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("__id")), batch.column(batch.schema.get_field_index("__y")), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())],
            ["id", "y", "feature", "value"],
        )


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["id"])
    y = np.array([r["y"] > 0 for r in rows], float)
    weights, slope, shift = np.zeros(SIZE, np.float32), 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if 0 < y.sum() < len(y):
        held = np.arange(len(rows)) % 5 == 4
        at = [np.frombuffer(r["feature"], np.int32) for r in rows]
        value = [np.frombuffer(r["value"], np.float32) for r in rows]
        weights = _descend([at[i] for i in np.flatnonzero(~held)], [value[i] for i in np.flatnonzero(~held)], y[~held])
        score = np.array([weights[at[i]] @ value[i] for i in range(len(rows))])
        part = held if 0 < y[held].sum() < held.sum() else ~held
        slope, shift = _calibrate(score[part], y[part])
    yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "slope": [slope], "shift": [shift]}, pa.schema([("weights", pa.binary()), ("slope", pa.float64()), ("shift", pa.float64())]))


def _descend(at: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, rounds: int = 80, penalty: float = 1e-6) -> np.ndarray:
    """Logistic regression by accelerated gradient steps with a step size for each feature; both classes weigh the same."""
    feature, x = np.concatenate(at), np.concatenate(value)
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    weigh = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, mean, square, bias = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE), 0.0
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[feature] * x, minlength=len(y)) + bias, -50, 50)))
        error = weigh * (p - y)
        gradient = np.bincount(feature, error[row] * x, minlength=SIZE) + penalty * w
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        w -= 0.5 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        bias -= 2.0 * error.sum()
    return w.astype(np.float32)


def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: a line through the score, fitted by Newton steps to smoothed targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    scale = max(float(np.abs(score).max()), 1e-9)
    x = np.stack([score / scale, np.ones_like(score)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        beta -= np.clip(np.linalg.solve(hessian, x.T @ (p - target) + 1e-4 * beta), -5, 5)
    return float(beta[0] / scale), float(beta[1])


def score(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row per document: statistics, base verdict, calibrated probability of good quality, and whether it is kept."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in text.slices(batches, "text"):
            sums = text.byte_sums(buf)
            words = text.Words(buf, offsets, sums)
            out = statistics(buf, offsets, words, sums)
            failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
            p = shared.value.probability(hashed(buf, offsets, words, sums), batch.num_rows)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(out[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))],
                ["doc_id", *names, "base_failed", "probability", "kept"],
            )

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 4000) -> DataFrame:
    """Fit on the labels, then score every document."""
    return score(documents, fit(documents, labels, sample=sample), threshold)


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 4000) -> DataFrame:
    """The documents that pass, with their own columns, in one pass over the texts."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, sample=sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in text.slices(batches, "text"):
            sums = text.byte_sums(buf)
            words = text.Words(buf, offsets, sums)
            out = statistics(buf, offsets, words, sums)
            p = shared.value.probability(hashed(buf, offsets, words, sums), batch.num_rows)
            good = (out["n_words"] >= MIN_WORDS) & (100 * out["n_repeat_words"] <= REPEAT_PERCENT * out["n_words"]) & (p >= threshold)
            yield batch.filter(pa.array(good))

    return documents.mapInArrow(run, documents.schema)
