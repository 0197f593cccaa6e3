"""Quality scores by naive Bayes support vectors.

Features are indicators of a text's n-grams: byte n-grams of one to four bytes, hashed, and words that repeat the
words just before them (two, three, four in a row). Each indicator is scaled by the log ratio of its smoothed frequencies
in the two classes, each text to unit length, and a linear model with hinge loss is fitted by dual coordinate descent. A sigmoid
fitted to margins of texts that the model has not seen makes scores of margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweir.llm.common import Batches, batch

BITS = 18
BUCKETS = 1 << BITS
REPEATS = 3
SIZE = BUCKETS + REPEATS
ORDER = 4
SLAB = 1 << 20
SAMPLE_ROWS = 6_000

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def features(text: str | None) -> np.ndarray:
    """The indices of the indicators that hold for the whole text, ascending. Long texts go through in slabs."""
    data = (text or "").encode()
    seen = np.zeros(SIZE, bool)
    for at in range(0, len(data), SLAB):
        units = np.frombuffer(data, np.uint8, min(SLAB + ORDER - 1, len(data) - at), at).astype(np.uint64)
        code = np.zeros(len(units), np.uint64)
        for n in range(1, min(ORDER, len(units)) + 1):
            code = code[: len(units) - n + 1] * _STEP + units[n - 1 :] + np.uint64(n)
            seen[(code * _MIX) >> np.uint64(64 - BITS)] = True
    words = data.split()
    if len(words) > 1:
        same = np.fromiter(map(bytes.__eq__, words, words[1:]), bool, len(words) - 1)
        for n in range(REPEATS):
            seen[BUCKETS + n] = same.any()
            same = same[1:] & same[:-1]
    return np.flatnonzero(seen)


@dataclass
class Model:
    scaled: np.ndarray  # ratio x weight of each feature
    square: np.ndarray  # ratio squared
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(self.square[found].sum()))
        return (float(self.scaled[found].sum()) / length if length > 0 else 0.0) + self.bias

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.offset, -500.0, 500.0))))


def log_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log of each feature's smoothed share of the good texts over its share of the others."""
    counts = np.ones((2, SIZE))
    for found, g in zip(rows, good, strict=True):
        counts[int(g), found] += 1.0
    return np.log(counts[1] / (1.0 + good.sum())) - np.log(counts[0] / (1.0 + (~good).sum()))


def descend(rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, cost: float, epochs: int, tolerance: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model: one dual variable at a time, each solved exactly within [0, cost]."""
    weight, dual = np.zeros(SIZE + 1), np.zeros(len(rows))
    sign, rng = np.where(good, 1.0, -1.0), np.random.default_rng(seed)
    square = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (float(weight[rows[i]] @ values[i]) + weight[SIZE]) - 1.0
            new = min(max(dual[i] - gradient / square[i], 0.0), cost)
            step = (new - dual[i]) * sign[i]
            if step:
                weight[rows[i]] += step * values[i]
                weight[SIZE] += step
                worst = max(worst, abs(step))
                dual[i] = new
        if worst < tolerance:
            break
    return weight[:SIZE], float(weight[SIZE])


def sigmoid(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make margins probabilities, by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    goal = np.where(good, (n1 + 1.0) / (n1 + 2.0), 1.0 / (n0 + 2.0))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
        gradient = np.array([((p - goal) * margins).sum(), (p - goal).sum()])
        curve = p * (1 - p)
        hessian = np.array([[(curve * margins**2).sum(), (curve * margins).sum()], [(curve * margins).sum(), curve.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(offset)


def _linear(rows: list[np.ndarray], good: np.ndarray, cost: float, epochs: int, tolerance: float, seed: int) -> Model:
    ratio = log_ratios(rows, good)
    values = []
    for found in rows:
        length = float(np.sqrt((ratio[found] ** 2).sum()))
        values.append(ratio[found] / length if length > 0 else ratio[found])
    weight, bias = descend(rows, values, good, cost, epochs, tolerance, seed)
    return Model(ratio * weight, ratio**2, bias, 1.0, 0.0)


def fit_rows(rows: list[np.ndarray], good: np.ndarray, cost: float = 1.0, epochs: int = 20, tolerance: float = 1e-3, seed: int = 0) -> Model:
    """Without texts of both classes every text scores the smoothed share of good ones (no text at all: one half)."""
    if not good.any() or good.all():
        share = (good.sum() + 1.0) / (len(good) + 2.0)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    # margins for the sigmoid: each half by a model of the other
    half = np.arange(len(rows)) % 2 == 0
    margins, known = np.zeros(len(rows)), np.ones(len(rows), bool)
    for own in (half, ~half):
        other = np.flatnonzero(~own)
        if not good[other].any() or good[other].all():
            known[own] = False
            continue
        part = _linear([rows[i] for i in other], good[other], cost, epochs, tolerance, seed)
        for i in np.flatnonzero(own):
            margins[i] = part.margin(rows[i])
    model = _linear(rows, good, cost, epochs, tolerance, seed)
    if known.any() and good[known].any() and not good[known].all():
        model.slope, model.offset = sigmoid(margins[known], good[known])
    return model


def held_out(key: Column, folds: int = 4, out: int = 2) -> Column:
    """Rows whose key's text has a crc32 that leaves ``out``; a null key is not held out (and never trained on)."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == out, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, **options) -> Model:
    """Fit on at most ``sample_rows`` labelled documents that are not held out, the first by a hash of the key.

    The bound is what the driver holds: one list of feature numbers for each. Documents with two different labels, null
    labels or null keys teach nothing; of several rows with one key the text with the smallest hash teaches.
    """
    schema = pa.schema([("key", pa.int64()), ("label", pa.int32()), ("found", pa.binary())])

    def extract(batches: Batches) -> Batches:
        for b in batches:
            yield batch(schema, b["key"], b["label"], [features(t).astype("<i4").tobytes() for t in b["text"].to_pylist()])

    known = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label")).filter("key is not null and label is not null")
    known = known.filter(~held_out(F.col("key"))).groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    picked = known.orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    # a key may be on any number of rows: the text with the smallest hash counts, whatever the layout of the files
    one = texts.join(F.broadcast(picked), "key").groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = one.mapInArrow(extract, "key long, label int, found binary").toArrow().to_pandas().sort_values("key").reset_index(drop=True)
    return fit_rows([np.frombuffer(x, "<i4") for x in found["found"]], found["label"].to_numpy() == 1, **options)


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of each whole text, between 0 and 1 (null: as an empty text)."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for t in texts:
            yield pd.Series([own.score(x) for x in t], dtype="float64")

    return scores(text)


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """Every document's ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).

    Equal rows score alike; other columns are not read; an empty table gives no rows.
    """
    model = fit(df, labels, key, text, **options)
    rows = df.select(F.col(key), held_out(F.col(key)).alias("held_out"), score(df.sparkSession, model, F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``df``, all columns, that the classifier accepts."""
    model = fit(df, labels, key, text, **options)
    return df.filter(score(df.sparkSession, model, F.col(text)) >= threshold)
