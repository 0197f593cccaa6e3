"""Language identification by averaged subword embeddings.

A text's subwords are the byte n-grams within its words, word edges included; each is hashed to a row of an embedding table. The
mean of their embeddings goes through one linear layer and a softmax. Table and layer are trained together by stochastic gradient descent
in numpy, on whole texts and on short runs of their words, so that short texts are known too. On texts that training didn't see, a
temperature makes the softmax a probability, and a least confidence is found from which on a stated share of answers is right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweir.functions.ranks import first_rows
from logweir.llm.common import Batches, batch

BITS = 16
DIM = 16
ORDERS = (2, 3, 4)
SLAB = 1 << 20
SAMPLE_ROWS, ROWS_EACH = 4_000, 1_000
UNKNOWN = "und"
RUN_WORDS = 8

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SPACE = 32


def _folded() -> np.ndarray:
    """Each byte as the subwords see it: ASCII letters in lower case, other ASCII as a space, parts of other characters as they are."""
    b = np.arange(256, dtype=np.uint8)
    lower = np.where((b >= 65) & (b <= 90), b + 32, b)
    return np.where((b >= 128) | ((lower >= 97) & (lower <= 122)), lower, _SPACE).astype(np.uint8)


_FOLDED = _folded()


def subwords(text: str | None) -> Iterator[np.ndarray]:
    """The table rows of all subwords of the whole text, repeats included, a slab of the text at a time."""
    data = _FOLDED[np.frombuffer(f" {text or ''} ".encode(), np.uint8)]
    space = data == _SPACE
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    data, space = data[keep], space[keep]
    if len(data) < ORDERS[0]:
        return
    longest = ORDERS[-1]
    for at in range(0, len(data), SLAB):
        units, gap = data[at : at + SLAB + longest - 1].astype(np.uint64), space[at : at + SLAB + longest - 1]
        code, inner = np.zeros(len(units), np.uint64), np.zeros(len(units), bool)
        for n in range(1, min(longest, len(units)) + 1):
            starts = len(units) - n + 1
            code = code[:starts] * _STEP + units[n - 1 :] + np.uint64(n)
            inner = inner[:starts] | gap[n - 2 : n - 2 + starts] if n > 2 else inner[:starts]  # a space between its first and last byte
            if n in ORDERS:
                found = code[:SLAB][~inner[:SLAB]]
                yield ((found ^ (found >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text, ascending, and the share of its subwords that each has."""
    counts = np.zeros(1 << BITS)
    for rows in subwords(text):
        counts += np.bincount(rows, minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found] / max(counts.sum(), 1.0)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # embeddings
    layer: np.ndarray
    bias: np.ndarray
    heat: float = 1.0  # the temperature's inverse
    least: float = 0.0  # confidence from which on an answer is accepted

    def average(self, text: str | None) -> np.ndarray:
        total, n = np.zeros(self.table.shape[1]), 0
        for rows in subwords(text):
            total += self.table[rows].sum(axis=0, dtype=np.float64)
            n += len(rows)
        return total / max(n, 1)

    def chances(self, average: np.ndarray) -> np.ndarray:
        logits = self.heat * (average @ self.layer + self.bias)
        e = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, its probability, and whether that is enough to accept it."""
        if not self.langs or not any(map(str.isalpha, text or "")):
            return UNKNOWN, 0.0, False
        chances = self.chances(self.average(text))
        best = int(chances.argmax())
        return self.langs[best], float(chances[best]), bool(chances[best] >= self.least)


def descend(bags: list[tuple[np.ndarray, np.ndarray]], lang: np.ndarray, n_langs: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, layer and bias by stochastic gradient descent on the cross-entropy, one text at a time, the rate falling to nothing."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    layer, bias = np.zeros((DIM, n_langs)), np.zeros(n_langs)
    layer += rng.uniform(-0.5, 0.5, layer.shape)
    steps, at = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            rows, share = bags[i]
            step = rate * (1 - at / steps)
            at += 1
            own = table[rows]
            average = share @ own
            logits = average @ layer + bias
            e = np.exp(logits - logits.max())
            slope = e / e.sum()
            slope[lang[i]] -= 1.0
            back = layer @ slope
            layer -= step * np.outer(average, slope)
            bias -= step * slope * 0.01
            # a share is tiny: without this factor a row would hardly move
            table[rows] = own - np.outer(step * share / share.max(), back)
    return table.astype(np.float32), layer, bias


def temperature(logits: np.ndarray, lang: np.ndarray) -> float:
    """The factor of the logits with the least cross-entropy, by a search in ever finer steps between 1/64 and 64."""

    def loss(power: float) -> float:
        z = logits * 2.0**power
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), lang]).mean())

    low, high = -6.0, 6.0
    for _ in range(6):
        tries = np.linspace(low, high, 13)
        best = int(np.argmin([loss(p) for p in tries]))
        low, high = tries[max(best - 1, 0)], tries[min(best + 1, 12)]
    return 2.0 ** ((low + high) / 2)


def least_confidence(confidence: np.ndarray, right: np.ndarray, precision: float) -> float:
    """The smallest confidence from which on at least ``precision`` of the answers are right; 1 if there is none."""
    order = np.argsort(-confidence, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    last = np.append(np.diff(confidence[order]) != 0, True)  # answers with one confidence go together
    good = np.flatnonzero((share >= precision) & last)
    return float(confidence[order][good[-1]]) if good.size else 1.0


def fit_rows(bags: list[tuple[np.ndarray, np.ndarray]], lang: list[str], unseen: np.ndarray, epochs: int = 6, rate: float = 0.5, precision: float = 0.99, seed: int = 0) -> Model:
    """Train on the bags that aren't ``unseen`` and calibrate on those that are. A language only seen in the unseen ones isn't learned."""
    bags_of = lambda keep: [bags[i] for i in np.flatnonzero(keep)]
    names = np.array(lang, dtype=object)
    seen = ~unseen & np.array([len(r) > 0 for r, _ in bags], bool)
    langs = sorted(set(names[seen]))
    if not langs:
        return Model([], np.zeros((1 << BITS, DIM), np.float32), np.zeros((DIM, 0)), np.zeros(0))
    number = {x: i for i, x in enumerate(langs)}
    model = Model(langs, *descend(bags_of(seen), np.array([number[x] for x in names[seen]]), len(langs), epochs, rate, seed))
    check = unseen & np.array([len(r) > 0 and x in number for (r, _), x in zip(bags, names, strict=True)], bool)
    if check.any():
        truth = np.array([number[x] for x in names[check]])
        averages = np.array([share @ model.table[rows] for rows, share in bags_of(check)])
        model.heat = temperature(averages @ model.layer + model.bias, truth)
        chances = model.chances(averages)
        model.least = least_confidence(chances.max(axis=1), chances.argmax(axis=1) == truth, precision)
    return model


def held_out(key: Column, folds: int = 5, out: int = 0) -> Column:
    """Rows whose key's text has a crc32 that leaves ``out``; a null key is not held out (and never trained on)."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == out, F.lit(False))


def _run_of_words(text: str, key: int) -> str:
    """A short run of the text's words, placed by its key."""
    words = text.split()
    at, n = (key * 7919) % max(1, len(words)), 1 + key % RUN_WORDS
    return " ".join(words[at : at + n])


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, rows_each: int = ROWS_EACH, **options) -> Model:
    """Fit on at most ``rows_each`` documents of a language and ``sample_rows`` in all, the first by a hash of the key, none held out.

    The bound is what the driver holds: a bag of table rows for each document, and one for a short run of its words. Rows without key,
    language or text teach nothing; of several rows with one key the one with the smallest hash of its text counts.
    """
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("part", pa.int32()), ("rows", pa.binary()), ("share", pa.binary())])

    def extract(batches: Batches) -> Batches:
        for b in batches:
            out = []
            for k, name, t in zip(*(b[c].to_pylist() for c in ("key", "lang", "text")), strict=True):
                for part, own in enumerate((t, _run_of_words(t, k))):
                    rows, share = bag(own)
                    out.append((k, name, part, rows.astype("<u2").tobytes(), share.astype("<f4").tobytes()))
            if out:
                yield batch(schema, *zip(*out, strict=True))

    known = df.select(F.col(key).cast("long").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    known = known.filter("key is not null and lang is not null and text is not null").filter(~held_out(F.col("key")))
    each = known.select("key", "lang", F.xxhash64("text").alias("seal")).groupBy("key").agg(F.min(F.struct("seal", "lang")).alias("one"))
    each = each.select("key", "one.seal", "one.lang", F.xxhash64("key").alias("place"))
    picked = first_rows(each, ["lang"], ["place", "key"], rows_each, "rank").orderBy("rank", "place", "key").limit(sample_rows)
    found = known.withColumn("seal", F.xxhash64("text")).join(F.broadcast(picked.select("key", "seal", "lang")), ["key", "seal", "lang"])
    found = found.groupBy("key", "lang").agg(F.min("text").alias("text"))  # equal rows once
    bags = found.select("key", "lang", "text").mapInArrow(extract, "key long, lang string, part int, rows binary, share binary").toArrow().to_pandas()
    bags = bags.sort_values(["key", "part"]).reset_index(drop=True)
    loaded = [(np.frombuffer(r, "<u2").astype(np.int64), np.frombuffer(s, "<f4").astype(float)) for r, s in zip(bags["rows"], bags["share"], strict=True)]
    # every fifth document, by a number without pattern in the key, is for the calibration
    unseen = (bags["key"].to_numpy().astype(np.uint64) * _MIX >> np.uint64(40)) % np.uint64(5) == 0
    return fit_rows(loaded, list(bags["lang"]), unseen, **options)


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct of ``lang_pred``, ``score`` and ``accepted`` for each whole text."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predictions(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for t in texts:
            yield pd.DataFrame([own.predict(x) for x in t], columns=["lang_pred", "score", "accepted"])

    return predictions(text)


def classify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", reject: bool = False, **options) -> DataFrame:
    """Every row's key with ``held_out``, ``lang_pred``, ``score`` (the language's probability) and ``accepted``.

    A text that is null or has no letter is ``und`` with score 0; so is every text if no language could be learned. Answers below the least
    confidence found in calibration aren't ``accepted``; with ``reject`` they become ``und`` too. The language column is read only to fit, equal
    texts are answered alike, other columns are not read, and an empty table gives no rows.
    """
    model = fit(df, key, text, lang, **options)
    rows = df.select(F.col(key), held_out(F.col(key)).alias("held_out"), predict(df.sparkSession, model, F.col(text)).alias("p"))
    answer = F.when(F.col("p.accepted"), F.col("p.lang_pred")).otherwise(UNKNOWN) if reject else F.col("p.lang_pred")
    return rows.select(key, "held_out", answer.alias("lang_pred"), "p.score", "p.accepted")
