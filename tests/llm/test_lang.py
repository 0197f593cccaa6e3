"""Language identification: plain subwords, held-out accuracy, calibration, odd rows."""

import zlib

import numpy as np
import pytest
from helpers import DOCS, FOLDER, read
from pyspark.sql import functions as F

from logweir.llm import lang_id
from logweir.llm.catalog import QUERIES


def plain_grams(text):
    """Byte n-grams of the folded text that hold no space but at their ends."""
    raw = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in f" {text or ''} ".encode())
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return sorted(raw[i : i + n] for n in lang_id.ORDERS for i in range(len(raw) - n + 1) if b" " not in raw[i + 1 : i + n - 1])


@pytest.mark.parametrize("text", ["", None, " ", "a", "The  cat,sat.", "é", "漢字 x", "ab1cd", "x" * 50, "Été à la 1234 plage!"])
def test_subwords_by_hand(text):
    got = np.concatenate([np.zeros(0, int), *lang_id.subwords(text)])
    grams = plain_grams(text)
    assert len(got) == len(grams)
    # a hash of its own for each distinct n-gram of these short texts
    assert len(set(got.tolist())) == len(set(grams))


def test_slabs_change_nothing(monkeypatch):
    text = "Some words, some more words and été. " * 40
    whole = lang_id.bag(text)
    for slab in (5, 64, 1000):
        monkeypatch.setattr(lang_id, "SLAB", slab)
        rows, share = lang_id.bag(text)
        assert (rows == whole[0]).all() and np.allclose(share, whole[1])


def test_least_confidence():
    confidence, right = np.array([0.9, 0.8, 0.8, 0.7, 0.6]), np.array([True, True, False, True, True])
    assert lang_id.least_confidence(confidence, right, 1.0) == 0.9
    assert lang_id.least_confidence(confidence, right, 0.75) == 0.6
    assert lang_id.least_confidence(confidence, ~right, 0.99) == 1.0


def test_temperature_recovers_a_scale():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(5000, 3))
    chances = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    lang = (chances.cumsum(axis=1) < rng.random((5000, 1))).sum(axis=1)
    assert abs(lang_id.temperature(4.0 * logits, lang) - 0.25) < 0.03


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = read("documents", folder)
    got = QUERIES["op11_language"].job(spark, folder).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    both = got.merge(docs, on="doc_id")
    assert (both.held_out == both.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0)).all()
    unseen = both[both.held_out]
    assert (unseen.lang_pred == unseen.lang).mean() > 0.98
    assert both.score.between(0, 1).all()
    taken = unseen[unseen.accepted]
    assert len(taken) > 0.8 * len(unseen) and (taken.lang_pred == taken.lang).mean() > 0.98


def test_the_language_column_is_no_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = lang_id.fit(docs)
    again = lang_id.fit(docs.repartition(7).withColumn("lang", F.when(~lang_id.held_out(F.col("doc_id")), F.col("lang"))).withColumn("source", F.lit("x")))
    assert model.langs == again.langs and (model.table == again.table).all() and model.heat == again.heat


def test_odd_rows(spark):
    rows = [(i, f"the cat sat on the mat {i}", "en", "s", 1) for i in range(40)] + [(100 + i, f"der hund und die katze {i}", "de", "s", 1) for i in range(40)]
    rows += [(200, None, "en", "s", 1), (201, "", None, None, None), (202, "123 ... !!", "en", "s", 1), (None, "the dog", "en", "s", 1), (203, "katze " * 100_000, None, "s", 1)]
    rows += [(204, "zzz qqq", "xx", "s", 1)] * 3 + [(0, "the other text", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"source": "score", "n_chars": "lang_pred"})
    got = lang_id.classify(df.repartition(5)).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, []).append(r)
    for k in (200, 201, 202):
        assert [(r.lang_pred, r.score, r.accepted) for r in by_key[k]] == [("und", 0.0, False)]
    assert by_key[None][0].lang_pred == "en" and by_key[None][0].held_out is False
    assert by_key[203][0].lang_pred == "de"
    assert len({(r.lang_pred, r.score) for r in by_key[204]}) == 1
    rejected = lang_id.classify(df, reject=True).collect()
    assert all((r.lang_pred == "und") == (not r.accepted) for r in rejected)


def test_nothing_or_one_language_to_learn(spark):
    none = spark.createDataFrame([(1, "some text", None, "s", 1)], DOCS)
    assert [(r.lang_pred, r.score) for r in lang_id.classify(none).collect()] == [("und", 0.0)]
    one = spark.createDataFrame([(i, "some text", "en", "s", 1) for i in range(9)], DOCS)
    assert {(r.lang_pred, r.score) for r in lang_id.classify(one).collect()} == {("en", 1.0)}
    assert lang_id.classify(spark.createDataFrame([], DOCS)).collect() == []
