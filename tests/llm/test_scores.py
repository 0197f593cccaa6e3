"""URL filter, classifier, language-model scores, pipeline."""

import math
import re
import zlib

import numpy as np
import pytest
from helpers import FOLDER, documents, read, words
from pyspark.sql import functions as F

import corpus_pipeline
from logweir.llm import lm_score, nbsvm, url_filter
from logweir.llm.catalog import QUERIES


def _host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _rule(host, path, rules=url_filter.RULES):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme.net/", "http://", "http://net/", "http://A.NET/x", "http://a.net", "http://a.net?x=/", "https://example.net/en/1", "https://www.Example.net/en/",
    "http://notexample.net/en/", "http://example.com/de/x?y#z", "http://x.example.com/DE/", "http://o.org/fr/", "http://o.org/fr", "ftp://x.org/fr/a://b/", "http://ÉX.org/É", "http://spam-farm.example.org/en/728",
    "http://" + "a" * 20_000 + "/" + "b" * 20_000, "http://a.b\nc/d\ne", "http://a.net/", "http://a.net/",
]


def _model(rows):
    """Batch gradient descent in numpy on the same features. Hashes come from Spark."""
    ys = np.array([y for _, y in rows], float)
    grams = sorted({g for found, _ in rows for g in found})
    x = np.zeros((len(rows), len(grams)))
    for i, (found, _) in enumerate(rows):
        for g in found:
            x[i, grams.index(g)] = 1 / math.sqrt(len(found))
    w, b = np.zeros(len(grams)), 0.0
    for _ in range(url_filter.EPOCHS):
        error = 1 / (1 + np.exp(-(x @ w + b))) - ys
        w, b = w - url_filter.RATE * (url_filter.DECAY * w + x.T @ error / len(rows)), b - url_filter.RATE * error.sum() / len(rows)
    return dict(zip(grams, w, strict=True)), b


def test_url_filter_by_brute_force(spark):
    table = url_filter.labelled(spark)
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string, extra string")
    got = url_filter.judge(df, table).collect()
    assert [*got[0].asDict()] == ["page_id", "url", "extra", "host", "path", "rule", "probability", "verdict"]
    host, path = url_filter.parts(F.col("url"))
    grams = lambda d: {r.url: r.g for r in d.select("url", url_filter.grams(host, path).alias("g")).collect()}
    weights, bias = _model([(grams(table)[u], y) for u, y in sorted(url_filter.LABELLED)])
    found = grams(df)
    for r in got:
        assert (r.host, r.path) == _host_path(r.url)
        rule, verdict = _rule(r.host, r.path)
        z = bias + sum(weights.get(g, 0.0) for g in found[r.url]) / math.sqrt(max(1, len(found[r.url])))
        assert r.probability == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.probability >= 0.5 else "allow"))
    assert url_filter.judge(df.limit(0), table).count() == 0


def test_url_model_separates_its_table_and_takes_edges(spark):
    table = url_filter.labelled(spark)
    got = {r.url: r.probability >= 0.5 for r in url_filter.judge(table, table).collect()}
    assert got == {u: bool(y) for u, y in url_filter.LABELLED}
    none = spark.sql("SELECT * FROM VALUES ('http://a.b/', CAST(NULL AS INT)) AS t(url, label)")
    assert url_filter.fit(none)[1] == 0.0
    blank = spark.sql("SELECT * FROM VALUES (CAST(NULL AS STRING), 1), ('', 0) AS t(url, label)")
    assert all(math.isfinite(w) for w in url_filter.fit(blank)[0])


def test_op2_over_its_table(spark):
    pages = read("pages")
    got = {r.page_id: r for r in QUERIES["op2_url_filter"].job(spark, FOLDER).collect()}
    assert len(got) == len(pages)
    for k, u in zip(pages["page_id"], pages["url"], strict=True):
        host, path = _host_path(u)
        rule, verdict = _rule(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == (verdict or ("block" if got[k].probability >= 0.5 else "allow"))
    plan = QUERIES["op2_url_filter"].job(spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _plain_features(text):
    """Which byte n-grams and repeated words there are, as one index each."""
    data, out = (text or "").encode(), set()
    for n in range(1, 5):
        for i in range(len(data) - n + 1):
            code = 0
            for k in range(n):
                code = (code * 0x9E3779B97F4A7C15 + data[i + k] + k + 1) % (1 << 64)
            out.add((code * 0xBF58476D1CE4E5B9) % (1 << 64) >> (64 - nbsvm.BITS))
    w = data.split()
    for n in range(2, 5):
        if any(len(set(w[i : i + n])) == 1 for i in range(len(w) - n + 1)):
            out.add(nbsvm.BUCKETS + n - 2)
    return out


def test_features_of_whole_texts(monkeypatch):
    monkeypatch.setattr(nbsvm, "SLAB", 7)
    for t in (None, "", "a", "ab", "é x", "und und und der", "a a", "one two three four five"):
        assert set(nbsvm.features(t).tolist()) == _plain_features(t)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    good = rng.random(80) < 0.5
    rows = [np.sort(rng.choice(40, 8, replace=False)) + (20 if g else 0) for g in good]
    values = [rng.random(8) for _ in rows]
    w, b = nbsvm.descend(rows, values, good, 1.0, 3000, 1e-10, 0)
    x = np.zeros((80, 61))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r], x[i, 60] = v, 1.0
    y = np.where(good, 1.0, -1.0)
    loss = lambda u: 0.5 * u @ u + np.maximum(0, 1 - y * (x @ u)).sum()
    u = np.concatenate((w[:60], [b]))
    best = loss(u)
    for _ in range(300):  # no step in any direction is better
        assert loss(u + rng.standard_normal(61) * 10 ** rng.uniform(-4, 0)) >= best - 1e-9


def test_classifier_edges(spark):
    docs = documents(spark, [(i, ("good words here " * 5 if i % 3 else "$$$ !!! *** ") + str(i)) for i in range(300)] + [(None, "x"), (900, None), (901, ""), (902, "w " * 300_000), (3, "dup"), (3, "dup")])
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(280)] + [(5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    df = docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "label")
    got = nbsvm.classify(df, labels).collect()
    assert len(got) == 306 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [(r.doc_id, r.predicted) for r in got if r.doc_id is not None and r.held_out and 9 < r.doc_id < 300]
    assert all(p == (1 if k % 3 else 0) for k, p in out)
    assert nbsvm.classify(documents(spark, []), labels).count() == 0
    assert {r.score for r in nbsvm.classify(df, labels.limit(0)).collect()} == {0.5}
    one = nbsvm.classify(df, labels.filter("quality = 1")).select("score").distinct().collect()
    assert len(one) == 1 and one[0].score > 0.9
    assert nbsvm.keep(df, labels).columns == df.columns


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(nbsvm.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (nbsvm.classify(docs, x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert first == second


def test_op10_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op10_quality"].job(spark, folder).toPandas().merge(read("labels", folder), on="doc_id")
    got = got[got["held_out"]]
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert (good >= 0.7).mean() > 0.97


def _plain_losses(rows, target, weight=100.0):
    """[(key, words, target loss, background loss)] by counting every word, word before and pair."""
    from collections import Counter

    found = [(k, words(t)) for k, t in rows]
    alone, before, pairs = ([Counter(), Counter()] for _ in range(3))
    for k, w in found:
        for own in {0, int(k in target)}:
            alone[own].update(w)
            before[own].update([None, *w][: len(w)])
            pairs[own].update(zip([None, *w], w, strict=False))
    out = []
    for k, w in found:
        loss = []
        for own in (1, 0):
            unseen = sum(alone[own].values()) + len(alone[0]) + 1
            each = [-math.log((pairs[own][x, y] + weight * (alone[own][y] + 1) / unseen) / (before[own][x] + weight)) for x, y in zip([None, *w], w, strict=False)]
            loss.append(float(np.mean(each)) if each else 0.0)
        out.append((k, len(w), *loss))
    return out


def test_lm_scores_by_brute_force(spark):
    rng = np.random.default_rng(8)
    text = lambda low, high: " ".join(f"w{x}" for x in rng.integers(low, high, rng.integers(1, 60)))
    rows = [(i, text(0, 40) if i % 2 else text(30, 90)) for i in range(120)] + [(500, None), (501, ""), (None, "w1 w2"), (3, "again w3"), (3, "again w3"), (502, "long " * 50_000)]
    target = {i for i in range(0, 120, 2)} | {3, 9999}
    keys = spark.createDataFrame([(k,) for k in target] + [(None,), (3,)], "doc_id long")
    df = documents(spark, rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "own").repartition(3)
    got = lm_score.score(df, keys).collect()
    key = lambda r: (str(r[0]), r[1])
    for r, w in zip(sorted((tuple(r) for r in got), key=key), sorted(_plain_losses(rows, target), key=key), strict=True):
        assert r[:2] == w[:2] and r[2] == pytest.approx(w[2], rel=1e-9) and r[3] == pytest.approx(w[3], rel=1e-9) and r[4] == r[2] - r[3]
    inside = [r.score for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 2 == 0]
    outside = [r.score for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 2 and r.doc_id != 3]
    assert np.mean(inside) < np.mean(outside)
    assert lm_score.score(documents(spark, []), keys).count() == 0
    assert lm_score.score(df, keys.limit(0)).count() == len(rows)


def test_op4_over_its_table(spark):
    docs, labels = read("documents"), read("labels")
    target = set(labels[(labels["quality"] == 1) & (labels["toxic"] == 0)]["doc_id"])
    want = {r[0]: r[1:] for r in _plain_losses(list(zip(docs["doc_id"], docs["text"], strict=True)), target)}
    got = QUERIES["op4_lm_scoring"].job(spark, FOLDER).collect()
    assert {r.doc_id: r.n_words for r in got} == {k: w[0] for k, w in want.items()}
    assert all(r.target_loss == pytest.approx(want[r.doc_id][1], rel=1e-9) and r.background_loss == pytest.approx(want[r.doc_id][2], rel=1e-9) for r in got)


def test_lm_counts_are_exact(spark, monkeypatch):
    """More words and pairs than any table of fixed size had slots for: each still has a count of its own."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 400_000, 40_000))) for i in range(30)]
    rows += [(100, "v1 v2 v1 v2"), (101, None), (None, "v1 v2"), (102, " "), (102, "v1 v2 rare")]
    target = {0, 1, 100, 102}
    assert len({x for _, t in rows for x in words(t)}) > 1 << 18
    want = [(str(k), *rest) for k, *rest in _plain_losses(rows, target)]
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", 100_000, raising=False)
    keys = spark.createDataFrame([(k,) for k in target] + [(None,)], "doc_id long")
    got = lm_score.score(documents(spark, rows).repartition(3), keys).collect()
    for r, w in zip(sorted((str(r.doc_id), r.n_words, r.target_loss, r.background_loss) for r in got), sorted(want), strict=True):
        assert r[:2] == w[:2] and r[2:] == pytest.approx(w[2:], rel=1e-9)


def test_pipeline_stage_by_stage(spark):
    """Each stage against what its operator says of the stage's own input; the last holds every id of what is left."""
    from collections import Counter

    from helpers import crc, jaccard_groups, whole_ids

    from logweir.llm import mixing
    from logweir.llm.common import stored

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "mixture", "packed"]
    stages = dict(corpus_pipeline.STAGES)
    good = stored(stages["quality"](spark, docs, FOLDER), "t1")
    accepted = {r.doc_id for r in nbsvm.classify(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).filter("predicted = 1").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == accepted
    single = stored(stages["near_duplicates"](spark, good, FOLDER), "t2")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    firsts = {g for (k, t), (_, g, _) in zip(rows, jaccard_groups(rows), strict=True)}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == firsts and single.count() == len(firsts)
    mixed = stored(stages["mixture"](spark, single, FOLDER), "t3")
    taken = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns
    assert all(taken[r.doc_id] * r.size == r.taken for r in mixing.taken(single).collect())
    pieces = stages["packed"](spark, mixed, FOLDER).collect()
    left = mixed.collect()
    ids = whole_ids([r.text for r in left], 0)
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    want = Counter((r.doc_id, at, crc(x[at : at + 1024])) for r, x in zip(left, ids, strict=True) for at in range(0, len(x), 1024))
    assert Counter((p.doc_id, p.start, p.ids_crc32) for p in pieces) == want
    assert Counter((p.doc_id, p.start, p.ids_crc32) for p in corpus_pipeline.run(spark, FOLDER).collect()) == want


def test_pipeline_of_odd_documents(spark):
    rows = [(None, None), (1, ""), (1, ""), (None, "x y z"), (5, "clean words in a row here " * 4), (6, "clean words in a row here " * 4)]
    df = documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), FOLDER).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, FOLDER)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_text_teaches_for_a_key(spark):
    """A key on many rows, with other texts: one of them teaches, the same one in any layout."""
    rows = [(i, f"good words here {i}" if i % 2 else f"bad junk there {i}") for i in range(60)] + [(5, f"another text {j}") for j in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    fits = [nbsvm.fit(documents(spark, order).repartition(n), labels) for order, n in ((rows, 1), (rows[::-1], 7))]
    assert (fits[0].scaled == fits[1].scaled).all() and (fits[0].slope, fits[0].offset) == (fits[1].slope, fits[1].offset)
