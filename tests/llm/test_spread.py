"""Sharding and mixing."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import FOLDER, documents, read
from pyspark.sql import functions as F

from logweir.llm import mixing, sharding
from logweir.llm.catalog import QUERIES

EDGES = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (None, "y"), (None, None), (4, "é " * 5000), (5, "a b c")]


def _plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500, np.uint64) * np.uint64(2)
    for shards in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, shards).tolist() == [_plain_jump(int(k), shards) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def _shards_right(rows, got):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    slots, by_key = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            by_key[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_key.values())


def test_sharding_edges(spark):
    df = documents(spark, EDGES).withColumnRenamed("lang", "shard").withColumnRenamed("source", "size")
    _shards_right(EDGES, sharding.assign(df, 8, rows_per_bucket=1).collect())
    assert sharding.assign(documents(spark, []), 8).count() == 0


def test_op5_over_its_table(spark):
    docs = read("documents")
    got = QUERIES["op5_sharding"].job(spark, FOLDER).collect()
    _shards_right(list(zip(docs["doc_id"], docs["text"], strict=True)), got)
    assert {r.law for r in got} == {"key"} and {r.shard for r in got} == set(range(8))


def test_written_shards(spark):
    from logweir.llm.common import shared_path

    path = shared_path(spark, "test-shards")
    sharding.write_shards(documents(spark, EDGES), 4, path)
    back = spark.read.parquet(path)
    assert back.count() == len(EDGES) and set(back.select("shard").toPandas()["shard"]) <= {0, 1, 2, 3}


def _plain_targets(sizes, weights, repeats=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not full:
            return target | share
        target |= {s: float(repeats * sizes[s]) for s in full}
        open_ -= full
    return target


def test_targets_by_resharing(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        sizes = {(f"s{i}" if i else None): int(10 ** rng.uniform(0, 4)) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = _plain_targets(sizes, (1, 2, 3))
        assert got == {s: pytest.approx(t, rel=1e-9) for s, t in want.items()}


def _mixed_right(rows, got):
    """rows: (doc_id, text, source)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = _plain_targets(dict(sizes), (1, 2, 3))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((k, size(t)) for k, t, _ in rows)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] + 1e-6
    assert sum(taken.values()) <= sum(sizes.values())


def test_mixing_edges(spark):
    texts = ["one two three", None, "", " \t ", "w " * 4000, "x", "x y"]
    rows = [(i if i % 7 else None, texts[i % len(texts)], [None, "a", "b", "É"][i % 4]) for i in range(200)] + [(1, "same", "a")] * 5
    df = documents(spark, rows).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "target")
    got = mixing.taken(df, rows_per_bucket=20).collect()
    _mixed_right(rows, got)
    assert mixing.taken(documents(spark, [])).count() == 0
    assert sum(r.taken for r in mixing.taken(documents(spark, [(1, None, "a"), (2, "", None)])).collect()) == 0


def test_a_small_source_repeats_and_reruns_agree(spark):
    rows = [(i, "a b c d", "big") for i in range(90)] + [(100 + i, "a b c d", "tiny") for i in range(10)]
    first = mixing.taken(documents(spark, rows)).orderBy("doc_id").collect()
    _mixed_right(rows, first)
    assert {r.taken for r in first if r.source == "tiny"} == {12}
    again = mixing.taken(documents(spark, rows[::-1]).repartition(5)).orderBy("doc_id").collect()
    assert first == again
    drawn = Counter(r.doc_id for r in mixing.draw(documents(spark, rows)).collect())
    assert all(drawn[r.doc_id] * r.size == r.taken for r in first)


def test_the_mix_has_each_share_at_any_point(spark):
    rows = [(i, "a b", "x") for i in range(300)] + [(1000 + i, "a b", "y") for i in range(300)]
    mixed, _ = mixing.mix(documents(spark, rows))
    at = mixed.orderBy("position", "finish").select("position", "source", "size").toPandas()
    assert at["position"].tolist() == list(range(0, 2 * len(at), 2))
    share = at["source"].eq("x").cumsum() / (at.index + 1)
    assert (share[20:] - 1 / 3).abs().max() < 0.06


def test_op7_over_its_table(spark):
    docs = read("documents")
    rows = list(zip(docs["doc_id"], docs["text"], docs["source"], strict=True))
    got = QUERIES["op7_mixing"].job(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.col("source")), "doc_id").collect()
    _mixed_right(rows, got)
