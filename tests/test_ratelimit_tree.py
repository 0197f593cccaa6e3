"""The tree of effects under a rate limit against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.operators import ratelimit as B


def plain(ticks, counts, capacity, fill, level=None, since=None):
    level = capacity if level is None else level
    out = []
    for tick, n in zip(ticks, counts, strict=True):
        level = min(capacity, level + fill * max(0, tick - (tick if since is None else since)))
        since = tick
        passed = min(level, n)
        level -= passed
        out.append((tick, n, passed, level))
    return out


def allowed(df, **options):
    rows = B.allowances(df, key="service", tick_ms=1000, time="at", **options).collect()
    return sorted((r.service, r._tick, r.n, r.allowed, r.left) for r in rows)


@pytest.mark.parametrize("block", [2, 3, 5])
@pytest.mark.parametrize("capacity,fill", [(4, 1), (9, 3), (1, 0)])
def test_every_level_of_the_tree(spark, block, capacity, fill):
    """Blocks so small that the tree has its levels, and several nodes of a key are left at the top."""
    rng = np.random.default_rng(block)
    want, rows = [], []
    for service, span in (("a", 700), ("b", 40), ("c", 1)):
        ticks = np.unique(rng.integers(-span, span, 200))
        counts = rng.integers(1, 9, len(ticks))
        want += [(service, *r) for r in plain(ticks.tolist(), counts.tolist(), capacity, fill)]
        rows += [(service, int(t)) for t, n in zip(ticks, counts, strict=True) for _ in range(n)]
    df = spark.createDataFrame(rows, "service string, s long").select("service", F.timestamp_seconds("s").alias("at"))
    assert allowed(df, capacity=capacity, fill=fill, block=block) == sorted(want)


def test_levels_left_by_an_earlier_run(spark):
    rows = [("a", s) for s in range(100, 160) for _ in range(2)]
    df = spark.createDataFrame(rows, "service string, s long").select("service", F.timestamp_seconds("s").alias("at"))
    before = spark.createDataFrame([("a", 3, 95), ("z", 1, 1)], "service string, level long, tick long")
    want = [("a", *r) for r in plain(range(100, 160), [2] * 60, 20, 1, level=3, since=95)]
    assert allowed(df, capacity=20, fill=1, block=4, buckets=before) == want


def test_one_key_with_many_ticks(spark):
    """Two million ticks of one key: no array of the tree is longer than a block."""
    n = 2_000_000
    ticks = np.arange(n) * 3
    counts = (np.arange(n) * 7919) % 5 + 1
    df = spark.range(n).select(F.lit("a").alias("service"), F.timestamp_seconds(F.col("id") * 3).alias("at"), F.expr("explode(sequence(1, cast(id * 7919 % 5 + 1 as int)))"))
    got = B.allowances(df, key="service", tick_ms=1000, time="at", capacity=6, fill=1).agg(F.sum("allowed"), F.sum("n"), F.sum("left"), F.max("_tick")).first()
    want = np.array(plain(ticks.tolist(), counts.tolist(), 6, 1))
    assert tuple(got) == (want[:, 2].sum(), want[:, 1].sum(), want[:, 3].sum(), ticks[-1])
