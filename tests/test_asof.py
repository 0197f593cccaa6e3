"""As-of joins against a plain search."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import asof
from logweir.operators.asof import as_of

START = datetime.datetime(2024, 1, 1)


def some_rows(n, seed, keys=3):
    rng = random.Random(seed)
    hot = START + datetime.timedelta(hours=5)
    return [
        (i, None if i % 23 == 0 else rng.choice([0, 0, 0, *range(keys)]), None if i % 31 == 0 else hot if i % 3 == 0 else START + datetime.timedelta(seconds=rng.randint(-300_000, 300_000), microseconds=rng.choice([0, 1])))
        for i in range(n)
    ]


@pytest.mark.parametrize("block", [3600, 86_400, 10**9])
@pytest.mark.parametrize("n,m", [(300, 40), (50, 400), (100, 0), (0, 20)])
def test_against_plain_search(spark, n, m, block):
    rows, values = some_rows(n, 1), some_rows(m, 2)
    left = spark.createDataFrame(rows, "id long, k long, at timestamp").repartition(4)
    right = spark.createDataFrame(values, "no long, k long, since timestamp").repartition(3)
    got = as_of(left, right, ["k"], F.col("at"), F.col("since"), ["no"], block=block)
    assert got.columns == ["id", "k", "at", "value"]

    def plain(k, at):
        able = [(since, no) for no, key, since in values if key == k and since is not None and at is not None and since <= at]
        return max(able)[1] if able else None

    assert {r.id: r.value and r.value.no for r in got.collect()} == {i: plain(k, at) for i, k, at in rows}


def test_a_hot_moment_goes_to_many_tasks(spark):
    left = spark.range(50_000).select("id", F.lit(1).alias("k"), F.lit(START).alias("at"))
    right = spark.createDataFrame([(1, START - datetime.timedelta(days=40), "old"), (1, START, "new")], "k int, since timestamp, v string")
    got = as_of(left, right, ["k"], F.col("at"), F.col("since"))
    assert got.groupBy("value.v").count().collect()[0].asDict() == {"v": "new", "count": 50_000}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "Join" not in plan


@pytest.mark.parametrize("hot", [20_000, 32])
def test_values_go_only_where_rows_are(spark, monkeypatch, hot):
    """A value is there once for a block of few rows, once per part for one of very many, and not at all for a block without rows."""
    monkeypatch.setattr(asof, "HOT", hot)
    left = spark.range(400).select("id", F.lit(1).alias("k"), F.lit(START + datetime.timedelta(days=50)).alias("at"))
    start = F.timestamp_seconds(F.unix_timestamp(F.lit(str(START))) + F.col("id") * 3600)
    right = spark.range(24 * 100).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), start.alias("since"), F.col("id").alias("v"))
    laid = asof._laid_out(left, right, ["k"], F.col("at"), F.col("since"), [], 86_400)
    copies = laid.filter("_kind < 2").groupBy("_kind").count().collect()
    # all 400 rows are of one moment; the block has 24 values and one from before
    salts = laid.filter("_kind = 2").select("_salt").distinct().count()
    assert {r["_kind"]: r["count"] for r in copies} == {0: salts, 1: 24 * salts} and (salts == 1 if hot > 400 else salts > 8)
    got = as_of(left, right, ["k"], F.col("at"), F.col("since"))
    assert got.groupBy("value.v").count().collect() == [(50 * 24, 400)]
