"""Pages by rank against a plain sort."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import paging
from logweir.operators.paging import page_of

START = datetime.datetime(2024, 1, 1)


def rows_of(n, seed, ids="number"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # a third of all rows share one moment, some have none
        at = None if i % 41 == 0 else START + datetime.timedelta(microseconds=0 if i % 3 == 0 else rng.randint(-(10**12), 10**12))
        key = i * (1 if i % 2 else -1) if ids == "number" else f"service-{'x' * (i % 40)}-{i:05d}"
        out.append((None if i % 97 == 0 else key, at, f"m{i}"))
    return out


def sort_key(r):
    none = (1, 0)
    at = none if r[1] is None else (0, -(r[1] - START) // datetime.timedelta(microseconds=1))
    if r[0] is None:
        return at, none
    # descending by bytes: each byte turned round, the end of the text after all of them
    return at, (0, -r[0] if isinstance(r[0], int) else [-b for b in r[0].encode()] + [1])


@pytest.mark.parametrize("ids", ["number", "text"])
@pytest.mark.parametrize("offset,limit", [(0, 10), (0, None), (5, 7), (100, 300), (390, 20), (399, 1), (400, 5), (10**12, 100), (0, 0), (250, None), (0, 400)])
def test_pages(spark, monkeypatch, ids, offset, limit):
    monkeypatch.setattr(paging, "BUCKETS", 3)
    monkeypatch.setattr(paging, "FEW", 9)
    rows = rows_of(400, 7, ids)
    kind = "long" if ids == "number" else "string"
    df = spark.createDataFrame(rows, f"id {kind}, timestamp timestamp, message string").repartition(4)
    got = [(r.message, r.total) for r in page_of(df, ["timestamp", "id"], limit, offset).collect()]
    end = 400 if limit is None else offset + limit
    want = [(r[2], 400) for r in sorted(rows, key=sort_key)[offset:end]] or [(None, 400)]
    # null ids at one moment have no order of their own
    assert [t for _, t in got] == [t for _, t in want]
    alike = {r[2]: repr(sort_key(r)) for r in rows} | {None: ""}
    assert [alike[m] for m, _ in got] == [alike[m] for m, _ in want]


def test_repeated_rows_and_one_moment(spark, monkeypatch):
    monkeypatch.setattr(paging, "FEW", 5)
    df = spark.createDataFrame([(1, START, "a")] * 50 + [(2, START, "b")] * 30, "id long, timestamp timestamp_ntz, message string")
    for offset, limit in [(0, 30), (10, 30), (29, 2), (30, 50), (70, 40)]:
        got = [r.message for r in page_of(df, ["timestamp", "id"], limit, offset).collect()]
        assert got == (["b"] * 30 + ["a"] * 50)[offset : offset + limit]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, timestamp timestamp")
    for offset, limit in [(0, 5), (0, None), (3, 5)]:
        assert [tuple(r) for r in page_of(df, ["timestamp", "id"], limit, offset).collect()] == [(None, None, 0)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_no_offset_and_broadcast_no_page(spark):
    df = spark.range(100_000).select("id", F.timestamp_micros(F.col("id") * 7919 % 100_003).alias("timestamp"))
    deep = page_of(df, ["timestamp", "id"], 50, 60_000)
    assert "TakeOrdered" not in plan_of(deep) and "Broadcast" not in plan_of(deep) and "offset" not in plan_of(deep).lower()
    assert deep.count() == 50
    whole = page_of(df, ["timestamp", "id"], None, 0)
    # the one-row total is what is broadcast
    text = plan_of(whole)
    assert "BroadcastNestedLoopJoin BuildRight" in text and "Sort [" in text and "TakeOrdered" not in text


def test_a_bad_page(spark):
    df = spark.createDataFrame([(1.5, START)], "id double, timestamp timestamp")
    with pytest.raises(ValueError):
        page_of(df, ["timestamp"], 5, -1)
    with pytest.raises(TypeError):
        page_of(df, ["id"], 5, 1)
