"""Merged sketches against exact ranks; late rows and repeated batches."""

import datetime

from pyspark.sql import functions as F

from logweir.operators import sketches as S
from logweir.operators.quality import PERCENTS
from logweir.session import scratch


def rows(spark, n=300_000):
    """Skewed durations of two services over 60 hours; one service has nearly all rows."""
    return spark.range(n).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("large").alias("service"),
        F.timestamp_seconds(F.col("id") % (60 * 3600)).alias("timestamp"),
        F.pow(F.pmod(F.xxhash64("id"), F.lit(100_003)) / 1000.0, F.lit(3.0)).alias("duration_ms"),
    )


def test_percentiles_are_within_the_stated_rank_error(spark):
    logs = rows(spark)
    for by in (("service",), ()):
        found = S.latency_sketched(S.sketch(logs, "duration_ms"), by)
        plain = logs.groupBy(*by).agg(F.count("*").alias("n"), F.min("duration_ms").alias("lo"), F.max("duration_ms").alias("hi"), F.avg("duration_ms").alias("mean"))
        got, wanted = sorted(found.collect()), sorted(plain.collect())
        at = len(by)
        for g, w in zip(got, wanted, strict=True):
            assert (g["count"], g["min"], g["max"]) == (w.n, w.lo, w.hi) and abs(g["avg"] - w["mean"]) < 1e-6 * w["mean"]
        kept = spark.createDataFrame(got, found.schema)
        for errors in S.rank_errors(logs, "duration_ms", kept, by).collect():
            assert all(e <= S.RANK_ERROR for e in errors[at:]), errors


def test_few_values_are_exact(spark):
    values = spark.sql("select 's' service, timestamp_seconds(id) timestamp, cast(id as double) v from range(1, 101)")
    (got,) = S.latency_sketched(S.sketch(values, "v")).collect()
    assert [got[f"p{p}"] for p in PERCENTS] == [float(p) for p in PERCENTS]


def test_late_rows_touch_their_own_hour_and_a_batch_can_run_again(spark):
    path, logs = scratch(spark, "sketches"), rows(spark, 20_000)
    hour = F.floor(F.unix_seconds("timestamp") / 3600)
    late = logs.filter((hour == 2) & (F.col("service") == "large"))
    first = S.sketch(logs.exceptAll(late), "duration_ms")
    S.absorb(first, path, 0)
    for _ in range(2):
        S.absorb(S.sketch(late, "duration_ms"), path, 1)
    table = S.read(spark, path)
    assert [(r.service, r.hour.timestamp()) for r in table.filter("batch = 1").collect()] == [("large", 7200.0)]
    by_service = {r.service: r["count"] for r in S.latency_sketched(table).collect()}
    assert by_service == {r.service: r["count"] for r in logs.groupBy("service").count().collect()}
    chosen = S.latency_sketched(table, ("service",), F.col("hour") == F.lit(datetime.datetime(1970, 1, 1, 2)))
    assert {r.service: r["count"] for r in chosen.collect()} == {r.service: r["count"] for r in logs.filter(hour == 2).groupBy("service").count().collect()}
    target = scratch(spark, "compacted")
    S.compact(spark, path, target)
    compacted = S.read(spark, target)
    assert compacted.count() == table.select("service", "hour").distinct().count()
    assert {r.service: r["count"] for r in S.latency_sketched(compacted).collect()} == by_service


def test_nulls_and_empty_tables(spark):
    odd = spark.sql("select * from values ('a', timestamp '2024-01-01 00:00:00', 1.0D), ('a', null, 3.0D), (null, timestamp '2024-01-01 00:00:00', 5.0D), ('b', null, null), ('c', null, double('nan')) as t(service, timestamp, v)")
    got = {r.service: (r["count"], r["min"], r["max"]) for r in S.latency_sketched(S.sketch(odd, "v")).collect()}
    assert got == {"a": (2, 1.0, 3.0), None: (1, 5.0, 5.0)}
    assert S.latency_sketched(S.sketch(odd.limit(0), "v")).collect() == []
