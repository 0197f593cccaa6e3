"""Alerts in any window of some seconds: against a plain count, across the edges of blocks, and stream against batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import alerts as A
from logweir.operators.alerts import AlertRule
from logweir.operators.model import Condition
from logweir.session import scratch
from logweir.streaming import alerts as S

START = datetime.datetime(2024, 1, 1)
RULES = [
    AlertRule("errors", "errors", True, "api", Condition("level", "eq", "ERROR"), 3, 10),
    AlertRule("any", "any", True, "", Condition("level", "exists"), 6, 37),
    AlertRule("single", "single", True, "", Condition("level", "eq", "FATAL"), 1, 5),
    AlertRule("off", "off", False, "", Condition("level", "exists"), 1, 5),
]


def some_rows(n, seed, span=400):
    rng = random.Random(seed)
    return [(START + datetime.timedelta(seconds=rng.randint(-span, span), microseconds=rng.randint(0, 999_999)), rng.choice(["ERROR", "INFO", "FATAL", None]), rng.choice(["api", "web"])) for _ in range(n)]


def table_of(spark, rows):
    return spark.createDataFrame(rows, "timestamp timestamp, level string, service string")


def plain(rows, rules):
    out = set()
    for r in rules:
        if not r.enabled:
            continue
        level = r.condition.value if r.condition.operator == "eq" else None
        seconds = [int((t - datetime.datetime(1970, 1, 1)).total_seconds() // 1) for t, x, s in rows if (not r.service or s == r.service) and x is not None and (level is None or x == level)]
        count = lambda end: sum(end - r.window < x <= end for x in seconds)  # noqa: B023, E731
        out |= {(r.id, s, count(s)) for s in set(seconds) if count(s) >= r.threshold > count(s - 1)}
    return out


def found(alerts):
    rows = alerts.select("id", "rule_id", F.unix_seconds("trigger_time").alias("at"), "count", "window").collect()
    assert len({r.id for r in rows}) == len(rows)
    return {(r.rule_id, r.at, r["count"]) for r in rows}


@pytest.mark.parametrize("seed,n,block", [(1, 150, 1), (2, 300, 50), (3, 40, 3600), (4, 600, 37)])
def test_sliding_by_plain_count(spark, seed, n, block):
    rows = some_rows(n, seed)
    assert found(A.evaluate_sliding(table_of(spark, rows), RULES, fields=None, block=block)) == plain(rows, RULES)


def test_a_burst_across_an_edge(spark):
    """Two rows on each side of a window's edge: no window side by side holds three of them."""
    edge = datetime.datetime(2024, 1, 1, 1)
    rows = [(edge + datetime.timedelta(seconds=s), "ERROR", "api") for s in (-2, -1, 0, 1)]
    df = table_of(spark, rows)
    assert A.evaluate(df, RULES[:1], fields=None).count() == 0
    assert found(A.evaluate_sliding(df, RULES[:1], fields=None)) == {("errors", int(edge.replace(tzinfo=datetime.UTC).timestamp()), 3)}


def test_a_hot_second_is_one_row(spark):
    df = spark.range(200_000).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3).alias("timestamp"), F.lit("ERROR").alias("level"), F.lit("api").alias("service"))
    counts = A.second_counts(df, RULES[:1], fields=None)
    assert counts.count() == 3
    assert found(A.crossings(counts, RULES[:1])) == {("errors", 1_700_000_000, 66_667)}


def test_no_rules_and_no_rows(spark):
    df = table_of(spark, some_rows(20, 5))
    assert A.evaluate_sliding(df, [], fields=None).count() == 0
    assert A.evaluate_sliding(table_of(spark, []), RULES, fields=None).count() == 0




def run(spark, parts, lateness):
    """Each part is a micro-batch, in order."""
    out, schema = scratch(spark, "sliding-out"), "timestamp timestamp, level string, service string"
    source = scratch(spark, "sliding-in")
    for rows in parts:
        table_of(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        S.start_sliding(stream, RULES, f"{out}/out", f"{out}/state", f"{out}/checkpoint", lateness=lateness, trigger={"availableNow": True}, fields=None).awaitTermination()
    return out


def test_stream_equals_batch_with_late_rows(spark):
    """Rows come out of order by less than the lateness: nothing is lost, whatever batch they come in."""
    rows = sorted(some_rows(260, 6), key=lambda r: r[0])
    rng = random.Random(1)
    shuffled = sorted(rows, key=lambda r: r[0] + datetime.timedelta(seconds=rng.randint(0, 55)))
    parts = [shuffled[i : i + 65] for i in range(0, 260, 65)]
    out = run(spark, parts, lateness=60)
    assert found(S.read_sliding(spark, f"{out}/out")) == plain(rows, RULES)


def test_rows_beyond_the_lateness_are_left_out(spark):
    at = lambda s: START + datetime.timedelta(seconds=s)
    out = run(spark, [[(at(100), "ERROR", "api")] * 2, [(at(101), "ERROR", "api"), (at(20), "FATAL", "api")], [(at(400), "INFO", "web")]], lateness=30)
    got = found(S.read_sliding(spark, f"{out}/out"))
    assert {r for r, _, _ in got} == {"errors"} and {n for _, _, n in got} == {3}
