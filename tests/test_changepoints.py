"""Change points against a plain recursion, on planted shifts and on flat series."""

import math
import random
import statistics

import pytest

from logweir.operators.changepoints import bucket_counts, change_points, changes, running_sums, seasonal_profile

SCHEMA = "service string, bucket bigint, n bigint"
WEEKS = 8


def usual(hour):
    return 60 + 40 * math.sin(hour % 24 / 24 * 2 * math.pi) + (30 if hour % 168 < 120 else 0)


def series(name, seed, shifts=()):
    """Counts of eight weeks with a daily and weekly course; ``shifts``: (from, to, factor)."""
    rng = random.Random(seed)
    out = []
    for hour in range(WEEKS * 168):
        mean = usual(hour) * math.prod(f for a, b, f in shifts if a <= hour < b)
        out.append((name, hour, max(0, round(rng.gauss(mean, math.sqrt(mean))))))
    return out


def plain(rows, period=168, slack=1000, limit=8000, clip=4000):
    """The same by one loop: (direction, onset, alarm, end, observed, expected)."""
    slots = {}
    for b, n in rows:
        slots.setdefault(b % period, []).append(n)
    medians = {s: float(statistics.median(v)) for s, v in slots.items()}
    spreads = {s: max(1.4826 * statistics.median(abs(n - medians[s]) for n in v), math.sqrt(max(medians[s], 1.0))) for s, v in slots.items()}
    found = []
    for direction, sign in (("up", 1), ("down", -1)):
        level, run = 0, []
        stretches = []
        for b, n in rows:
            away = max(-clip, min(clip, math.floor(1000.0 * (n - medians[b % period]) / spreads[b % period])))
            level = min(2 * limit, max(0, level + sign * away - slack))
            if level:
                run.append((b, n, level))
            elif run:
                stretches.append((run, False))
                run = []
        if run:
            stretches.append((run, True))
        for run, still in stretches:
            alarm = next((b for b, _, v in run if v >= limit), None)
            if alarm is None:
                continue
            top = max(v for _, _, v in run)
            peak = max(b for b, _, v in run if v == top)
            inside = [(b, n) for b, n, _ in run if b <= peak]
            found.append((direction, run[0][0], alarm, None if still else peak + 1, sum(n for _, n in inside), sum(medians[b % period] for b, _ in inside)))
    return sorted(found)


def hours(spark_rows):
    at = lambda t: None if t is None else round(t.timestamp() // 3600)
    return sorted((r.direction, at(r.onset), at(r.alarm), at(r.end), r.observed, r.expected) for r in spark_rows)


SHIFTS = {"more": [(400, 448, 2.0)], "less": [(700, 760, 0.4)], "both": [(300, 330, 1.8), (900, 960, 0.5)], "late": [(1300, 1344, 2.0)], "flat": [], "flat too": []}


def test_planted_shifts_are_found_and_flat_series_left_alone(spark):
    data = {name: series(name, i, shifts) for i, (name, shifts) in enumerate(SHIFTS.items())}
    rows = changes(spark.createDataFrame([r for s in data.values() for r in s], SCHEMA)).collect()
    for name, shifts in SHIFTS.items():
        got = hours(r for r in rows if r.service == name)
        assert got == plain([(b, n) for _, b, n in data[name]]), name
        assert [d for d, *_ in sorted(got, key=lambda g: g[1])] == ["up" if f > 1 else "down" for _, _, f in shifts]
        for (_, onset, alarm, end, *_), (a, b, _) in zip(sorted(got, key=lambda g: g[1]), shifts, strict=True):
            # noise just before a change can start its stretch some hours early
            assert a - 6 <= onset <= a + 2 and alarm <= a + 8
            assert end is None if b == WEEKS * 168 else abs(end - b) <= 2


def test_profile_of_earlier_logs(spark):
    """A change that lasts over most of the new logs shows against a profile learned before it."""
    before = spark.createDataFrame(series("s", 5), SCHEMA)
    after = spark.createDataFrame([("s", WEEKS * 168 + b, n) for _, b, n in series("s", 6, [(24, WEEKS * 168, 1.7)])] + [("unknown", 1, 1)], SCHEMA)
    (found,) = changes(after, seasonal_profile(before)).collect()
    assert (found.direction, found.end) == ("up", None) and abs(found.onset.timestamp() // 3600 - WEEKS * 168 - 24) <= 2


@pytest.mark.parametrize("block", [1, 3, 64])
def test_sums_across_blocks(spark, block):
    rng = random.Random(block)
    steps = [(k, b, rng.randrange(-9, 9)) for k in ("a", None) for b in sorted(rng.sample(range(-200, 400), 300))]
    got = {(r.k, r.bucket): r.level for r in running_sums(spark.createDataFrame(steps, "k string, bucket bigint, step bigint"), ["k"], 20, block=block).collect()}
    wanted, level = {}, 0
    for i, (k, b, step) in enumerate(steps):
        level = min(20, max(0, (0 if i == 300 else level) + step))
        wanted[(k, b)] = level
    assert got == wanted


def test_empty_buckets_nulls_and_empty_tables(spark):
    logs = spark.sql("select * from values ('a', timestamp '1970-01-01 00:10:00'), ('a', timestamp '1970-01-13 12:00:00'), (null, timestamp '1970-01-01 05:00:00'), ('b', null) as t(service, timestamp)")
    counts = [tuple(r) for r in bucket_counts(logs).collect()]
    assert len(counts) == 12 * 24 + 13 + 1 and (None, 5, 1) in counts and sum(n for _, _, n in counts) == 3
    assert change_points(logs).count() == 0
    assert change_points(logs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        change_points(logs, slack=4.0)


def test_nothing_is_compared_with_everything(spark):
    logs = spark.sql("select 'a' service, timestamp_seconds(id * 600) timestamp from range(5000)")
    plan = change_points(logs)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
