"""Mining, reports, limits and figures against literal rows and step-by-step Python."""

import random
import re

from pyspark.sql import functions as F

from logweir.operators import mining as M, quality as K, ratelimit as B, reports as R


def logs(spark, messages, **extra):
    rows = [(i, 1700000000 + i, m) for i, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "id long, at long, message string").withColumn("timestamp", F.timestamp_seconds("at"))
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


VARIABLE = re.compile(r"^\d+$|^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$|^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$|^\d{4}-\d{2}-\d{2}|^[a-f0-9]{8,}$")


def tokens(message):
    return [t.strip() for t in re.split(r"[\s,;:=\[\]{}()]+", message, flags=re.ASCII) if t.strip()]


def template(message):
    found = tokens(message)
    return " ".join("<*>" if VARIABLE.match(t) else t for t in found) if found else message


def path(message):
    return ["*" if VARIABLE.match(t) else t for t in tokens(message)][:4]


def by_walking(messages):
    """Distinct paths in first-seen order, each walking the prefixes that exist by then."""
    children, ends, assigned, counts = set(), {}, {}, {}
    for m in messages:
        p = tuple(path(m))
        if not p:
            counts[m] = counts.get(m, 0) + 1
            continue
        if p not in assigned:
            at = ()
            for token in p:
                at = next((at + (k,) for k in (token, "*") if at + (k,) in children), None)
                if at is None:
                    break
            if at is not None and at in ends:
                assigned[p] = ends[at]
            else:
                assigned[p] = ends[p] = template(m)
                children |= {p[: n + 1] for n in range(len(p))}
        counts[assigned[p]] = counts.get(assigned[p], 0) + 1
    return counts


def random_messages(n, seed):
    rng = random.Random(seed)
    words = ["user", "login", "12", "34", "10.0.0.1", "failed", "ok", "deadbeef01"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(n)]


def test_fixture_frequencies(spark):
    df = logs(spark, ["User logged in"] * 3 + ["Connection failed"] * 2 + ["Slow response"])
    found = {r.pattern: (r.frequency, r.severity, r.examples) for r in M.pattern_stats(df).collect()}
    assert found["User logged in"] == (3, "low", ["User logged in"] * 3)
    assert {p: v[0] for p, v in found.items()} == {"User logged in": 3, "Connection failed": 2, "Slow response": 1}


def test_severity_and_recommendation(spark):
    df = logs(spark, ["Frequent error message"] * 100 + ["Payment failed"] * 51 + ["hot 1 x"] * 101 + ["rare"] * 50)
    rows = M.recommend_rules(M.mine_patterns(df)).collect()
    found = {r.name.removeprefix("Auto-generated rule for: "): (r.priority, r.operator, r.action) for r in rows}
    assert found == {"Frequent error message": (2, "matches", "mark"), "Payment failed": (2, "matches", "mark"), "hot <*> x": (1, "matches", "mark")}
    # a rule matches the messages of its template and no others
    value = {r.name.removeprefix("Auto-generated rule for: "): r.value for r in rows}
    cases = {"hot <*> x": ["hot 7 x", "hot=7, x"], "Payment failed": ["Payment failed", "[Payment] failed "]}
    for name, texts in cases.items():
        assert all(re.search(value[name], t) for t in texts)
        assert not any(re.search(value[name], t) for t in ["hot a x", "hot 7 x y", "Payment failed twice", "no Payment failed", "hot 7"])
    assert {r.center: r.size for r in M.clusters(logs(spark, ["Same message"] * 3 + ["Different message"] * 2 + ["alone"])).collect()} == {
        "Same message": 3, "Different message": 2,
    }


def test_templates_and_tokens(spark):
    messages = random_messages(200, 1) + ["a\xa0b c", "took 100ms", "", "  ", "Connection from 192.168.1.1 port 8080", None]
    rows = logs(spark, messages).select("message", M.template(F.col("message")).alias("t")).collect()
    assert [r.t for r in rows if r.message is not None] == [template(r.message) for r in rows if r.message is not None]


def test_exact_groups_keep_first_template(spark):
    messages = random_messages(400, 2)
    first, counts = {}, {}
    for m in messages:
        key = tuple(path(m)) or ("", m)
        head = first.setdefault(key, template(m))
        counts[head] = counts.get(head, 0) + 1
    found = {r.pattern: r.frequency for r in M.mine_patterns(logs(spark, messages)).collect()}
    assert found == counts and sum(found.values()) == len(messages)


def test_wildcard_groups(spark):
    for seed in (3, 4):
        messages = random_messages(150, seed)
        found = {r.pattern: r.frequency for r in M.mine_patterns_wildcard(logs(spark, messages)).collect()}
        assert found == by_walking(messages)


def test_anomalies(spark):
    base = logs(spark, ["Normal operation"] * 2)
    now = logs(spark, ["Normal operation", "New error pattern"])
    assert [r.message for r in M.anomalies(now, base).collect()] == ["New error pattern"]
    assert M.anomalies(now, None).count() == 2


def test_report_fixture(spark):
    rows = [("ERROR", "Connection failed", "/app/db.go", "Connect", 100)] * 3 + [("INFO", "Request processed successfully", "/app/handler.go", "Handle", 50)] * 2
    df = spark.createDataFrame(rows, "level string, message string, path string, function string, line_number int")
    df = df.withColumns({"service": F.lit("report-test"), "component": F.lit("sdk"), "id": F.monotonically_increasing_id(), "timestamp": F.lit("2024-01-01").cast("timestamp")})
    assert [(r.file, r.line_number, r["count"], r.percentage) for r in R.top_lines(df, "report-test").collect()] == [("/app/db.go", 100, 3, 60.0), ("/app/handler.go", 50, 2, 40.0)]
    assert [(r.pattern, r["count"], len(r.sample_logs)) for r in R.top_patterns(df, "report-test").orderBy(F.desc("count")).collect()] == [
        ("Connection failed", 3, 3), ("Request processed successfully", 2, 2),
    ]
    assert R.top_lines(df, "nobody").count() == 0


def bucket(times, capacity, fill, tick):
    level, last, passed = capacity, None, []
    for i, t in enumerate(times):
        now = t // tick
        if last is not None:
            level = min(capacity, level + (now - last) * fill)
        last = now
        if level > 0:
            level -= 1
            passed.append(i)
    return passed


def test_rate_limit_against_a_loop(spark):
    rng = random.Random(5)
    for capacity, fill in ((5, 1), (3, 2), (1, 0)):
        times = sorted(rng.randrange(0, 3_000_000) for _ in range(300)) + [3_000_000] * 40
        rows = [(i, "hot", t) for i, t in enumerate(times)]
        df = spark.createDataFrame(rows, "id long, service string, ms long").withColumn("timestamp", F.timestamp_millis("ms"))
        found = sorted(r.id for r in B.rate_limit(df, capacity=capacity, fill=fill, tick_ms=10_000).collect())
        assert found == bucket(times, capacity, fill, 10_000)
        # blocks of a few ticks chain to the same result, and so do two runs with the levels between them
        small = B.allowances(df, key="service", capacity=capacity, fill=fill, tick_ms=10_000, block=7)
        assert small.agg(F.sum("allowed")).collect()[0][0] == len(found)
        a, b = df.filter("ms < 1500000"), df.filter("ms >= 1500000")
        first = B.allowances(a, key="service", capacity=capacity, fill=fill, tick_ms=10_000)
        second = B.allowances(b, key="service", capacity=capacity, fill=fill, tick_ms=10_000, buckets=B.levels(first, "service"))
        assert first.union(second).agg(F.sum("allowed")).collect()[0][0] == len(found)


def test_latency_percentiles_are_exact(spark):
    rng = random.Random(6)
    values = [rng.choice([1.5, 2.0, rng.random() * 100]) for _ in range(2503)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = K.latency_stats(df, "v").collect()[0]
    ordered = sorted(values)
    assert (row.p50, row.p95, row.p99) == tuple(ordered[len(ordered) * p // 100] for p in (50, 95, 99))
    assert (row["count"], row["min"], row["max"]) == (len(values), ordered[0], ordered[-1])
