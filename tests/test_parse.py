"""Fixture lines through detection and parsing."""

import json

import pytest
from pyspark.sql import functions as F

from logweir.operators.detect import detect_formats
from logweir.operators.parse import parse_as, parse_logs, parse_regex, parser_stats

NOW = "2024-01-31 00:00:00"
# line, format, level, message, some fields
CASES = [
    ('{"timestamp": "2025-07-14T08:30:45Z", "level": "INFO", "message": "cart 88 checked out"}', "json", "INFO", "cart 88 checked out", {}),
    ('{"time": "2025-07-14T08:30:45Z", "lvl": "DEBUG", "msg": "probe"}', "json", "DEBUG", "probe", {}),
    ('{"ts": "2025-07-14T08:30:45Z", "severity": "WARN", "message": "queue is long"}', "json", "WARN", "queue is long", {}),
    ('{"a": {"b": [1]}, "message": 7, "level": null}', "json", "<nil>", "7", {"a": {"b": [1]}}),
    ('{"a":1} {"b":2}', "unstructured", "INFO", 'a":1 b":2', {}),
    ("{broken object}", "unstructured", "INFO", "broken object", {}),
    ('timestamp=2025-07-14T08:30:45Z level=INFO message="stock refreshed" service=depot', "key_value", "INFO", "stock", {}),
    ('time:2025-07-14T08:30:45Z level:ERROR msg="disk gone" svc=vault', "key_value", "ERROR", "disk", {}),
    ("red=one green= blue=three", "key_value", "INFO", "", {"red": "one", "green": "blue=three"}),
    ("<34>Jul 14 08:30:45 rack7 mailer[772]: Mail queued", "syslog", "ERROR", "Mail queued", {"hostname": "rack7", "pid": "772"}),
    ("<13>Jul 14 08:30:45 rack7 mailer: no number here", "syslog", "INFO", "no number here", {"hostname": "rack7"}),
    ('198.51.100.4 - olga [14/Jul/2025:08:30:45 +0000] "GET /prices.csv HTTP/1.1" 200 5120', "apache", "INFO", "GET /prices.csv 200", {"user": "olga", "http_status": 200}),
    (
        '198.51.100.4 - - [14/Jul/2025:08:30:45 +0000] "POST /carts/9 HTTP/1.1" 501 88 "https://depot.test" "curl/8.1"',
        "nginx", "ERROR", "POST /carts/9 501", {"referer": "https://depot.test", "user_agent": "curl/8.1"},
    ),
    (
        "2025-07-14 08:30:45 ERROR Label printing failed: tray two empty",
        "unstructured", "ERROR", "2025-07-14 08:30:45 error label printing", {"detected_level": "ERROR", "error_detail": "tray two empty"},
    ),
    (
        "Scanner 203.0.113.9:9100 offline, manual https://ops.depot.test has steps",
        "unstructured", "INFO", "scanner 203.0.113.9:9100 offline manual https://ops.depot.test",
        {"source_ip": "203.0.113.9", "extracted_url": "https://ops.depot.test", "detected_ips": ["203.0.113.9"]},
    ),
    ("Handling PUT /v2/parcels/77 sent by 203.0.113.9", "unstructured", "INFO", "handling put /v2/parcels/77 sent 203.0.113.9", {"http_method": "PUT", "http_path": "/v2/parcels/77"}),
    ("The nightly export of prices ended with state=complete took=90s", "unstructured", "INFO", "nightly export prices ended state=complete", {"kv_state": "complete"}),
    ("", "unstructured", "INFO", "", {}),
    ("   ", "unstructured", "INFO", "   ", {}),
    ('{"half', "unstructured", "INFO", "half", {}),
    # detected as syslog, but its parser does not take it
    ("Jul 14 08:30:45 rack7 odd event", "key_value", "INFO", "", {"08": "30:45"}),
    # the group separator inside a line
    ("<34>Jul 14 08:30:45 my\x01host svc[1]: a\x01b", "syslog", "ERROR", "a\x01b", {"hostname": "my\x01host"}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id long, raw string")
    out = parse_logs(df, ingest_ts=F.lit(NOW).cast("timestamp"), year=F.lit(2024))
    return {r.id: r for r in out.withColumn("doc", F.to_json("fields")).drop("fields").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_line(parsed, i):
    line, fmt, level, message, fields = CASES[i]
    row = parsed[i]
    assert (row.format, row.level, row.message, row.raw) == (fmt, level, message, line)
    doc = json.loads(row.doc)
    assert {k: doc.get(k) for k in fields} == fields


def test_times(spark, parsed):
    at = lambda i: str(parsed[i].timestamp)
    assert at(0) == at(6) == at(11) == at(13) == "2025-07-14 08:30:45"
    assert at(9) == "2024-07-14 08:30:45"
    assert at(3) == at(5) == NOW
    df = spark.createDataFrame([('{"time": 1720945845, "level": "INFO"}',)], "raw string")
    assert str(parse_as(df, "json").collect()[0].timestamp) == "2024-07-14 08:30:45"


def test_detection_bounds(spark):
    lines = ["a=1 b=2 c d", "a=1 b=2 c", "a=1 b", "the host: said hello", '{"x":1}', '{"level":"a"}']
    out = detect_formats(spark.createDataFrame([(x,) for x in lines], "raw string"))
    assert [(r.format, round(r.confidence, 3)) for r in out.collect()] == [
        ("unstructured", 0.5), ("key_value", 0.833), ("unstructured", 0.5), ("unstructured", 0.5), ("json", 1.0), ("json", 0.9),
    ]


def test_custom_detector_and_patterns(spark):
    df = spark.createDataFrame([("Shipment booked REF:SHP-778-QZ-12 today",)], "raw string")
    row = parse_logs(df, patterns=[("ship", "REF:([A-Z0-9-]+)", ["ship_ref"])]).select(F.to_json("fields").alias("f")).collect()[0]
    assert json.loads(row.f)["ship_ref"] == "SHP-778-QZ-12"
    found = detect_formats(df, custom=[("ship", F.when(F.col("raw").contains("SHP-"), 0.9))]).collect()[0]
    assert (found.format, found.confidence) == ("ship", 0.9)


def test_forced_and_regex(spark):
    df = spark.createDataFrame([("2025-07-14 08:30:45|warn|depot|hey|9",), ("nothing",)], "raw string")
    out = parse_regex(df, r"^([^|]+)\|(\w+)\|(\w+)\|(\w+)\|(\d+)$", ["timestamp", "level", "service", "message", "n"], ingest_ts=F.lit(NOW).cast("timestamp"))
    good, bad = out.orderBy("parsed", ascending=False).withColumn("f", F.to_json("fields")).drop("fields").collect()
    assert (str(good.timestamp), good.level, good.service, good.message, good.f) == ("2025-07-14 08:30:45", "WARN", "depot", "hey", '{"n":"9"}')
    assert not bad.parsed and bad.level is None
    assert {r.format: (r.success_count, r.failure_count) for r in parser_stats(out).collect()} == {"regex": (1, 1)}
    with pytest.raises(ValueError):
        parse_as(df, "xml")
