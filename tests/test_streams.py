"""Sinks, stores and streams: the stream gives what the batch gives."""

import pytest
from pyspark.sql import functions as F

from logweir.operators import ratelimit as B
from logweir.operators.filters import CompositeFilter
from logweir.operators.model import Rule
from logweir.operators.parse import parse_logs
from logweir.session import scratch
from logweir.sources import ingest, readers, sinks, stores, views
from logweir.streaming import pipeline, ratelimit as S, templates

FOLDER = "/root/testdata/sf0.001"
DEBUG = Rule.parse({"id": "d", "name": "d", "enabled": True, "condition": {"field": "level", "operator": "eq", "value": "DEBUG"}, "actions": [{"type": "drop"}]})


def lines(spark, n=120):
    return views.raw_lines(spark, FOLDER).filter(f"id < {n}").select("raw", F.col("logged_at").cast("timestamp").alias("ingest_ts"))


def debug_lines(spark):
    """The lines that a pipeline without rules keeps as DEBUG."""
    logs = parse_logs(lines(spark), ingest_ts=F.col("ingest_ts"), year=F.year("ingest_ts"))
    return logs.filter("level = 'DEBUG'").select("raw")


def test_pipeline_stream_equals_batch_and_replays(spark):
    path = scratch(spark, "test")
    lines(spark).repartition(3).write.parquet(f"{path}/in")
    schema = "raw string, ingest_ts timestamp"
    for attempt in ("one", "two"):  # a second run over the same input writes the same ids
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        pipeline.start(stream, f"{path}/out", f"{path}/checkpoint-{attempt}", load_rules=lambda: [DEBUG], trigger={"availableNow": True}).awaitTermination()
        written = {(r.id, r.level) for r in sinks.current(spark, f"{path}/out").collect()}
        wanted = {(r.id, r.level) for r in pipeline.process(lines(spark), rules=[DEBUG]).collect()}
        assert written == wanted and "DEBUG" not in {x[1] for x in written}
        assert sinks.current(spark, f"{path}/out").count() == len(written) == lines(spark).select("raw").distinct().count() - lines(spark).join(debug_lines(spark), "raw", "left_semi").select("raw").distinct().count()


def test_upsert_overwrites_by_id(spark):
    path = scratch(spark, "test")
    make = lambda rows: spark.createDataFrame(rows, "id string, text string, day string, n int").withColumn("timestamp", F.col("day").cast("timestamp")).drop("day")
    sinks.upsert(make([("a", "1", "2024-01-01", 1), ("b", "1", "2024-01-02", 1), ("a", "2", "2024-01-01", 2)]), path, F.col("n"), 0)
    for _ in range(2):  # a repeated batch
        sinks.upsert(make([("b", "3", "2024-01-02", 3), ("c", "1", "2024-01-02", 1)]), path, F.col("n"), 1)
    want = {("a", "2"), ("b", "3"), ("c", "1")}
    assert {(r.id, r.text) for r in sinks.current(spark, path).collect()} == want
    sinks.upsert(make([("a", "9", "2024-01-01", 0)]), path, F.col("n"), 2)
    sinks.compact(spark, path, f"{path}-compact", 1)
    assert {(r.id, r.text) for r in sinks.current(spark, f"{path}-compact").collect()} == want
    assert {(r.id, r.text) for r in sinks.current(spark, path).collect()} == {("a", "9"), ("b", "3"), ("c", "1")}


def test_rate_limit_stream_equals_batch(spark):
    path = scratch(spark, "test")
    logs = views.logs(spark, FOLDER).select("id", "service", "timestamp")
    for i, part in enumerate(("timestamp < '2024-01-10'", "timestamp >= '2024-01-10' and timestamp < '2024-01-20'", "timestamp >= '2024-01-20'")):
        logs.filter(part).coalesce(1).write.parquet(f"{path}/in{i}")
    spark.createDataFrame([], logs.schema).write.parquet(f"{path}/in")
    for i in range(3):  # one micro-batch per part, in event order
        spark.read.parquet(f"{path}/in{i}").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(logs.schema).parquet(f"{path}/in")
        S.start(
            stream, lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/buckets", f"{path}/checkpoint",
            capacity=4, fill=1, tick_ms=36_000_000, trigger={"availableNow": True},
        ).awaitTermination()
    found = sorted(r.id for r in spark.read.parquet(f"{path}/out").collect())
    assert found == sorted(r.id for r in B.rate_limit(logs, capacity=4, fill=1, tick_ms=36_000_000).collect())
    assert len(found) < logs.count()


def test_template_table_stream(spark):
    path = scratch(spark, "test")
    logs = views.logs(spark, FOLDER).select("id", "timestamp", "message")
    logs.coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(logs.schema).parquet(f"{path}/in")
    templates.start(stream, f"{path}/t", f"{path}/checkpoint", trigger={"availableNow": True}).awaitTermination()
    table = templates.read(spark, f"{path}/t", 0)
    assert templates.patterns(table).agg(F.sum("frequency")).collect()[0][0] == logs.count()


def test_ingest_and_layout(spark):
    path = scratch(spark, "test")
    rows = [("api", "2024-01-01T00:00:00Z", '{"a":1}'), (None, None, None), ("api", "soon", None), ("api", None, "[]"), ("web", "2024-01-02T00:00:00Z", None)]
    df = spark.createDataFrame(rows, "service string, timestamp string, fields string").withColumn("level", F.lit("INFO"))
    good, bad = ingest.to_logs(df)
    assert (good.count(), {r.error for r in bad.collect()}) == (2, {"service is required", "timestamp is not a time", "fields is not an object"})
    ingest.append_logs(good.withColumn("fields", F.to_json("fields")), path)
    table = spark.read.parquet(path)
    assert "date" in table.columns and table.filter("date = '2024-01-02'").count() == 1


def test_rule_store(spark):
    rows = [("r2", "defaults/processor", '{"id":"r2","name":"n","enabled":true,"priority":1,"condition":{"field":"a","operator":"exists"}}'), ("x", "defaults/processor", "{broken"), ("y", "sdk", "[1]")]
    store = spark.createDataFrame(rows, "id string, scope string, body string")
    assert [r.id for r in stores.load_rules(store, "defaults")] == ["r2"]
    changes = spark.createDataFrame([("a", "s", "put", "1", 1), ("a", "s", "delete", None, 2), ("b", "s", "delete", None, 1), ("b", "s", "put", "2", 3)], "id string, scope string, op string, body string, seq int")
    assert [(r.id, r.body) for r in stores.latest(changes).collect()] == [("b", "2")]
    filters = spark.createDataFrame([("f", "", '{"id":"f","enabled":true,"rules":[{"name":"n","field":"level","pattern":"x","action":"drop"}]}'), ("g", "", '{"id":"g","enabled":true,"rules":[{"action":"explode"}]}')], "id string, scope string, body string")
    assert [c.id for c in stores.load_filters(filters)] == ["f"]
    with pytest.raises(ValueError):
        CompositeFilter("n", "AND", (("level", "like", "x"),)).validate()


def test_topic_and_console(spark, tmp_path):
    assert readers.kafka_options("b:9092", "logs", "g", max_per_trigger=10) == {
        "kafka.bootstrap.servers": "b:9092", "subscribe": "logs", "startingOffsets": "earliest", "failOnDataLoss": "true", "kafka.group.id": "g", "maxOffsetsPerTrigger": "10",
    }
    flushed = readers.kafka_options("b:9092", "logs", flush_rows=1000)
    assert (flushed["minOffsetsPerTrigger"], flushed["maxTriggerDelay"]) == ("1000", "5s")
    df = spark.createDataFrame([("2024-01-01", "INFO", 'say "hi"', "api", "", "t1")], "day string, level string, message string, service string, pod string, trace_id string")
    row = sinks.topic_rows(df.withColumn("timestamp", F.col("day").cast("timestamp"))).collect()[0]
    assert (row.key, row.value) == ("api", '{"timestamp":"2024-01-01T00:00:00.000000Z","level":"INFO","message":"say \\"hi\\"","service":"api","trace_id":"t1"}')
    shown = str(tmp_path / "shown")

    def emit(line):
        with open(shown, "a") as f:
            f.write(line + "\n")

    sinks.write_console(df.select("level"), "logs", emit)
    assert open(shown).read() == '[logs] {"level":"INFO"}\n'
    path = scratch(spark, "samples")
    sample = spark.createDataFrame([("a=1 b=2", "key_value", "unit"), ('{"x":"two\\nlines"}', "json", "unit"), ("", "unstructured", None)], "log string, expected_format string, source string")
    readers.write_samples(sample.coalesce(1), path)
    assert sorted(map(tuple, readers.read_samples(spark, path).collect()), key=repr) == sorted(map(tuple, sample.collect()), key=repr)
    listed = tmp_path / "listed.json"
    listed.write_text('[\n  {"log": "a=1 b=2", "expected_format": "key_value", "source": "unit"},\n  {"log": "c", "expected_format": "unstructured", "source": "unit"}\n]')
    assert [r.log for r in readers.read_samples(spark, str(listed), listed=True).collect()] == ["a=1 b=2", "c"]
