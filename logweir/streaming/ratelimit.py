"""Token-bucket rate limit on a stream: the buckets are a small table, one version per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from logweir.operators import ratelimit


def start(
    logs: DataFrame,
    sink: Callable[[DataFrame, int], None],
    buckets: str,
    checkpoint: str,
    *,
    key: str = "service",
    capacity: int,
    fill: int,
    tick_ms: int = 1000,
    time: str = "timestamp",
    order: tuple[str, ...] = ("timestamp", "id"),
    trigger: dict | None = None,
):
    """Give the passing rows of each micro-batch to ``sink``.

    A batch writes the levels of its own keys, in a folder of its own. Each key's newest level before batch n is the
    state that it starts from, so a repeated batch passes the same rows.
    """
    schema = f"`{key}` {logs.schema[key].dataType.simpleString()}, level bigint, tick bigint, v bigint"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        before = None
        if number > 0:
            rows = spark.read.schema(schema).parquet(buckets).filter(F.col("v") < number)
            newest = rows.groupBy(key).agg(F.max_by(F.struct("level", "tick"), "v").alias("b"))
            before = newest.select(key, "b.level", "b.tick")
        allowed = ratelimit.allowances(df, key=key, capacity=capacity, fill=fill, tick_ms=tick_ms, time=time, buckets=before).persist()
        try:
            sink(ratelimit.passing(df, allowed, key=key, capacity=capacity, tick_ms=tick_ms, time=time, order=order), number)
            ratelimit.levels(allowed, key).write.mode("overwrite").parquet(f"{buckets}/v={number}")
        finally:
            allowed.unpersist()

    writer = logs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()
