"""Alert rules on a stream: event-time windows with a watermark, and sliding windows over a table of recent seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from logweir.operators.alerts import KEY, AlertRule, crossings, fired, matches, second_counts
from logweir.schemas import ALERT


def evaluate(logs: DataFrame, rules: list[AlertRule], *, lateness: str = "1 minute", fields: str | None = "fields", time: str = "timestamp") -> list[DataFrame]:
    """One streaming result per window length, for update mode: an alert appears when its window reaches the threshold, and again with every higher count.

    Only counts per open window and rule are kept as state. Rows later than the watermark are dropped
    by Spark and counted in the query's progress.
    """
    out = []
    for seconds in sorted({r.window for r in rules if r.enabled}):
        mine = [r for r in rules if r.window == seconds]
        timed = logs.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
        hits = matches(timed, mine, fields=fields, time=time)
        counts = hits.groupBy("rule_id", "service", F.window(time, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("count"))
        counts = counts.select(
            "rule_id", "service", F.unix_seconds("w.start").alias("start"), F.lit(seconds).cast("bigint").alias("window"), "count"
        )
        out.append(fired(counts, mine))
    return out


def start(logs: DataFrame, rules: list[AlertRule], out: str, checkpoint: str, *, lateness: str = "1 minute", trigger: dict | None = None, **kw) -> list:
    """Write fired alerts below ``out``, one query and folder per window length and one folder per batch; ``read`` gives their last counts.

    The windows that are still open when a run ends have fired as far as they were filled.
    """

    def writer_to(folder: str):
        def write(df: DataFrame, number: int) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/batch={number}")

        return write

    queries = []
    for n, alerts in enumerate(evaluate(logs, rules, lateness=lateness, **kw)):
        writer = alerts.writeStream.foreachBatch(writer_to(f"{out}/part={n}")).outputMode("update").option("checkpointLocation", f"{checkpoint}/{n}")
        queries.append(writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start())
    return queries


def read(spark: SparkSession, out: str) -> DataFrame:
    """Each alert once, with the count of its last batch."""
    rows = spark.read.schema(StructType([*ALERT, StructField("part", IntegerType()), StructField("batch", LongType())])).parquet(out)
    rest = [f for f in rows.columns if f not in ("id", "part", "batch")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), "batch").alias("_a")).select("id", "_a.*")


# ---- sliding windows ----

_STATE = "rule_id string, service string, window bigint, second bigint, n bigint"


def start_sliding(
    logs: DataFrame, rules: list[AlertRule], out: str, state: str, checkpoint: str, *, lateness: int = 60, trigger: dict | None = None, fields: str | None = "fields", time: str = "timestamp"
):
    """Write the moments at which rules start to fire below ``out``, a folder per batch; ``read_sliding`` gives them.

    The state is a table of counts by rule and second, a version per batch, with the seconds that a window can still reach: it is aggregated
    before it is shuffled, so a rule that a third of all rows match is one row a second and no task's burden. The clock is the latest second seen less
    ``lateness`` seconds. Rows from before it are left out. What happened before the clock is final; later moments are written anew by each batch.
    A repeated batch starts from the same version and overwrites its own.
    """
    reach = max((r.window for r in rules if r.enabled), default=0)

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        before = spark.read.schema(_STATE).parquet(f"{state}/v={number - 1}") if number else spark.createDataFrame([], _STATE)
        # the row without a rule holds the latest second seen
        clock = before.filter("rule_id is null").agg(F.max("second")).first()[0]
        second = F.unix_seconds(F.col(time).cast("timestamp"))
        timely = df if clock is None else df.filter(second > clock - lateness)
        counts = before.filter("rule_id is not null").unionByName(second_counts(timely, rules, fields=fields, time=time)).groupBy(*KEY, "second").agg(F.sum("n").alias("n"))
        latest = df.agg(F.max(second)).first()[0]
        now = max((x for x in (clock, latest) if x is not None), default=None)
        held = counts if now is None else counts.filter(F.col("second") >= now - lateness - reach)
        mark = spark.createDataFrame([] if now is None else [(None, None, None, now, None)], _STATE)
        found = crossings(counts, rules)
        at = F.unix_seconds("trigger_time")
        if clock is not None:
            found = found.filter(at > clock - lateness)  # the others are final already
        final = F.lit(False) if now is None else at <= now - lateness
        found.withColumn("final", final).write.mode("overwrite").parquet(f"{out}/batch={number}")
        held.unionByName(mark).write.mode("overwrite").parquet(f"{state}/v={number}")

    writer = logs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def read_sliding(spark: SparkSession, out: str) -> DataFrame:
    """Final moments of all batches, and those of the last batch that may still change."""
    rows = spark.read.schema(StructType([*ALERT, StructField("final", BooleanType()), StructField("batch", LongType())])).parquet(out)
    last = rows.agg(F.max("batch").alias("last"))  # one row
    return rows.crossJoin(F.broadcast(last)).filter("final or batch = last").drop("batch", "last")
