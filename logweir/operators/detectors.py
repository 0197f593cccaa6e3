"""Time-series findings per service: error spikes, frequency changes, slow responses, new templates.

Rows are first counted per service and time bucket. The trailing window then runs
over buckets, whose number depends on the time span and not on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweir.operators import mining


def _bucket(time: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds).cast("bigint")


def _trailing(by: str, buckets: int):
    return Window.partitionBy(by).orderBy("bucket").rangeBetween(-buckets, -1)


def error_spikes(
    logs: DataFrame, *, seconds: int = 3600, trailing: int = 24, ratio: float = 3.0, minimum: int = 3, by: str = "service", time: str = "timestamp"
) -> DataFrame:
    """Buckets with at least ``minimum`` errors and ``ratio`` times the mean of the buckets before."""
    counts = logs.filter(F.col("level") == "ERROR").groupBy(by, _bucket(time, seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("errors"))
    # buckets without errors count as zero
    mean = F.coalesce(F.sum("errors").over(_trailing(by, trailing)), F.lit(0)) / trailing
    return counts.withColumn("expected", mean).filter((F.col("errors") >= minimum) & (F.col("errors") >= F.col("expected") * ratio))


def frequency_changes(
    logs: DataFrame, *, seconds: int = 86400, trailing: int = 3, ratio: float = 1.2, by: str = "service", time: str = "timestamp"
) -> DataFrame:
    """Buckets whose row count rose or fell by ``ratio`` against the mean of the buckets before."""
    counts = logs.groupBy(by, _bucket(time, seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("total"))
    mean = F.sum("total").over(_trailing(by, trailing)) / trailing
    out = counts.withColumn("expected", mean).filter(F.col("expected").isNotNull())
    up, down = F.col("total") >= F.col("expected") * ratio, F.col("total") * ratio <= F.col("expected")
    return out.filter(up | down).withColumn("direction", F.when(up, "up").otherwise("down"))


def slow_responses(
    logs: DataFrame,
    *,
    value: str = "duration_ms",
    seconds: int = 86400,
    trailing: int = 3,
    percent: float = 0.95,
    ratio: float = 1.1,
    by: str = "service",
    time: str = "timestamp",
) -> DataFrame:
    """Buckets whose percentile rose by ``ratio`` against the mean percentile of the buckets before."""
    # equal values are counted first; the first value with enough rows up to it is the exact percentile
    group = [by, "bucket"]
    counts = logs.filter(F.col(value).isNotNull()).groupBy(by, _bucket(time, seconds).alias("bucket"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(Window.partitionBy(*group))})
    buckets = ranked.filter(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(percent) - 1e-9)).groupBy(*group).agg(F.min("_v").alias("observed"))
    mean = F.avg("observed").over(_trailing(by, trailing))
    return buckets.withColumn("expected", mean).filter(F.col("observed") >= F.col("expected") * ratio)


def new_patterns(logs: DataFrame, since: Column, *, time: str = "timestamp") -> DataFrame:
    """Templates first seen at or after ``since``: pattern, frequency since then."""
    current, baseline = logs.filter(F.col(time) >= since), logs.filter(F.col(time) < since)
    found = mining.new_groups(current, baseline).groupBy("pattern").agg(F.sum("frequency").alias("frequency"))
    frequency = F.col("frequency")
    return found.select(mining.pattern_id(F.col("pattern")).alias("id"), "pattern", "frequency", mining.severity(frequency).alias("severity"))
