"""Percentiles that add up: a quantile sketch for each service and hour, kept as a table and merged when it is read.

The table is a folder for each batch. A batch writes sketches of the hours that its rows belong to, so late rows touch their own hours only, and a batch that runs again
replaces its own folder. Readers merge whatever batches there are; ``compact`` writes the merged table anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweir.operators.quality import PERCENTS

K = 2048  # the size of a sketch
# Of the ranks that the sketch's own documentation states for a size of 2,048 (about 0.0015 with 99 % confidence), with room to spare.
RANK_ERROR = 0.005


def sketch(df: DataFrame, value: str, by: tuple[str, ...] = ("service",), *, seconds: int = 3600, time: str = "timestamp") -> DataFrame:
    """``by``, ``hour`` (start of the span of ``seconds``, null for rows without a time), ``sketch``, ``count``, ``sum``, ``min``, ``max``. Rows without a value take no part."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds) * seconds)
    rows = df.select(*by, start.alias("hour"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    # aggregated in the tasks first: an hour of one service costs one sketch a task, however many rows it has
    return rows.groupBy(*by, "hour").agg(
        F.kll_sketch_agg_double("v", F.lit(K)).alias("sketch"), F.count("v").alias("count"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max")
    )


def _merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    out = sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"), F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max")
    )
    return out.select(*by, "sketch", "count", "sum", "min", "max")


def absorb(sketches: DataFrame, path: str, batch: int) -> None:
    """Add a batch's sketches to the table; a batch that was there already is replaced."""
    sketches.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def compact(spark: SparkSession, path: str, target: str, by: tuple[str, ...] = ("service",)) -> None:
    """Write the table with one sketch for each service and hour to a new place."""
    absorb(_merged(read(spark, path), [*by, "hour"]), target, 0)


def latency_sketched(sketches: DataFrame, by: tuple[str, ...] = ("service",), hours: Column | None = None) -> DataFrame:
    """count, avg, min, max, p50, p95, p99 from the sketches of the chosen hours (all without ``hours``).

    ``by``: any part of the columns that the sketches are kept by; none for one row over all. Percentiles are values of the data whose rank is within ``RANK_ERROR`` of the asked one.
    """
    chosen = sketches if hours is None else sketches.filter(hours)
    merged = _merged(chosen if by else chosen.withColumn("_all", F.lit(0)), list(by) or ["_all"])
    points = [F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias(f"p{p}") for p in PERCENTS]
    return merged.select(*by, "count", (F.col("sum") / F.col("count")).alias("avg"), "min", "max", *points)


def rank_errors(df: DataFrame, value: str, found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``found`` with ``e50``, ``e95``, ``e99``: how far the asked rank lies from the ranks that the value really holds, as a share of the rows."""
    values = df.select(*by, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    counted = values.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("_n"))
    wanted = found.select(*by, F.col("count").alias("_all"), *[f"p{p}" for p in PERCENTS])
    both = counted.join(wanted, list(by)) if by else counted.crossJoin(F.broadcast(wanted))
    sums = [F.sum(F.when(F.col("v") < F.col(f"p{p}"), F.col("_n")).otherwise(0)).alias(f"_b{p}") for p in PERCENTS]
    sums += [F.sum(F.when(F.col("v") <= F.col(f"p{p}"), F.col("_n")).otherwise(0)).alias(f"_t{p}") for p in PERCENTS]
    ranks = both.groupBy(*by).agg(F.max("_all").alias("_all"), *sums)
    miss = [F.greatest(F.col(f"_b{p}") / F.col("_all") - p / 100, F.lit(p / 100) - F.col(f"_t{p}") / F.col("_all"), F.lit(0.0)).alias(f"e{p}") for p in PERCENTS]
    return ranks.select(*by, *miss)
