"""Latency and pipeline figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from logweir.functions.ranks import first_rows

PERCENTS = (50, 95, 99)
SPLITS = 1024
STEP = 32


def latency_stats(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """count, avg, min, max and exact p50 / p95 / p99, where pX is element floor(n*X/100) of the sorted values.

    Equal values are counted first. Approximate quantiles then cut each group into ranges; running totals
    over the ranges tell which one holds a percentile, and only those ranges are sorted. No task sees more
    than about a thousandth of a group's distinct values.
    """
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    rows = rows.select(*keys, F.col(value).alias("v")).filter(F.col("v").isNotNull())
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("v").alias("avg"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.percentile_approx("v", [i / SPLITS for i in range(1, SPLITS)], 20 * SPLITS).alias("_cuts"),
    )
    distinct = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    # cuts are sorted, so the range is the number of cuts below the value: count every STEP-th cut, then the rest
    cuts = totals.select(*keys, F.array_distinct("_cuts").alias("_cuts"))
    marks = F.transform(F.sequence(F.lit(1), F.lit(SPLITS // STEP)), lambda i: F.get("_cuts", i * STEP - 1))
    cuts = cuts.withColumn("_marks", F.filter(marks, lambda c: c.isNotNull()))
    below = lambda c: c < F.col("v")
    located = distinct.join(cuts, keys).withColumn("_from", F.size(F.filter("_marks", below)) * STEP)
    located = located.select(*keys, "v", "n", (F.col("_from") + F.size(F.filter(F.slice("_cuts", F.col("_from") + 1, F.lit(STEP)), below))).alias("range"))
    ranges = located.groupBy(*keys, "range").agg(F.sum("n").alias("size"))
    running = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a thousand rows per group
    offsets = ranges.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    ranks = totals.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(p).alias("p"), (F.floor(F.col("count") * p / 100) + 1).alias("rank")) for p in PERCENTS])).alias("t"),
    ).select(*keys, "t.p", "t.rank")
    wanted = ranks.join(offsets, keys).filter((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("size")))
    inside = Window.partitionBy(*keys, "p").orderBy("v")
    chosen = (
        wanted.join(located.select(*keys, "range", "v", "n"), [*keys, "range"])
        .withColumn("upto", F.col("before") + F.sum("n").over(inside))
        .filter(F.col("upto") >= F.col("rank"))
        .groupBy(*keys, "p")
        .agg(F.min("v").alias("v"))
    )
    points = chosen.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in PERCENTS])
    return totals.drop("_cuts").join(points, keys).drop("_all")


def last_n(df: DataFrame, n: int, by: tuple[str, ...], order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """The newest ``n`` rows per group."""
    return first_rows(df, list(by), list(order), n, "_n", descending=True).drop("_n")


def pipeline_metrics(decided: DataFrame, *, parsed: str = "parsed", kept: str = "should_keep", time: str = "timestamp") -> DataFrame:
    """Counts and rates of one run over rows that carry a parse flag and a keep decision."""
    ok = F.coalesce(F.col(parsed), F.lit(False))
    out = decided.agg(
        F.count(F.lit(1)).alias("parse_count"),
        F.count_if(ok).alias("parse_success"),
        F.count_if(~ok).alias("parse_failure"),
        F.count_if(ok).alias("filter_count"),
        F.count_if(ok & F.col(kept)).alias("filter_kept"),
        F.count_if(ok & ~F.col(kept)).alias("filter_dropped"),
        (F.unix_seconds(F.max(F.col(time).cast("timestamp"))) - F.unix_seconds(F.min(F.col(time).cast("timestamp")))).alias("_span"),
    )
    return out.select(
        *[c for c in out.columns if c != "_span"],
        F.coalesce(F.try_divide(F.col("filter_dropped") * 100.0, F.col("filter_count")), F.lit(0.0)).alias("filter_rate"),
        F.coalesce(F.try_divide(F.col("parse_success") * 100.0, F.col("parse_count")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.try_divide(F.col("parse_count") * 1.0, F.col("_span")), F.lit(0.0)).alias("throughput"),
    )
