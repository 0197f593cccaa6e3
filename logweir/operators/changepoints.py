"""Change points: from when to when a service wrote more, or fewer, rows than its own week lets expect.

Rows are counted per service and bucket of time; the rest runs on these counts, whose number depends on the time span and not on the rows. A seasonal
profile gives each slot of the period (hour of the week) a median and a spread. How far a bucket lies from its median, in spreads, is added up: a bucket that
is no more than ``slack`` away lowers the sum, and the sum stays between 0 and twice ``limit``. A change is a stretch of buckets with a sum above 0 that reaches ``limit``.

What a run of buckets does to the sum is always ``min(top, max(floor, sum + shift))``, and such effects compose, so blocks of buckets are folded on their own
and only one entry for each block of a service is chained. Sums are whole thousandths of a spread, so that no order of additions changes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 256  # buckets
SCALE = 1000  # of a spread
MAD_TO_SPREAD = 1.4826  # spread of a normal distribution from its median absolute deviation


def bucket_counts(logs: DataFrame, *, seconds: int = 3600, by: str = "service", time: str = "timestamp") -> DataFrame:
    """``by``, ``bucket``, ``n``: rows in each bucket from a service's first to its last, empty ones included. Rows without a time take no part."""
    counts = logs.select(by, F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds).cast("bigint").alias("bucket"))
    counts = counts.filter("bucket is not null").groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("n"))
    spans = counts.groupBy(by).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    # in two steps, so that no array is as long as the time span
    blocks = spans.withColumn("from", F.explode(F.sequence(F.col("lo"), F.col("hi"), F.lit(BLOCK).cast("bigint"))))
    empty = blocks.select(by, F.explode(F.sequence(F.col("from"), F.least(F.col("hi"), F.col("from") + BLOCK - 1))).alias("bucket"), F.lit(0).cast("bigint").alias("n"))
    return counts.unionByName(empty).groupBy(by, "bucket").agg(F.sum("n").alias("n"))


def seasonal_profile(counts: DataFrame, *, period: int = 168, by: str = "service") -> DataFrame:
    """``by``, ``slot``, ``median``, ``spread``: what a bucket of that slot of the period usually counts.

    The spread is that of the median absolute deviation, and at least that of a Poisson count, so that a slot of few equal counts is not taken for certain.
    """
    slots = counts.withColumn("slot", F.pmod(F.col("bucket"), F.lit(period)))
    # a slot has one bucket for each period of the time span
    usual = slots.withColumn("median", F.percentile("n", 0.5).over(Window.partitionBy(by, "slot")))
    out = usual.groupBy(by, "slot").agg(F.max("median").alias("median"), F.percentile(F.abs(F.col("n") - F.col("median")), 0.5).alias("_mad"))
    poisson = F.sqrt(F.greatest(F.col("median"), F.lit(1.0)))
    return out.select(by, "slot", "median", F.greatest(F.col("_mad") * MAD_TO_SPREAD, poisson).alias("spread"))


def _bounded(x: Column, top: int) -> Column:
    return F.least(F.greatest(x, F.lit(0).cast("bigint")), F.lit(top).cast("bigint"))


def running_sums(steps: DataFrame, by: list[str], top: int, *, block: int = BLOCK) -> DataFrame:
    """``steps`` (``by``, ``bucket``, ``step`` and others) with ``level``: each series' sum of steps so far, held between 0 and ``top`` at every bucket."""
    rest = [c for c in steps.columns if c not in by]
    entry = F.struct("bucket", *[c for c in rest if c != "bucket"])
    runs = steps.withColumn("_block", F.floor(F.col("bucket") / block).cast("bigint")).groupBy(*by, "_block").agg(F.array_sort(F.collect_list(entry)).alias("_run"))

    def compose(f: Column, e: Column) -> Column:
        return F.struct(
            (f["shift"] + e["step"]).alias("shift"), _bounded(f["floor"] + e["step"], top).alias("floor"), _bounded(f["top"] + e["step"], top).alias("top")
        )

    none = F.struct(F.lit(0).cast("bigint").alias("shift"), F.lit(0).cast("bigint").alias("floor"), F.lit(top).cast("bigint").alias("top"))
    runs = runs.withColumn("_effect", F.aggregate("_run", none, compose))

    def enter(acc: Column, b: Column) -> Column:
        after = F.least(b["f"]["top"], F.greatest(b["f"]["floor"], acc["level"] + b["f"]["shift"]))
        return F.struct(after.alias("level"), F.concat(acc["out"], F.array(F.struct(b["_block"].alias("_block"), acc["level"].alias("_start")))).alias("out"))

    begin = F.struct(F.lit(0).cast("bigint").alias("level"), F.array().cast("array<struct<_block:bigint,_start:bigint>>").alias("out"))
    chain = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_block", F.col("_effect").alias("f")))).alias("_blocks"))
    starts = chain.select(*by, F.inline(F.aggregate("_blocks", begin, enter, lambda acc: acc["out"])))

    def follow(acc: Column, e: Column) -> Column:
        level = _bounded(acc["level"] + e["step"], top)
        return F.struct(level.alias("level"), F.concat(acc["out"], F.array(level)).alias("out"))

    first = F.struct(F.col("_start").alias("level"), F.array().cast("array<bigint>").alias("out"))
    both = runs.alias("a").join(starts.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_block"]])
    both = both.select(*[F.col(f"a.{c}").alias(c) for c in by], "_run", F.aggregate("_run", first, follow, lambda acc: acc["out"]).alias("_levels"))
    each = both.select(*by, F.inline(F.arrays_zip(F.col("_run").alias("e"), F.col("_levels").alias("level"))))
    return each.select(*by, *[F.col(f"e.{c}").alias(c) for c in rest], "level")


def changes(
    counts: DataFrame,
    profile: DataFrame | None = None,
    *,
    seconds: int = 3600,
    period: int = 168,
    slack: float = 1.0,
    limit: float = 8.0,
    clip: float = 4.0,
    by: str = "service",
) -> DataFrame:
    """Change points in counts per bucket; see ``change_points``."""
    if min(slack, limit, clip) <= 0 or clip <= slack:
        raise ValueError("limit and slack must be above 0, and clip above slack")
    usual = profile if profile is not None else seasonal_profile(counts, period=period, by=by)
    least, most, reach = int(slack * SCALE), int(limit * SCALE), int(clip * SCALE)
    slots = counts.withColumn("slot", F.pmod(F.col("bucket"), F.lit(period))).alias("c")
    seen = slots.join(usual.alias("p"), F.col(f"c.{by}").eqNullSafe(F.col(f"p.{by}")) & (F.col("c.slot") == F.col("p.slot")))
    away = F.floor(F.lit(float(SCALE)) * (F.col("n") - F.col("median")) / F.col("spread")).cast("bigint")
    away = F.greatest(F.least(away, F.lit(reach)), F.lit(-reach)).cast("bigint")
    seen = seen.select(F.col(f"c.{by}").alias(by), "bucket", "n", F.col("median").alias("usual"), away.alias("_away"))
    ways = F.array(F.struct(F.lit("up").alias("direction"), (F.col("_away") - least).alias("step")), F.struct(F.lit("down").alias("direction"), (-F.col("_away") - least).alias("step")))
    steps = seen.select(by, "bucket", "n", "usual", F.inline(ways))
    series = [by, "direction"]
    sums = running_sums(steps, series, 2 * most)
    in_time = Window.partitionBy(*series).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumns({"_stretch": F.count_if(F.col("level") == 0).over(in_time), "_last": F.max("bucket").over(Window.partitionBy(*series))}).filter("level > 0")
    # the change lasts as long as the sum doesn't fall for good: up to its last highest bucket
    stretch = Window.partitionBy(*series, "_stretch")
    sums = sums.withColumn("_peak", F.max_by("bucket", F.struct("level", "bucket")).over(stretch))
    inside = F.col("bucket") <= F.col("_peak")
    found = sums.groupBy(*series, "_stretch").agg(
        F.min("bucket").alias("onset"),
        F.min(F.when(F.col("level") >= most, F.col("bucket"))).alias("alarm"),
        F.max("_peak").alias("_peak"),
        (F.max("bucket") == F.max("_last")).alias("_open"),
        F.sum(F.when(inside, F.col("n"))).alias("observed"),
        F.sum(F.when(inside, F.col("usual"))).alias("expected"),
    )
    moment = lambda bucket: F.timestamp_seconds(bucket * seconds)
    end = F.when(~F.col("_open"), moment(F.col("_peak") + 1))
    return found.filter("alarm is not null").select(
        *series, moment(F.col("onset")).alias("onset"), moment(F.col("alarm")).alias("alarm"), end.alias("end"), "observed", "expected"
    )


def change_points(
    logs: DataFrame,
    profile: DataFrame | None = None,
    *,
    seconds: int = 3600,
    period: int = 168,
    slack: float = 1.0,
    limit: float = 8.0,
    clip: float = 4.0,
    by: str = "service",
    time: str = "timestamp",
) -> DataFrame:
    """Lasting shifts of a service's row count: direction, onset, alarm, end, rows observed and expected from onset to end.

    ``profile`` is what ``seasonal_profile`` learned from earlier logs; without one the logs' own medians serve, which a change of less than half the periods doesn't
    move. Single buckets count for ``clip`` spreads at most, so that it takes several to raise an alarm. ``onset`` is the first bucket of the stretch, which noise
    can start a few buckets before the change, ``alarm`` the one at which the
    sum reached ``limit``, ``end`` the first bucket after it; null while the sum hasn't come back to 0. A null service is a service of its own.
    Services or slots that a given profile doesn't have are not judged.
    """
    counts = bucket_counts(logs, seconds=seconds, by=by, time=time)
    return changes(counts, profile, seconds=seconds, period=period, slack=slack, limit=limit, clip=clip, by=by)
