"""Service reports: top source lines, top message templates, the combined report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweir.operators import mining

LINE = ("path", "function", "line_number")


def _scope(component: str | None, start: str | None, end: str | None, when: Column) -> Column:
    out = F.lit(True)
    if component:
        out = out & (F.col("component") == component)
    if start:
        out = out & (when >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out & (when <= F.lit(end).cast("timestamp_ntz"))
    return out


def top_lines(
    logs: DataFrame, service: str, *, component: str | None = None, start: str | None = None, end: str | None = None, limit: int = 10
) -> DataFrame:
    """Source lines by number of rows. The percentage is of all rows of the service, whatever the other filters."""
    # one pass: rows within the filters and all rows, per line
    inside = _scope(component, start, end, F.col("timestamp").cast("timestamp_ntz"))
    lines = (
        logs.filter(F.col("service") == service)
        .groupBy(*LINE)
        .agg(F.count_if(inside).alias("count"), F.count(F.lit(1)).alias("_all"))
    )
    total = lines.agg(F.sum("_all").alias("total_logs"))  # one row
    top = lines.filter("count > 0").orderBy(F.desc("count"), *LINE).limit(limit)
    return top.crossJoin(F.broadcast(total)).select(
        F.col("path").alias("file"), "function", "line_number", "count", (F.col("count") / F.col("total_logs") * 100).alias("percentage"), "total_logs"
    )


def top_patterns(logs: DataFrame, service: str, *, component: str | None = None, limit: int = 10, samples: int = 3) -> DataFrame:
    """Templates of the service by number of rows, with up to ``samples`` member messages each."""
    mine = logs.filter(F.col("service") == service)
    rows = mine.filter(F.col("component") == component) if component else mine
    total = mine.agg(F.count(F.lit(1)).alias("total_logs"))  # one row
    listed = mining.with_examples(rows, mining.counted(mining.groups(rows)), limit=samples)
    top = listed.withColumnRenamed("total", "count").orderBy(F.desc("count"), "pattern").limit(limit)
    return top.crossJoin(F.broadcast(total)).select(
        "pattern", "count", (F.col("count") / F.col("total_logs") * 100).alias("percentage"), F.col("examples").alias("sample_logs"), "total_logs"
    )


def report(logs: DataFrame, service: str, *, component: str | None = None, limit: int = 10) -> DataFrame:
    """Both top lists as one table: section, rank, label, count, percentage, total_logs."""
    lines = top_lines(logs, service, component=component, limit=limit).select(
        F.lit("lines").alias("section"),
        F.concat_ws(":", "file", "function", F.col("line_number").cast("string")).alias("label"),
        "count",
        "percentage",
        "total_logs",
    )
    mine = logs.filter(F.col("service") == service)
    rows = mine.filter(F.col("component") == component) if component else mine
    counted = mining.mine_patterns(rows).orderBy(F.desc("frequency"), "pattern").limit(limit)
    total = mine.agg(F.count(F.lit(1)).alias("total_logs"))
    patterns = counted.crossJoin(F.broadcast(total)).select(
        F.lit("patterns").alias("section"),
        F.col("pattern").alias("label"),
        F.col("frequency").alias("count"),
        (F.col("frequency") / F.col("total_logs") * 100).alias("percentage"),
        "total_logs",
    )
    # at most 2 x limit rows from here on
    ranked = Window.partitionBy("section").orderBy(F.desc("count"), "label")
    return lines.union(patterns).withColumn("rank", F.row_number().over(ranked))


def report_row(report_rows: DataFrame, service: str, component: str | None = None) -> DataFrame:
    """The stored form of a report: one row, the lists as JSON."""
    entry = F.struct("rank", "label", "count", "percentage")
    listed = lambda name: F.to_json(F.array_sort(F.collect_list(F.when(F.col("section") == name, entry))))
    return report_rows.agg(
        F.max("total_logs").alias("total_logs"), listed("lines").alias("top_lines"), listed("patterns").alias("top_patterns")
    ).select(F.lit(service).alias("service"), F.lit(component or "").alias("component"), "total_logs", "top_lines", "top_patterns")
