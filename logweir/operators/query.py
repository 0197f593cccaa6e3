"""Queries over a logs table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logweir.operators.conditions import filter_where
from logweir.operators.paging import page_of


def _moment(logs: DataFrame, value) -> Column:
    """A time literal in the type of the timestamp column, so that the comparison can reach the scan."""
    return F.lit(value).cast(logs.schema["timestamp"].dataType)


NEWEST = ["timestamp", "id"]  # pages are newest first


def select_logs(logs: DataFrame, *, service=None, component=None, level=None, start=None, end=None) -> DataFrame:
    for name, value in (("service", service), ("component", component), ("level", level)):
        if value:
            logs = logs.filter(F.col(name) == value)
    if start:
        logs = logs.filter(F.col("timestamp") >= _moment(logs, start))
    if end:
        logs = logs.filter(F.col("timestamp") <= _moment(logs, end))
    return logs


def query_logs(logs: DataFrame, *, limit: int | None = 100, offset: int = 0, **where) -> DataFrame:
    """A page of matching rows, newest first, with the total number of matches (``limit`` None: all rows)."""
    return page_of(select_logs(logs, **where), NEWEST, limit, offset)


def holds(text: str, columns: Sequence[str]) -> Column:
    """Some column holds the text, whatever its case."""
    return F.coalesce(*[F.when(F.contains(F.lower(F.col(c).cast("string")), F.lower(F.lit(text))), True) for c in columns], F.lit(False))


def search(logs: DataFrame, text: str, *, columns: Sequence[str] = ("message",), limit: int | None = None, offset: int = 0, **where) -> DataFrame:
    """A page of the rows that hold the text in some of ``columns``, whatever its case; newest first, with the total."""
    if not text:
        raise ValueError("search needs a text")
    return page_of(select_logs(logs, **where).filter(holds(text, columns)), NEWEST, limit, offset)


def query_filters(
    logs: DataFrame, filters: dict, *, text: str | None = None, columns: Sequence[str] = ("message",), limit: int | None = None, offset: int = 0, fields: str | None = "fields"
) -> DataFrame:
    """Equality filters on columns or dynamic fields, optionally with a text; newest first, with the total."""
    for name, value in filters.items():
        logs = filter_where(logs, {"field": name, "operator": "in" if isinstance(value, list) else "eq", "value": value}, fields=fields)
    if text:
        logs = logs.filter(holds(text, columns))
    return page_of(logs, NEWEST, limit, offset)


def aggregate_by(logs: DataFrame, field: str, *, interval: str | None = None, filters: dict | None = None, fields: str | None = "fields") -> DataFrame:
    """Counts by any column or dynamic field, in time buckets if an ``interval`` is given: bucket, value, total, errors, error_rate.

    Rows without the field count under null.
    """
    for name, value in (filters or {}).items():
        logs = filter_where(logs, {"field": name, "operator": "in" if isinstance(value, list) else "eq", "value": value}, fields=fields)
    value = F.col(field).cast("string") if field in logs.columns else F.try_element_at(F.col(fields), F.lit(field)).cast("string")
    bucket = F.window("timestamp", interval)["start"] if interval else F.lit(None).cast(logs.schema["timestamp"].dataType)
    return (
        logs.select(bucket.alias("bucket"), value.alias("value"), "level")
        .groupBy("bucket", "value")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("level") == "ERROR").alias("errors"))
        .withColumn("error_rate", F.col("errors") / F.col("total"))
    )


def aggregate_overview(logs: DataFrame) -> DataFrame:
    """Totals by level and service: dimension, value, total, errors, error_rate."""
    # rows are counted once; the grouping sets then triple a few counts, not the rows
    counts = logs.groupBy("level", "service").agg(F.count(F.lit(1)).alias("n"))
    errors = F.sum(F.when(F.col("level") == "ERROR", F.col("n")).otherwise(0))
    sets = counts.groupingSets([["level"], ["service"], []], "level", "service").agg(
        F.grouping_id().alias("_set"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(errors, F.lit(0)).alias("errors")
    )
    return sets.select(
        F.when(F.col("_set") == 1, "level").when(F.col("_set") == 2, "service").otherwise("all").alias("dimension"),
        F.when(F.col("_set") == 1, F.col("level")).when(F.col("_set") == 2, F.col("service")).otherwise("").alias("value"),
        "total",
        "errors",
        F.try_divide("errors", "total").alias("error_rate"),
    )


def aggregate_by_interval(logs: DataFrame, interval: str, by: str = "service") -> DataFrame:
    """Counts per time bucket and field."""
    return (
        logs.groupBy(F.window("timestamp", interval).alias("w"), F.col(by))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("level") == "ERROR").alias("errors"))
        .select(F.col("w.start").alias("bucket"), by, "total", "errors", (F.col("errors") / F.col("total")).alias("error_rate"))
    )


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_escaped(logs: DataFrame, text: str, column: str = "message") -> DataFrame:
    """Rows that hold the text literally: ``%`` and ``_`` are no wildcards."""
    return logs.filter(F.col(column).like(f"%{escape_like(text)}%"))


def normalize(message: Column) -> Column:
    """Hex numbers, longer numbers, user and trace ids as placeholders."""
    word = r"\w"
    out = F.regexp_replace(message, rf"(?<!{word})0x[0-9a-fA-F]+(?!{word})", "{hex}")
    out = F.regexp_replace(out, rf"(?<!{word})\d{{2,}}(?!{word})", "{n}")
    out = F.regexp_replace(out, r"u_\d+", "u_{n}")
    return F.regexp_replace(out, r"tr_[0-9a-f]+", "tr_{id}")


def normalize_patterns(logs: DataFrame, service: str, limit: int = 10) -> DataFrame:
    """Top normalised messages of a service, percentage to one decimal."""
    mine = logs.filter(F.col("service") == service)
    total = mine.agg(F.count(F.lit(1)).alias("_total"))  # one row
    top = mine.groupBy(normalize(F.col("message")).alias("pattern")).agg(F.count(F.lit(1)).alias("count"))
    top = top.orderBy(F.desc("count"), "pattern").limit(limit)
    share = F.col("count") * 100 / F.col("_total")
    # half away from zero, as a decimal text would round
    return top.crossJoin(F.broadcast(total)).select("pattern", "count", (F.floor(share * 10 + 0.5) / 10).alias("percentage"))


# ---- named SQL over the logs view ----

TEMPLATES = {
    "recent_errors": """select * from {logs} where level = 'ERROR' and timestamp > {now} - interval 1 hour
        order by timestamp desc, id desc limit 100""",
    "errors_by_service": """select service, count(*) as error_count from {logs}
        where level = 'ERROR' and timestamp > {now} - interval 24 hours group by service order by error_count desc, service""",
    "trace_logs": "select * from {logs} where trace_id = {trace_id} order by timestamp, id",
    "slow_requests": """select * from {logs} where duration_ms > 1000 and timestamp > {now} - interval 1 hour
        order by duration_ms desc, id limit 50""",
    "latest_errors": "select * from {logs} where level = 'ERROR' order by timestamp desc, id desc limit 100",
    "by_service": """select service, count(*) as count from {logs} where timestamp > {now} - interval 1 hour
        group by service order by count desc, service""",
    "by_level": "select level, count(*) as count from {logs} group by level order by count desc, level",
    "active_users": """select user_id, count(*) as request_count from {logs} where event_type = {event_type}
        group by user_id order by request_count desc, user_id limit 10""",
}


def run_template(logs: DataFrame, name: str, **params) -> DataFrame:
    """A named query. ``now`` and other values are parameters, so runs repeat."""
    text = TEMPLATES[name]
    used = {k: v for k, v in params.items() if "{" + k + "}" in text}
    for k in used:
        text = text.replace("{" + k + "}", f":{k}")
    return logs.sparkSession.sql(text, args=used, logs=logs)


def sql(logs: DataFrame, text: str, view: str = "logs") -> DataFrame:
    """Any SQL over the logs table under its view name."""
    logs.createOrReplaceTempView(view)
    return logs.sparkSession.sql(text)


def rules_with_children(rules: DataFrame, conditions: DataFrame, actions: DataFrame, *, service=None, component=None) -> DataFrame:
    """Stored rules with their condition and action rows, optionally of one service or component."""
    for name, value in (("service", service), ("component", component)):
        if value:
            rules = rules.filter(F.col(name) == value)

    def children(rows: DataFrame, name: str) -> DataFrame:
        entry = F.struct(*[c for c in rows.columns if c != "rule_id"])
        # the children of one rule, a handful of rows
        return rows.groupBy("rule_id").agg(F.array_sort(F.collect_list(entry)).alias(name))

    out = rules.join(children(conditions, "conditions"), F.col("id") == F.col("rule_id"), "left").drop("rule_id")
    return out.join(children(actions, "actions"), F.col("id") == F.col("rule_id"), "left").drop("rule_id")
