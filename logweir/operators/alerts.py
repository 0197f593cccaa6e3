"""Alert rules over logs: a rule fires where a window holds at least ``threshold`` matching rows.

``evaluate`` looks at windows side by side, ``evaluate_sliding`` at the window that ends at each second, so that it also sees
a burst that lies across the edge of two windows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweir.functions.fields import Entry
from logweir.operators.conditions import compile_condition
from logweir.operators.model import Condition


@dataclass(frozen=True)
class AlertRule:
    id: str
    name: str = ""
    enabled: bool = True
    service: str = ""  # empty: every service, counted together
    condition: Condition = Condition()
    threshold: int = 1
    window: int = 60  # seconds
    channels: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, doc: dict | str) -> AlertRule:
        doc = json.loads(doc) if isinstance(doc, str) else doc
        return cls(
            doc.get("id") or "",
            doc.get("name") or "",
            bool(doc.get("enabled", True)),
            doc.get("service") or "",
            Condition.parse(doc.get("condition")),
            int(doc.get("threshold") or 1),
            int(doc.get("window") or 60),
            doc.get("channels") or {},
        )


def matches(logs: DataFrame, rules: list[AlertRule], *, fields: str | None = "fields", time: str = "timestamp") -> DataFrame:
    """One row per log row and rule it matches: rule_id, service, window start. All rules in one scan."""
    entry = Entry.of(logs, fields)
    hits = []
    for rule in rules:
        if not rule.enabled:
            continue
        match = F.coalesce(compile_condition(rule.condition, entry).column, F.lit(False))
        if rule.service:
            match = (F.col("service") == rule.service) & match
        seconds = F.unix_seconds(F.col(time).cast("timestamp"))
        start = seconds - F.pmod(seconds, F.lit(rule.window))
        hits.append(
            F.when(
                match,
                F.struct(
                    F.lit(rule.id).alias("rule_id"),
                    F.lit(rule.service).alias("service"),
                    start.alias("start"),
                    F.lit(rule.window).cast("bigint").alias("window"),
                ),
            )
        )
    none = F.array().cast("array<struct<rule_id:string,service:string,start:bigint,window:bigint>>")
    return logs.select(F.explode(F.array_compact(F.array(*hits)) if hits else none).alias("hit"), time).select("hit.*", time)


def _facts(rules: list[AlertRule]) -> tuple[Column, Column]:
    names = F.when(F.lit(False), "")
    bounds = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for r in rules:
        names = names.when(F.col("rule_id") == r.id, r.name)
        bounds = bounds.when(F.col("rule_id") == r.id, F.lit(r.threshold).cast("bigint"))
    return names, bounds


def fired(counts: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """Alert records of windows that reach the threshold. The id repeats when a window is evaluated again."""
    name, bound = _facts(rules)
    return counts.filter(F.col("count") >= bound).select(
        F.sha2(F.concat_ws(":", "rule_id", F.col("start").cast("string")), 256).alias("id"),
        "rule_id",
        "service",
        F.concat(F.lit(MESSAGE), name).alias("message"),
        F.lit("ERROR").alias("level"),
        F.timestamp_seconds(F.col("start") + F.col("window")).alias("trigger_time"),
        F.lit("pending").alias("status"),
        "count",
        "window",
    )


def evaluate(logs: DataFrame, rules: list[AlertRule], *, fields: str | None = "fields", time: str = "timestamp") -> DataFrame:
    counts = matches(logs, rules, fields=fields, time=time).groupBy("rule_id", "service", "start", "window").agg(F.count(F.lit(1)).alias("count"))
    return fired(counts, rules)


# Fixed value: the head of an alert's text.
MESSAGE = "触发告警: "

BLOCK = 3600  # seconds; a block of time is at least as long as its rule's window
KEY = ["rule_id", "service", "window"]


def second_counts(logs: DataFrame, rules: list[AlertRule], *, fields: str | None = "fields", time: str = "timestamp") -> DataFrame:
    """Matching rows by rule and second: rule_id, service, window, second, n. One row per second, however many rows it has."""
    hits = matches(logs, rules, fields=fields, time=time).select(*KEY, F.unix_seconds(F.col(time).cast("timestamp")).alias("second"))
    return hits.groupBy(*KEY, "second").agg(F.count(F.lit(1)).alias("n"))


def sliding(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``second_counts`` with ``count``, the rows of the ``window`` seconds up to and with this one, and ``before``, those up to the one before.

    A second's rows enter at the second and leave ``window`` seconds later. Time is cut into blocks; what has entered but not left when a block ends is
    carried into the next one, which it leaves, so each block adds up by itself: a task holds the seconds of one rule's block
    and of one window before it.
    """
    length = F.greatest(F.col("window"), F.lit(block).cast("bigint"))
    own = F.floor(F.col("second") / length).cast("bigint")
    leaves = F.col("second") + F.col("window")
    then = F.floor(leaves / length).cast("bigint")

    def event(at: Column, place: Column, enters: Column, change: Column, carried: Column) -> Column:
        values = {"block": place, "second": at, "enters": enters, "change": change, "carried": carried}
        return F.struct(*[v.cast("bigint").alias(k) for k, v in values.items()])

    n, none = F.col("n"), F.lit(0)
    gone = event(leaves, then, none, -n, none)
    carried = F.when(then > own, event(then * length, then, none, none, n))
    events = counts.select(*KEY, F.explode(F.array_compact(F.array(event(F.col("second"), own, n, n, none), gone, carried))).alias("e")).select(*KEY, "e.*")
    by_second = events.groupBy(*KEY, "block", "second").agg(*[F.sum(c).alias(c) for c in ("enters", "change", "carried")])
    place = Window.partitionBy(*KEY, "block").orderBy("second")
    so_far = F.sum("change").over(place) + F.sum("carried").over(Window.partitionBy(*KEY, "block"))
    out = by_second.withColumn("count", so_far)
    # what left at this very second had entered a whole window ago: it still counts up to the second before
    return out.withColumn("before", F.col("count") - F.col("change")).filter("enters > 0").select(*KEY, "second", F.col("enters").alias("n"), "count", "before")


def crossings(counts: DataFrame, rules: list[AlertRule], block: int = BLOCK) -> DataFrame:
    """The seconds at which a rule starts to fire: the window that ends there reaches the threshold, the one a second earlier didn't."""
    _, bound = _facts(rules)
    started = sliding(counts, block).filter((F.col("count") >= bound) & (F.col("before") < bound))
    return fired(started.withColumn("start", F.col("second") - F.col("window")), rules).withColumn("id", F.sha2(F.concat_ws(":", "rule_id", F.unix_seconds("trigger_time").cast("string")), 256))


def evaluate_sliding(logs: DataFrame, rules: list[AlertRule], *, fields: str | None = "fields", time: str = "timestamp", block: int = BLOCK) -> DataFrame:
    """Alert records of every moment at which a rule starts to fire: ``trigger_time`` is the second, ``count`` the rows of the window that ends with it.

    A rule goes on firing while each second's window reaches the threshold, and fires anew after one that doesn't.
    """
    return crossings(second_counts(logs, rules, fields=fields, time=time), rules, block)


def history(alerts: DataFrame, changes: DataFrame | None = None, *, service: str | None = None) -> DataFrame:
    """Alerts with their current status, latest first. ``changes`` is an append-only (alert_id, status, changed_at)."""
    if service:
        alerts = alerts.filter(F.col("service") == service)
    if changes is not None:
        last = changes.groupBy("alert_id").agg(F.max_by("status", F.struct("changed_at", "status")).alias("_status"))
        alerts = (
            alerts.join(last, F.col("id") == F.col("alert_id"), "left")
            .withColumn("status", F.coalesce("_status", "status"))
            .drop("alert_id", "_status")
        )
    return alerts.orderBy(F.desc("trigger_time"), "id")


def resolve(alerts: DataFrame, at: Column) -> DataFrame:
    """Status changes that resolve the given alerts, to append to the change log."""
    return alerts.select(F.col("id").alias("alert_id"), F.lit("resolved").alias("status"), at.cast("timestamp").alias("changed_at"))


def volume_rule(id: str, threshold: int = 10000, window: int = 60) -> AlertRule:
    """All levels of all services together."""
    return AlertRule(id, "volume", True, "", Condition("level", "neq", ""), threshold, window)
