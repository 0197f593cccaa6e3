"""Filters next to the rule engine: regex filter configs, composite filters, hooks, filter statistics."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.regex import InvalidPattern, java_pattern
from logweir.functions.steps import compute_once
from logweir.functions.values import variant_text

HEADER = ("message", "raw", "level", "service", "trace_id", "span_id")
ACTIONS = ("allow", "drop", "mark")
COMPOSITE_OPERATORS = ("eq", "ne", "contains", "regex", "gt", "lt", "ge", "le")
# Level ranks.
LEVELS = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3, "FATAL": 4, "PANIC": 5}


@dataclass(frozen=True)
class FilterRule:
    name: str
    field: str
    pattern: str
    action: str = "allow"


@dataclass(frozen=True)
class FilterConfig:
    id: str
    enabled: bool = True
    priority: int = 0
    service: str = ""
    environment: str = ""
    rules: tuple[FilterRule, ...] = ()

    @classmethod
    def parse(cls, doc: dict | str) -> FilterConfig:
        doc = json.loads(doc) if isinstance(doc, str) else doc
        rules = []
        for r in doc.get("rules") or ():
            if r.get("action") not in ACTIONS:
                raise ValueError(f"unknown filter action: {r.get('action')}")
            rules.append(FilterRule(r.get("name") or "", r.get("field") or "", r.get("pattern") or "", r["action"]))
        return cls(
            doc.get("id") or "",
            bool(doc.get("enabled", False)),
            int(doc.get("priority") or 0),
            doc.get("service") or "",
            doc.get("environment") or "",
            tuple(rules),
        )


def active(configs: list[FilterConfig]) -> list[FilterConfig]:
    """Enabled configs, highest priority first, then by id."""
    return sorted((c for c in configs if c.enabled), key=lambda c: (-c.priority, c.id.encode()))


def field_text(df: DataFrame, name: str, fields: str = "fields") -> Column:
    """Text of a header column or dynamic field, empty when missing."""
    if name in HEADER:
        return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")
    if fields not in df.columns:
        return F.lit("")
    return F.coalesce(variant_text(F.try_element_at(F.col(fields), F.lit(name))), F.lit(""))


def _matches(text: Column, pattern: str) -> Column | None:
    try:
        return text.rlike(java_pattern(pattern))
    except InvalidPattern:
        return None


def _decide(df: DataFrame, checks: list[tuple[Column, str, str]], mark_time: Column | None) -> DataFrame:
    """(match, action, name) in order: a drop ends the row; otherwise the last match stands."""
    out = compute_once(df, {f"_f{i}": m for i, (m, _, _) in enumerate(checks)}) if checks else df
    hit = [F.col(f"_f{i}") for i in range(len(checks))]
    stop = F.when(F.lit(False), 0)
    for i, (_, action, _) in enumerate(checks):
        if action == "drop":
            stop = stop.when(hit[i], i)
    out = out.withColumn("_stop", stop.otherwise(len(checks)))
    dropped = F.col("_stop") < len(checks)
    # the dropping rule, or the last one that matched
    name, action, marked = (F.when(F.lit(False), F.lit("")) for _ in range(3))
    for i, (_, act, label) in enumerate(checks):
        if act == "drop":
            name, action = name.when(F.col("_stop") == i, label), action.when(F.col("_stop") == i, "drop")
    for i, (_, act, label) in reversed(list(enumerate(checks))):
        if act != "drop":
            name, action = name.when(~dropped & hit[i], label), action.when(~dropped & hit[i], act)
        if act == "mark":
            marked = marked.when(hit[i] & (F.col("_stop") > i), label)
    columns = {
        "should_keep": ~dropped,
        "filter_action": action.otherwise("allow"),
        "matched_rule": name.otherwise(""),
        "marked_by": marked,
    }
    out = out.withColumns(columns)
    if mark_time is not None:
        out = out.withColumn("mark_time", F.when(F.col("marked_by").isNotNull(), mark_time))
    return out.drop("_stop", *[f"_f{i}" for i in range(len(checks))])


def apply_filters(df: DataFrame, configs: list[FilterConfig], *, fields: str = "fields", mark_time: Column | None = None) -> DataFrame:
    """Adds should_keep, filter_action, matched_rule, marked_by. An empty value or a bad pattern never matches."""
    checks = []
    for config in active(configs):
        for rule in config.rules:
            text = field_text(df, rule.field, fields)
            match = _matches(text, rule.pattern)
            if match is None:
                continue
            match = (text != "") & match
            if config.service:
                match = (F.col("service") == config.service) & match
            checks.append((match, rule.action, rule.name))
    return _decide(df, checks, mark_time)


def matches_any(df: DataFrame, config: FilterConfig, *, fields: str = "fields") -> DataFrame:
    """Rows on which any rule of one config matches; patterns must compile."""
    parts = [field_text(df, r.field, fields).rlike(java_pattern(r.pattern)) for r in config.rules]
    return df.filter(reduce(lambda a, b: a | b, parts, F.lit(False)))


@dataclass(frozen=True)
class CompositeFilter:
    name: str
    operator: str  # AND or OR
    conditions: tuple[tuple[str, str, str], ...] = field(default_factory=tuple)  # field, operator, value
    action: str = "allow"

    def validate(self) -> None:
        if not self.name:
            raise ValueError("condition name cannot be empty")
        if not self.conditions:
            raise ValueError("a composite filter needs a condition")
        for _, op, _ in self.conditions:
            if op not in COMPOSITE_OPERATORS:
                raise ValueError(f"invalid operator: {op}")


def _composite_leaf(text: Column, op: str, value: str) -> Column:
    if op == "regex":
        match = _matches(text, value)
        return F.lit(False) if match is None else match
    if op == "contains":
        return text.contains(value)
    return {
        "eq": text == value, "ne": text != value, "gt": text > value, "lt": text < value, "ge": text >= value, "le": text <= value,
    }[op]


def apply_composite(
    df: DataFrame, filters: list[CompositeFilter], *, fields: str = "fields", mark_time: Column | None = None
) -> DataFrame:
    """Composite filters in order; values compare as text and a missing field is empty."""
    checks = []
    for f in filters:
        f.validate()
        leaves = [_composite_leaf(field_text(df, name, fields), op, value) for name, op, value in f.conditions]
        if f.operator == "AND":
            match = reduce(lambda a, b: a & b, leaves)
        elif f.operator == "OR":
            match = reduce(lambda a, b: a | b, leaves)
        else:
            match = F.lit(False)
        checks.append((match, f.action, f.name))
    return _decide(df, checks, mark_time)


# ---- client-side hooks: predicates, chained with AND ----


def level_hook(minimum: str, level: str = "level") -> Column:
    """Levels at or above ``minimum``; an unknown level passes."""
    rank = F.when(F.lit(False), 0)
    for name, n in LEVELS.items():
        rank = rank.when(F.col(level) == name, n)
    return F.coalesce(rank >= LEVELS[minimum], F.lit(True))


def regex_hook(df: DataFrame, name: str, pattern: str, *, fields: str = "fields") -> Column:
    """A field matches; a custom field that is missing passes."""
    java = java_pattern(pattern)
    if name in ("cluster", "pod", "file", "message", "service", "level"):
        return F.coalesce(F.col(name), F.lit("")).rlike(java) if name in df.columns else F.lit("").rlike(java)
    value = F.try_element_at(F.col(fields), F.lit(name))
    kind = F.schema_of_variant(value)
    number = F.format_string("%.6f", F.try_variant_get(value, "$", "double"))
    text = (
        F.when(kind.isin("STRING", "BIGINT"), value.cast("string")).when((kind == "DOUBLE") | kind.startswith("DECIMAL"), number).otherwise("")
    )
    return value.isNull() | text.rlike(java)


def line_hook(low: int, high: int, line: str = "line_number") -> Column:
    return F.col(line).between(low, high)


def apply_hooks(df: DataFrame, hooks: list[Column]) -> DataFrame:
    for hook in hooks:
        df = df.filter(hook)
    return df


# ---- filter audit ----


def filter_stats(decided: DataFrame) -> DataFrame:
    return decided.agg(*_counts())


def filter_stats_by_service(decided: DataFrame) -> DataFrame:
    out = decided.groupBy("service").agg(*_counts())
    return out.withColumn("drop_rate", F.col("total_dropped") / F.col("total_processed"))


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if("should_keep").alias("total_kept"),
        F.count_if(~F.col("should_keep")).alias("total_dropped"),
        F.count_if(F.col("filter_action") == "mark").alias("total_marked"),
    ]


def recent_decisions(decided: DataFrame, limit: int, *, order: str = "timestamp", key: str = "id") -> DataFrame:
    """The latest ``limit`` audit rows."""
    out = decided.select(key, order, "service", F.col("filter_action").alias("action"), F.col("matched_rule").alias("rule_name"), F.col("should_keep").alias("kept"))
    return out.orderBy(F.desc(order), F.desc(key)).limit(limit)
