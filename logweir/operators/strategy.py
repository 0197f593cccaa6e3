"""Client strategies: rule lists that decide logging, sampling, priority and transform."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.regex import glob_pattern
from logweir.functions.steps import compute_once
from logweir.operators.actions import unit_hash


@dataclass(frozen=True)
class StrategyRule:
    name: str = ""
    level: str = ""
    service: str = ""
    environment: str = ""
    path_pattern: str = ""
    enabled: bool = False
    sampling: float = 0.0
    priority: str = ""
    transform: str = ""


@dataclass(frozen=True)
class Strategy:
    id: str
    name: str = ""
    enabled: bool = True
    priority: int = 0
    rules: tuple[StrategyRule, ...] = ()

    @classmethod
    def parse(cls, doc: dict | str) -> Strategy:
        doc = json.loads(doc) if isinstance(doc, str) else doc
        rules = []
        for r in doc.get("rules") or ():
            c, a = r.get("condition") or {}, r.get("action") or {}
            rules.append(
                StrategyRule(
                    r.get("name") or "",
                    c.get("level") or "",
                    c.get("service") or "",
                    c.get("environment") or "",
                    c.get("path_pattern") or "",
                    bool(a.get("enabled", False)),
                    float(a.get("sampling") or 0.0),
                    a.get("priority") or "",
                    a.get("transform") or "",
                )
            )
        return cls(doc.get("id") or "", doc.get("name") or "", bool(doc.get("enabled", False)), int(doc.get("priority") or 0), tuple(rules))


def _match(df: DataFrame, rule: StrategyRule, path: str) -> Column:
    out = F.lit(True)
    for name, wanted in (("level", rule.level), ("service", rule.service), ("environment", rule.environment)):
        if wanted:
            out = out & (F.coalesce(F.col(name), F.lit("")) == wanted if name in df.columns else F.lit(False))
    if rule.path_pattern:
        out = out & (F.coalesce(F.col(path).rlike(glob_pattern(rule.path_pattern)), F.lit(False)) if path in df.columns else F.lit(False))
    return out


def decide(df: DataFrame, strategies: list[Strategy], *, path: str = "path", key: str = "id", seed: int = 0) -> DataFrame:
    """Adds ``decision``: should_log, sampling, priority, transform.

    Strategies run by priority, highest first, then id. A matching rule with a disabled action drops the
    row at once; otherwise later matches overwrite what they set.
    """
    ordered = sorted((s for s in strategies if s.enabled), key=lambda s: (-s.priority, s.id.encode()))
    rules = [r for s in ordered for r in s.rules]
    out = compute_once(df, {f"_s{i}": _match(df, r, path) for i, r in enumerate(rules)}) if rules else df
    stop = F.when(F.lit(False), 0)
    for i, r in enumerate(rules):
        if not r.enabled:
            stop = stop.when(F.col(f"_s{i}"), i)
    out = out.withColumn("_stop", stop.otherwise(len(rules)))
    sampling, priority, transform = (F.when(F.lit(False), F.lit(x)) for x in (1.0, "", ""))
    for i, r in reversed(list(enumerate(rules))):
        hit = F.col(f"_s{i}") & (F.col("_stop") > i)
        if r.enabled and 0 < r.sampling < 1:
            sampling = sampling.when(hit, r.sampling)
        if r.enabled and r.priority:
            priority = priority.when(hit, r.priority)
        if r.enabled and r.transform:
            transform = transform.when(hit, r.transform)
    out = out.withColumns(
        {"_sampling": sampling.otherwise(1.0), "_priority": priority.otherwise("normal"), "_transform": transform.otherwise("none")}
    )
    sampled = (F.col("_sampling") >= 1.0) | (unit_hash(F.col(key), "strategy", seed) <= F.col("_sampling"))
    decision = F.struct(
        ((F.col("_stop") == len(rules)) & sampled).alias("should_log"),
        F.col("_sampling").alias("sampling"),
        F.col("_priority").alias("priority"),
        F.col("_transform").alias("transform"),
    )
    return out.withColumn("decision", decision).drop("_stop", "_sampling", "_priority", "_transform", *[f"_s{i}" for i in range(len(rules))])
