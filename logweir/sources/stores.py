"""Rule, filter and strategy tables: one JSON document per row (id, scope, body)."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweir.operators.alerts import AlertRule
from logweir.operators.filters import FilterConfig, active
from logweir.operators.model import Rule, RuleError
from logweir.operators.strategy import Strategy
from logweir.schemas import RULE_STORE
log = logging.getLogger(__name__)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULE_STORE).parquet(path)


def _readable() -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json("body"), "$", "map<string,variant>").isNotNull(), F.lit(False))


def rejects(store: DataFrame) -> DataFrame:
    """The rows that ``documents`` leaves out: their body is no JSON object."""
    return store.filter(~_readable())


def documents(store: DataFrame) -> DataFrame:
    """Readable documents with their id, enabled flag and priority; ``rejects`` has the others."""
    get = lambda path, kind: F.try_variant_get("_doc", path, kind)
    out = store.filter(_readable()).withColumn("_doc", F.parse_json("body"))
    return out.select(
        F.coalesce(get("$.id", "string"), F.lit("")).alias("id"),
        "scope",
        F.coalesce(get("$.name", "string"), F.lit("")).alias("name"),
        F.coalesce(get("$.enabled", "boolean"), F.lit(False)).alias("enabled"),
        F.coalesce(get("$.priority", "bigint"), F.lit(0).cast("bigint")).alias("priority"),
        "body",
    )


def latest(changes: DataFrame) -> DataFrame:
    """A store from its put / delete log (id, scope, body, seq): the last put stands unless deleted."""
    last = changes.groupBy("scope", "id").agg(F.max_by(F.struct("op", "body"), "seq").alias("e"))
    return last.filter("e.op <> 'delete'").select("id", "scope", F.col("e.body").alias("body"))


def active_documents(store: DataFrame) -> DataFrame:
    """Enabled documents, highest priority first, then by id."""
    return documents(store).filter("enabled").orderBy(F.desc("priority"), "id")


def _bodies(store: DataFrame, scope: str | None) -> list:
    rows = documents(store)
    if scope is not None:
        rows = rows.filter(F.col("scope").startswith(scope))
    return rows.select("scope", "body").collect()


def _parsed(store: DataFrame, scope: str | None, parse: Callable, rejected: list[tuple[str, str]] | None) -> list:
    out = []
    for row in _bodies(store, scope):
        try:
            out.append(parse(row))
        except (RuleError, ValueError, AttributeError, TypeError) as error:
            log.warning("document left out: %s", error)
            if rejected is not None:
                rejected.append((row.body, str(error)))
    return out


def load_rules(store: DataFrame, scope: str | None = None, rejected: list[tuple[str, str]] | None = None) -> list[Rule]:
    """Rules to compile into a plan. Documents that do not read as a rule go to ``rejected`` (body, reason) and the log."""
    return _parsed(store, scope, lambda row: Rule.parse(row.body, scope=row.scope or ""), rejected)


def load_filters(store: DataFrame, rejected: list[tuple[str, str]] | None = None) -> list[FilterConfig]:
    return active(_parsed(store, None, lambda row: FilterConfig.parse(row.body), rejected))


def load_strategies(store: DataFrame, rejected: list[tuple[str, str]] | None = None) -> list[Strategy]:
    return _parsed(store, None, lambda row: Strategy.parse(row.body), rejected)


def load_alert_rules(store: DataFrame, rejected: list[tuple[str, str]] | None = None) -> list[AlertRule]:
    return _parsed(store, None, lambda row: AlertRule.parse(row.body), rejected)
