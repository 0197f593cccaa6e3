"""Rule versions as data: validity ranges, rollback, stored rows to trees, rules in force at event time.

``apply_as_of`` puts every version into the plan. ``index_versions`` and ``apply_versions`` keep them as tables: versions are compiled by
the tasks that read them, rows meet the rules that they could match by an index, and the version in force at a row's own time by an as-of join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logweir.functions.fields import Entry
from logweir.functions.values import Value
from logweir.operators import rule_index as X
from logweir.operators.asof import as_of
from logweir.operators.model import Condition, Rule
from logweir.operators.rules import KEEP, Options, apply_rules
from logweir.session import materialise, ship


def history(versions: DataFrame, rule_id: str | None = None) -> DataFrame:
    """Each version with the time it was in force: until the next version of the same rule."""
    if rule_id is not None:
        versions = versions.filter(F.col("rule_id") == rule_id)
    following = Window.partitionBy("rule_id").orderBy("version")
    out = versions.withColumn("valid_to", F.lead("created_at").over(following))
    return out.withColumnRenamed("created_at", "valid_from")


def rollback(versions: DataFrame, targets: DataFrame, at: Column, author: str = "") -> DataFrame:
    """New versions that publish an earlier content again. ``targets``: rule_id, version."""
    latest = versions.groupBy("rule_id").agg(F.max("version").alias("_latest"))
    chosen = versions.join(targets.select("rule_id", "version"), ["rule_id", "version"]).join(latest, "rule_id")
    number = (F.col("_latest") + 1).alias("version")
    return chosen.select(
        F.concat_ws("-", "rule_id", (F.col("_latest") + 1).cast("string")).alias("id"),
        "rule_id",
        number,
        "content",
        F.lit(author).alias("author"),
        F.concat(F.lit("rollback to "), F.col("version").cast("string")).alias("comment"),
        at.cast("timestamp").alias("created_at"),
    )


def current(versions: DataFrame) -> DataFrame:
    """The live content of each rule: its highest version."""
    return versions.groupBy("rule_id").agg(F.max("version").alias("version"), F.max_by("content", "version").alias("content"))


def to_tree(conditions: DataFrame) -> DataFrame:
    """Stored condition rows (rule_id, position, field, operator, value) to one JSON condition per rule.

    One row is a single condition; several are joined with ``all``.
    """
    leaf = F.struct("position", F.to_json(F.struct("field", "operator", "value")).alias("doc"))
    # the conditions of one rule, a handful of rows
    rows = conditions.groupBy("rule_id").agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    docs = F.col("leaves.doc")
    tree = F.when(F.size(docs) == 1, F.get(docs, F.lit(0))).otherwise(F.concat(F.lit('{"all":['), F.array_join(docs, ","), F.lit("]}")))
    return rows.select("rule_id", F.size(docs).alias("conditions"), tree.alias("condition"))


def flatten(rule: Rule) -> list[dict]:
    """The leaves of a rule's condition as stored rows; ``any`` and ``not`` are lost, so keep the tree as well."""
    return [
        {"rule_id": rule.id, "position": i, "field": leaf.field, "operator": leaf.operator, "value": leaf.value}
        for i, leaf in enumerate(rule.condition.leaves())
    ]


def _in_force(value: Value, bounds) -> Column:
    start, end = bounds
    out = F.lit(True)
    if start is not None:
        out = out & (value.raw.cast("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out & (value.raw.cast("timestamp") < F.lit(end).cast("timestamp"))
    return out


def in_force(versions: DataFrame) -> list[tuple[Rule, object, object]]:
    """(rule, valid from, valid to) of a version table (``schemas.RULE_VERSION``): a version holds until the next one of its rule.

    One row for each version of each rule; they become part of a plan, so the driver holds them.
    """
    rows = history(versions).orderBy("rule_id", "version").collect()
    return [(Rule.parse(r["content"]), r["valid_from"], r["valid_to"]) for r in rows]


def apply_as_of(
    df: DataFrame, versions: list[tuple[Rule, object, object]], options: Options = Options(), *, time: str = "timestamp", drop: bool = True
) -> DataFrame:
    """Each row meets the rule version in force at its own time, so a backfill gives what a live run gave.

    ``versions``: (rule, valid_from, valid_to); None leaves a side open. The ranges become part of the
    conditions, so there is no join.
    """
    rules = []
    for rule, start, end in versions:
        guard = Condition(time, "in_force", (start, end))
        # "!" sorts before any character of an id, so versions stay in their rule's place
        rules.append(replace(rule, id=f"{rule.id}!{start or ''}", condition=Condition(all=(guard, rule.condition))))
    operators = {**(options.operators or {}), "in_force": _in_force}
    return apply_rules(df, rules, replace(options, operators=operators), drop=drop)


# ---- any number of versions ----

_COMPILED = f"rule_id string, version long, created_at timestamp, {X.COMPILED}"


@dataclass(frozen=True)
class VersionIndex:
    index: X.RuleIndex  # postings by rule, whatever the version
    versions: DataFrame  # programs by rule, version and start, fields as each rule numbers them
    rejected: DataFrame  # versions whose content is no decision rule: rule_id, version, error


def _mark(start: pa.Scalar) -> str:
    return f"!{start.as_py().replace(tzinfo=None)}" if start.is_valid else "!"


def _compile(entry: Entry, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, str] = {}
        for rows in batches:
            out = []
            for start, content in zip(rows["created_at"], rows["content"].to_pylist(), strict=True):
                try:
                    rule = Rule.parse(content)
                    # the version in force tells itself from the others by its start
                    decision = X._decision(rule, seed, partial(_mark, start))
                except X.UNUSABLE as error:
                    out.append(X.without_effect(entry, None, str(error)))
                    continue
                # a version that is disabled or does nothing is in force, but without effect
                out.append(X.compiled(entry, rule, decision, kinds) if rule.enabled and decision is not None else X.without_effect(entry, rule.id))
            yield X.batch(rows.select(["rule_id", "version", "created_at"]), out)

    return run


def index_versions(versions: DataFrame, like: DataFrame, options: Options = Options()) -> VersionIndex:
    """All versions of a version table (``schemas.RULE_VERSION``) of decision rules as programs and postings.

    Only the names of the fields that rules read come to the driver. A version whose content can't be used ends the one before it and has no effect;
    ``rejected`` lists it.
    """
    spark = versions.sparkSession
    ship(spark)
    entry = Entry.of(like, options.fields, options.shadow)
    rows = versions.select("rule_id", "version", F.col("created_at").cast("timestamp").alias("created_at"), "content")
    made = X.spread(rows, "rule_id", "version", "created_at").mapInArrow(_compile(entry, options.seed), _COMPILED)
    made = materialise(made, "rule-versions")
    programs = made.select("rule_id", "version", "created_at", "id", "ends", "keep", "rate", "salt", "program", "fields")
    return VersionIndex(X.RuleIndex(programs, *X.posted(made, "rule_id")), programs, made.filter("error is not null").select("rule_id", "version", "error"))


def apply_versions(df: DataFrame, versions: VersionIndex, options: Options = Options(), *, time: str = "timestamp", drop: bool = True) -> DataFrame:
    """What ``apply_as_of`` decides: each row meets the version of each rule that is in force at its own time.

    That is the one with the latest start up to then, of those with one start the highest version. Rows without a time meet none. With ``drop`` the kept
    rows, otherwise all rows and ``rule_keep``.
    """
    index = versions.index
    moment = F.col(time).cast("timestamp")

    def sealed() -> DataFrame:
        out = X._sealed(df, index, options).withColumn("_time", moment)
        return out.withColumns({"_one": F.xxhash64("_one", "_time"), "_two": F.xxhash64(F.lit(3), "_two", "_time")})

    # both are read more than once, and their columns cost more than their bytes
    rows = materialise(sealed().select("_one", "_two", "_row", "_time", "_facts").dropDuplicates(["_one", "_two"]), "rule-rows")
    candidates = materialise(X.candidates(rows, index, "_one", "_two", "_time"), "rule-candidates")
    # versions of rules that no row could match play no part
    programs = materialise(versions.versions.join(candidates.select("rule_id").distinct(), "rule_id", "left_semi"), "rule-programs")
    starts = programs.select("rule_id", "version", "created_at")
    met = as_of(candidates, starts, ["rule_id"], F.col("_time"), F.col("created_at"), ["version"])
    met = met.filter("value is not null").select("_one", "_two", "rule_id", F.col("value.version").alias("version"), F.col("value.created_at").alias("created_at"))
    met = met.join(programs.hint("merge"), ["rule_id", "version", "created_at"]).join(rows, ["_one", "_two"]).filter(X.run_program(X.numbered(index.fields), F.col("_facts")))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "_row", "salt")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    choice = F.struct("id", "version", F.when(F.col("rate").isNull(), F.col("keep")).otherwise(drawn < F.col("rate")).alias("keep"))
    decided = met.groupBy("_one", "_two").agg(F.min(F.when(F.col("ends"), choice)).alias("_first"), F.max(F.when(~F.col("ends"), choice)).alias("_last"))
    out = sealed().join(decided, ["_one", "_two"], "left").select(*df.columns, F.coalesce("_first.keep", "_last.keep", F.lit(True)).alias(KEEP))
    return out.filter(KEEP).drop(KEEP) if drop else out
