"""Message templates: grouping by masked prefix, statistics, anomalies, clusters, recommended rules.

Messages whose first four masked tokens agree share one template, and the first
message of the group (by timestamp, then id) gives it. Grouping is a hash
aggregate with partial aggregation, so a template that holds a third of all rows
costs one row per task in the shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweir.functions import words as W
from logweir.functions.ranks import first_rows, salted_join
from logweir.operators.model import Action, Condition, Rule
from logweir.session import materialise

# Fixed values.
BREAK = r"[\t\n\f\r ,;:=\[\]{}()]+"
VARIABLE = (
    r"^(?:\d+|[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|[a-f0-9]{8,})\z"
    r"|^\d{4}-\d{2}-\d{2}"
)
WILDCARD = "<*>"
# a token that ``is_variable`` takes, inside a longer expression
MASKED = (
    r"(?:\d+|[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|[a-f0-9]{8,}"
    r"|\d{4}-\d{2}-\d{2}[^\t\n\f\r ,;:=\[\]{}()]*)"
)
DEPTH = 4
EXAMPLES = 3
HIGH, MEDIUM = 100, 50


def tokenize(message: Column) -> Column:
    parts = F.array_remove(F.split(message, BREAK, -1), "")
    trimmed = F.filter(F.transform(parts, W.trim_space), lambda t: t != "")
    # only other white space can be left around a token
    return F.when(W.is_ascii(message) & ~message.contains("\x0b"), parts).otherwise(trimmed)


def is_variable(token: Column) -> Column:
    return token.rlike(VARIABLE)


def template(message: Column) -> Column:
    """The message with variables masked; a message without tokens is its own template."""
    masked = F.transform(tokenize(message), lambda t: F.when(is_variable(t), F.lit(WILDCARD)).otherwise(t))
    text = F.array_join(masked, " ")
    return F.when(text == "", message).otherwise(text)


def with_key(df: DataFrame, message: str = "message") -> DataFrame:
    """Adds ``_key``, the group of the message: its first four tokens with variables as ``*``."""
    out = df.withColumn("_tokens", tokenize(F.coalesce(message, F.lit(""))))
    head = [F.get("_tokens", F.lit(i)) for i in range(DEPTH)]
    # concat_ws skips the tokens a short message lacks
    joined = F.concat_ws(" ", *[F.when(is_variable(t), "*").otherwise(t) for t in head])
    key = F.when(F.size("_tokens") == 0, F.concat(F.lit("\x00"), F.coalesce(message, F.lit("")))).otherwise(joined)
    return out.withColumn("_key", key).drop("_tokens")


def _order(order: tuple[str, ...]) -> Column:
    return F.struct(*order)


def groups(df: DataFrame, *, message: str = "message", order: tuple[str, ...] = ("timestamp", "id"), by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: ``_key``, ``pattern``, ``frequency``, ``_first`` (order of the first message)."""
    # the template is worked out for the first message of each group only
    out = (
        with_key(df, message)
        .groupBy(*by, "_key")
        .agg(
            F.count(F.lit(1)).alias("frequency"),
            F.min_by(F.coalesce(message, F.lit("")), _order(order)).alias("_message"),
            F.min(_order(order)).alias("_first"),
        )
    )
    return out.withColumn("pattern", template(F.col("_message"))).drop("_message")


def pattern_id(pattern: Column) -> Column:
    return F.substring(F.sha2(pattern, 256), 1, 16)


def severity(frequency: Column) -> Column:
    return F.when(frequency > HIGH, "high").when(frequency > MEDIUM, "medium").otherwise("low")


def mine_patterns(df: DataFrame, *, message: str = "message", order: tuple[str, ...] = ("timestamp", "id"), by: tuple[str, ...] = ()) -> DataFrame:
    """``id, pattern, frequency, severity``, per ``by`` if given."""
    # groups can share a template only through a token that reads like the wildcard
    found = groups(df, message=message, order=order, by=by).groupBy(*by, "pattern").agg(F.sum("frequency").alias("frequency"))
    return found.select(
        *by, pattern_id(F.col("pattern")).alias("id"), "pattern", "frequency", severity(F.col("frequency")).alias("severity")
    )


def pattern_stats(df: DataFrame, *, message: str = "message", order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """``mine_patterns`` plus the first three examples."""
    found = counted(groups(df, message=message, order=order))
    out = with_examples(df, found, message=message, order=order)
    return out.select(pattern_id(F.col("pattern")).alias("id"), "pattern", F.col("total").alias("frequency"), severity(F.col("total")).alias("severity"), "examples")


def counted(found: DataFrame) -> DataFrame:
    """Groups with ``total``, the frequency of their template: groups can share a template."""
    return found.withColumn("total", F.sum("frequency").over(Window.partitionBy("pattern")))


def with_examples(df: DataFrame, found: DataFrame, *, message: str = "message", order: tuple[str, ...] = ("timestamp", "id"), limit: int = EXAMPLES) -> DataFrame:
    """One row per template of ``found`` (counted groups): pattern, total, examples."""
    rows = first_rows(with_key(df, message).select("_key", message, *order), ["_key"], list(order), limit, "rank").drop("rank")
    named = rows.join(found.select("_key", "pattern", "total"), "_key")
    first = first_rows(named, ["pattern"], list(order), limit, "rank")
    listed = first.groupBy("pattern").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("rank", F.col(message).alias("example")))).alias("_e"))  # ``limit`` at most
    return listed.select("pattern", "total", F.col("_e.example").alias("examples"))


def anomalies(
    current: DataFrame, baseline: DataFrame | None, *, message: str = "message", order: tuple[str, ...] = ("timestamp", "id")
) -> DataFrame:
    """Current rows whose template the baseline does not have; without a baseline, all rows."""
    if baseline is None:
        return current
    unseen = new_groups(current, baseline, message=message, order=order)
    return salted_join(with_key(current, message), unseen.select("_key", "frequency"), "_key", "left_semi", list(order), "frequency").drop("_key")


def new_groups(current: DataFrame, baseline: DataFrame, *, message: str = "message", order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """Groups of the current rows whose template the baseline does not have: _key, pattern, frequency. One aggregate over both sides."""
    both = current.select(message, *order, F.lit(True).alias("_now")).unionByName(baseline.select(message, *order, F.lit(False).alias("_now")))
    text, now = F.coalesce(message, F.lit("")), F.col("_now")
    found = (
        with_key(both, message)
        .groupBy("_key")
        .agg(
            F.count_if(now).alias("frequency"),
            F.count_if(~now).alias("_before"),
            # a group the baseline has keeps the baseline's template
            F.min_by(text, F.struct("_now", *order)).alias("_message"),
        )
        .withColumn("pattern", template(F.col("_message")))
    )
    # a new group may still spell a known template
    known = F.max("_before").over(Window.partitionBy("pattern"))
    return found.withColumn("_known", known).filter("_known = 0").select("_key", "pattern", "frequency")


def clusters(df: DataFrame, *, message: str = "message", order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """Templates with at least two members: ``id, center, size, similarity``."""
    return (
        mine_patterns(df, message=message, order=order)
        .filter("frequency >= 2")
        .select("id", F.col("pattern").alias("center"), F.col("frequency").alias("size"), F.lit(1.0).alias("similarity"))
    )


def cluster_members(df: DataFrame, *, message: str = "message", order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """Every row with the id of its cluster: members stay rows, a cluster is never one value."""
    large = counted(groups(df, message=message, order=order)).filter("total >= 2")
    named = large.select("_key", pattern_id(F.col("pattern")).alias("cluster_id"), F.col("frequency").alias("_count"))
    return salted_join(with_key(df, message), named, "_key", "inner", list(order), "_count").drop("_key")


def recommend_rules(patterns: DataFrame, min_frequency: int = 10) -> DataFrame:
    """Filter rules for frequent patterns: pattern_id, name, description, priority, keywords, frequency."""
    kept = patterns.filter((F.col("frequency") >= min_frequency) & F.col("severity").isin("high", "medium"))
    short = F.when(F.octet_length("pattern") <= 50, F.col("pattern")).otherwise(F.concat(W.byte_prefix(F.col("pattern"), 50), F.lit("...")))
    return kept.select(
        F.col("id").alias("pattern_id"),
        F.concat(F.lit("Auto-generated rule for: "), short).alias("name"),
        F.concat(F.lit("Automatically generated from pattern with frequency "), F.col("frequency").cast("string")).alias("description"),
        F.when(F.col("severity") == "high", 1).otherwise(2).alias("priority"),
        F.lit("message").alias("field"),
        F.lit("matches").alias("operator"),
        matcher(F.col("pattern")).alias("value"),
        F.lit("mark").alias("action"),
        F.to_json(F.struct(F.col("id").alias("value"))).alias("config"),
        "frequency",
    )


def matcher(pattern: Column) -> Column:
    """A regular expression for the messages that read like a template: its tokens in their order, one token for each wildcard.

    The group key is the first tokens alone, so what follows them may differ.
    """
    token = F.transform(
        F.slice(F.split(pattern, " ", -1), 1, DEPTH),
        lambda t: F.when(t == WILDCARD, F.lit(MASKED)).otherwise(F.regexp_replace(t, r"([\\.^$|?*+()\[\]{}])", r"\\$1")),
    )
    gap = BREAK
    ends = F.when(F.size(F.split(pattern, " ", -1)) >= DEPTH, F.lit(f"(?:{gap}|$)")).otherwise(F.lit(f"(?:{gap})?$"))
    return F.concat(F.lit(f"^(?:{gap})?"), F.array_join(token, gap), ends)


def as_rules(recommended: DataFrame, limit: int = 1000) -> list[Rule]:
    """The ``limit`` most urgent recommendations as rules for ``apply_rules``. A rule set is part of a plan, so the driver holds it; ``mark_rows`` has no limit."""
    ordered = recommended.orderBy("priority", F.desc("frequency"), "pattern_id").limit(limit)
    return [
        Rule(
            id=r.pattern_id, name=r.name, condition=Condition(r.field, r.operator, r.value),
            actions=(Action(r.action, json.loads(r.config)),), priority=r.priority,
        )
        for r in ordered.collect()
    ]


def mark_rows(df: DataFrame, recommended: DataFrame, *, message: str = "message", order: tuple[str, ...] = ("timestamp", "id"), tag: str = "tag") -> DataFrame:
    """All rows, those of a recommended pattern with its id in ``tag``. Any number of recommendations: they are joined, not compiled."""
    own = groups(df, message=message, order=order).select("_key", pattern_id(F.col("pattern")).alias("pattern_id"), F.col("frequency").alias("_count"))
    named = own.join(recommended.select("pattern_id"), "pattern_id", "left_semi").withColumnRenamed("pattern_id", tag)
    return salted_join(with_key(df, message), named, "_key", "left", list(order), "_count").drop("_key")


# ---- templates that outlive a run ----


def merge_templates(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Template table after another batch: ``_key, pattern, frequency``. A known group keeps its template."""
    a, b = known.alias("a"), fresh.alias("b")
    return a.join(b, F.col("a._key") == F.col("b._key"), "full_outer").select(
        F.coalesce("a._key", "b._key").alias("_key"),
        F.coalesce("a.pattern", "b.pattern").alias("pattern"),
        (F.coalesce("a.frequency", F.lit(0)) + F.coalesce("b.frequency", F.lit(0))).cast("bigint").alias("frequency"),
    )


# ---- wildcard mode ----


def mine_patterns_wildcard(df: DataFrame, *, message: str = "message", order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """Templates when a group may fall back to a variable at any position.

    Groups are taken in the order they are first seen. A group walks down the prefixes that exist by
    then, taking its own token if it can and ``*`` otherwise. If it arrives at an earlier group it joins
    it, else it becomes a group of its own. Whether a group stands alone depends only on earlier groups,
    so the decisions are found by repeating joins until they no longer change.
    """
    found = groups(df, message=message, order=order).withColumn("_path", F.split("_key", " ", -1))
    found = materialise(found, "wildcard-groups")
    # paths without tokens never fall back
    walkers = found.filter(~F.col("_key").startswith("\x00"))
    own = materialise(walkers.select("_key", F.lit(True).alias("_own")), "wildcard-own")
    while True:
        walked = _walk(walkers, own)
        decided = materialise(walked.select("_key", F.col("_to").isNull().alias("_own"), "_to"), "wildcard-own")
        changed = decided.join(own.select("_key", F.col("_own").alias("_was")), "_key").filter("_own <> _was").limit(1).count()
        own = decided.select("_key", "_own")
        if not changed:
            break
    target = decided.select("_key", F.coalesce("_to", "_key").alias("_target"))
    assigned = found.join(target, "_key", "left").withColumn("_target", F.coalesce("_target", "_key"))
    heads = found.select(F.col("_key").alias("_target"), "pattern")
    out = assigned.drop("pattern").join(heads, "_target").groupBy("pattern").agg(F.sum("frequency").alias("frequency"))
    return out.select(pattern_id(F.col("pattern")).alias("id"), "pattern", "frequency", severity(F.col("frequency")).alias("severity"))


def _walk(walkers: DataFrame, own: DataFrame) -> DataFrame:
    """Adds ``_to``, the earlier group each group arrives at, null if none."""
    standing = walkers.join(own.filter("_own").select("_key"), "_key", "left_semi")
    prefixes = standing.select(
        "_first", F.explode(F.transform(F.sequence(F.lit(1), F.size("_path")), lambda n: F.array_join(F.slice("_path", 1, n), " "))).alias("_node")
    )
    nodes = prefixes.groupBy("_node").agg(F.min("_first").alias("_born"))
    out = walkers.select("_key", "_path", "_first").withColumn("_at", F.lit(""))
    for depth in range(DEPTH):
        step = F.get("_path", F.lit(depth))
        ahead = F.when(F.col("_at") == "", F.lit("")).otherwise(F.concat("_at", F.lit(" ")))
        out = out.withColumns({"_exact": F.concat(ahead, step), "_star": F.concat(ahead, F.lit("*"))})
        for name in ("_exact", "_star"):
            hit = nodes.select(F.col("_node").alias(name), F.col("_born").alias(f"{name}_born"))
            out = out.join(hit, name, "left")
        moved = F.when(F.col("_exact_born") < F.col("_first"), F.col("_exact")).when(F.col("_star_born") < F.col("_first"), F.col("_star"))
        # a path that has ended stays where it is; a walk that failed stays null
        out = out.withColumn("_at", F.when(step.isNull(), F.col("_at")).otherwise(moved)).select("_key", "_path", "_first", "_at")
    ends = standing.select(F.col("_key").alias("_at"), F.col("_first").alias("_end_first"))
    arrived = F.when(F.col("_end_first") < F.col("_first"), F.col("_at"))
    return out.join(ends, "_at", "left").select("_key", arrived.alias("_to"))
