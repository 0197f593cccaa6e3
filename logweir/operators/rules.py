"""Rule sets over tables of log entries.

Rules run in key order. A match runs the rule's actions; ``keep`` and ``drop``
end the evaluation of that row; later rules see the edits of earlier ones.

The whole set becomes a short chain of narrow steps and no shuffle. Consecutive
rules form a group as long as none of them reads what an earlier one of the group
writes. A group that only decides is one CASE expression, whatever its length,
and reaches the scan as a filter. A group that edits computes its match flags
once, then all its edits in one step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logweir.functions.fields import Entry
from logweir.functions.steps import compute_once, settle
from logweir.operators.actions import Context, Effect, Handler, compile_action, touched, written
from logweir.operators.conditions import Operator, compile_condition
from logweir.operators.model import Condition, Rule, in_order

KEEP, AUDIT, ERRORS = "rule_keep", "rule_audit", "rule_errors"
_DONE, _STOP = "_rule_done", "_rule_stop"
_NEVER = 2**31 - 1

AUDIT_ENTRY = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("matched", T.BooleanType()),
        T.StructField("should_keep", T.BooleanType()),
        T.StructField("terminate", T.BooleanType()),
        T.StructField(
            "actions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("success", T.BooleanType()),
                        T.StructField("error", T.StringType()),
                        T.StructField("metadata", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("planned", T.IntegerType()),  # actions the rule has, run or not
    ]
)


COUNTERS = ("rule_matched", "rule_actions", "rule_failed")
ENDED = "rule_ended"


@dataclass(frozen=True)
class Options:
    fields: str | None = "fields"
    shadow: bool = False  # keys of the fields map hide standard columns
    key: str = "id"  # identity of a row, for sampling
    seed: int = 0
    compat: bool = False  # keep decision of the original engine on termination, see rules_terminate
    audit: bool = False
    counters: bool = False  # four columns that ``rule_stats`` sums, without an audit
    edits: bool = True  # False: only the decision takes effect
    operators: dict[str, Operator] | None = None
    handlers: dict[str, Handler] | None = None


def apply_rules(df: DataFrame, rules: list[Rule], options: Options = Options(), *, drop: bool = True) -> DataFrame:
    """Apply a rule set.

    With ``drop`` the result holds the kept rows only, otherwise all rows and their
    decision in ``rule_keep``. ``rule_audit`` and ``rule_errors`` appear with ``audit``.
    """
    columns = df.columns
    todo = in_order(rules)
    entry = Entry.of(df, options.fields, options.shadow)
    if entry.shadow:
        # parsed logs: their columns are costly, and a filter on a shadowed column cannot reach a scan anyway
        df = settle(df)
    if drop and not options.audit and not options.counters:
        df, todo = _leading_drops(df, todo, entry, options)
        if not todo:
            return df
    before = df
    init = {KEEP: F.lit(True), _DONE: F.lit(False)}
    if options.audit:
        init |= {AUDIT: F.array().cast(T.ArrayType(AUDIT_ENTRY)), ERRORS: F.lit(0)}
    if options.counters:
        init |= {c: F.lit(0) for c in COUNTERS}
    if not options.edits:
        # the edits go to copies, the originals come back at the end
        copies = {f"_before_{c}": F.col(c) for c in columns}
        df = df.withColumns(copies)
    df = df.withColumns(init)
    for group in _groups(todo, entry, options):
        df = _run(df, group, entry, options)
    out = [F.col(c) if options.edits else F.col(f"_before_{c}").alias(c) for c in before.columns]
    extra = ([] if drop else [KEEP]) + ([AUDIT, ERRORS] if options.audit else []) + ([*COUNTERS, ENDED] if options.counters else [])
    if options.counters:
        df = df.withColumn(ENDED, F.col(_DONE))
    return (df.filter(KEEP) if drop else df).select(*out, *extra)


def _leading_drops(df, rules, entry, options):
    """Drop-only rules at the head are plain filters, which Catalyst can push to the scan."""
    rest = list(rules)
    while rest and rest[0].actions and rest[0].actions[0].type == "drop":
        match = compile_condition(rest[0].condition, entry, options.operators)
        if match.faulty:
            break
        df = df.filter(~match.column)
        rest.pop(0)
    return df, rest


def _reads(rule: Rule, entry: Entry) -> set[str]:
    return {entry.place(leaf.field).token for leaf in rule.condition.leaves()}


def _stages(rule: Rule, entry: Entry) -> list[list[int]]:
    """Positions of the actions that run, grouped so that no action touches what its group wrote."""
    stages: list[list[int]] = [[]]
    seen: set[str] = set()
    for i, action in enumerate(rule.actions):
        if touched(entry, action) & seen:
            stages.append([])
            seen = set()
        stages[-1].append(i)
        seen |= written(entry, action)
        if action.type in ("keep", "drop"):
            break
    return stages


def _groups(rules: list[Rule], entry: Entry, options: Options) -> list[list[Rule]]:
    groups: list[list[Rule]] = []
    seen: set[str] = set()
    closed = True
    for rule in rules:
        uses = _reads(rule, entry).union(*[touched(entry, a) for a in rule.actions])
        custom = any(a.type in (options.handlers or {}) for a in rule.actions)
        if closed or custom or uses & seen:
            groups.append([])
            seen = set()
        groups[-1].append(rule)
        seen = seen.union(*[written(entry, a) for a in rule.actions])
        closed = custom or len(_stages(rule, entry)) > 1 or (options.compat and rule.terminates)
    return groups


def _decides_only(rules: list[Rule], options: Options) -> bool:
    custom = options.handlers or {}
    return not options.audit and not options.counters and not options.compat and all(
        a.type in ("keep", "drop", "sample") and a.type not in custom for r in rules for a in r.actions
    )


def _decide(df: DataFrame, rules: list[Rule], entry: Entry, options: Options) -> DataFrame:
    """keep / drop / sample only: the first terminating match decides, else the last match does."""
    first = F.when(F.col(_DONE), F.col(KEEP))
    ends = F.col(_DONE)
    rest = None
    for rule in rules:
        match = compile_condition(rule.condition, entry, options.operators)
        hit = F.coalesce(match.column, F.lit(False)) if match.faulty else match.column
        keep = F.lit(True)
        for j, action in enumerate(rule.actions):
            effect = compile_action(_context(df, entry, rule, j, options), action)
            keep = effect.keep
            if action.type in ("keep", "drop"):
                break
        if rule.terminates:
            first = first.when(hit, keep)
            ends = ends | hit
        elif rule.actions:
            rest = [(hit, keep)] + (rest or [])
    other = F.col(KEEP)
    if rest:
        other = F.when(*rest[0])
        for hit, keep in rest[1:]:
            other = other.when(hit, keep)
        other = other.otherwise(F.col(KEEP))
    return df.withColumns({KEEP: first.otherwise(other), _DONE: ends})


def _context(df: DataFrame, entry: Entry, rule: Rule, position: int, options: Options) -> Context:
    key = F.col(options.key) if options.key in df.columns else F.lit(0)
    return Context(entry, rule, position, key, options.seed)


def _run(df: DataFrame, rules: list[Rule], entry: Entry, options: Options) -> DataFrame:
    if _decides_only(rules, options):
        return _decide(df, rules, entry, options)
    matches = [compile_condition(r.condition, entry, options.operators) for r in rules]
    df = compute_once(df, {f"_m{i}": m.column for i, m in enumerate(matches)})

    def hit(i: int) -> Column:
        return F.coalesce(F.col(f"_m{i}"), F.lit(False)) if matches[i].faulty else F.col(f"_m{i}")

    # position of the rule that ends the evaluation of this row
    stop = F.when(F.col(_DONE), F.lit(-1))
    for i, rule in enumerate(rules):
        if rule.terminates:
            stop = stop.when(hit(i), F.lit(i))
    df = df.withColumn(_STOP, stop.otherwise(F.lit(_NEVER)))

    def active(i: int) -> Column:
        return hit(i) & (F.col(_STOP) >= i)

    stages = [_stages(r, entry) for r in rules]
    kept: dict[tuple[int, int], Effect] = {}
    for depth in range(max(len(s) for s in stages)):
        writes, flags = [], {}
        for i, rule in enumerate(rules):
            for j in stages[i][depth] if depth < len(stages[i]) else []:
                effect = compile_action(_context(df, entry, rule, j, options), rule.actions[j], options.handlers)
                ok = None
                if effect.ok is not None:
                    flags[f"_ok{i}_{j}"] = F.coalesce(effect.ok, F.lit(False))
                    ok = effect.ok
                if effect.keep is not None and rule.actions[j].type not in ("keep", "drop"):
                    flags[f"_keep{i}_{j}"] = effect.keep
                if options.audit and effect.metadata:
                    flags[f"_meta{i}_{j}"] = F.to_json(F.struct(*[c.alias(k) for k, c in effect.metadata.items()]))
                kept[i, j] = effect
                for guard, write in effect.writes:
                    applies = active(i)
                    for extra in (guard, ok):
                        applies = applies if extra is None else applies & extra
                    writes.append((applies, write))
        changes = entry.apply(writes)
        if changes or flags:
            df = compute_once(df, {**flags, **changes})

    def decision(i: int) -> Column:
        """keep of the last action that succeeded"""
        out = F.lit(True)
        for j in [j for stage in stages[i] for j in stage]:
            effect, action = kept[i, j], rules[i].actions[j]
            keep = F.lit(True)
            if action.type in ("keep", "drop"):
                keep = F.lit(action.type == "keep")
            elif effect.keep is not None:
                keep = F.col(f"_keep{i}_{j}")
            out = keep if effect.ok is None else F.when(F.col(f"_ok{i}_{j}"), keep).otherwise(out)
        return out

    def failed(i: int) -> Column:
        uncertain = [j for stage in stages[i] for j in stage if kept[i, j].ok is not None]
        return sum((F.when(F.col(f"_ok{i}_{j}"), 0).otherwise(1) for j in uncertain), F.lit(0))

    keep = None
    for i in reversed(range(len(rules))):
        if rules[i].actions:
            mine = decision(i)
            if options.compat and rules[i].terminates:
                # compat groups end at a terminating rule, so what precedes it is this group's earlier rules
                earlier = None
                for k in reversed(range(i)):
                    if rules[k].actions:
                        earlier = F.when(active(k), decision(k)) if earlier is None else earlier.when(active(k), decision(k))
                mine = (F.col(KEEP) if earlier is None else earlier.otherwise(F.col(KEEP))) == mine
            keep = F.when(active(i), mine) if keep is None else keep.when(active(i), mine)
    final = {_DONE: F.col(_STOP) < _NEVER}
    if keep is not None:
        final[KEEP] = keep.otherwise(F.col(KEEP))
    if options.audit:
        final[AUDIT] = F.concat(F.col(AUDIT), F.array_compact(F.array(*[_audit_row(i, r, stages[i], kept, active(i), decision(i)) for i, r in enumerate(rules)])))
        errors = F.lit(0)
        for i, m in enumerate(matches):
            if m.faulty:
                errors = errors + F.when(F.col(f"_m{i}").isNull() & (F.col(_STOP) >= i), 1).otherwise(0)
        final[ERRORS] = F.col(ERRORS) + errors
    if options.counters:
        for name, weight in zip(COUNTERS, (lambda i: F.lit(1), lambda i: F.lit(len(rules[i].actions)), failed), strict=True):
            final[name] = sum((F.when(active(i), weight(i)).otherwise(0) for i in range(len(rules))), F.col(name))
    df = df.withColumns(final)
    scratch = [c for c in df.columns if c == _STOP or c.startswith(("_m", "_ok", "_keep", "_meta")) and c[-1].isdigit()]
    return df.drop(*scratch)


def _audit_row(i: int, rule: Rule, stages, effects, active: Column, decision: Column) -> Column:
    actions = []
    for j in [j for stage in stages for j in stage]:
        effect, action = effects[i, j], rule.actions[j]
        ok = F.lit(True) if effect.ok is None else F.col(f"_ok{i}_{j}")
        meta = F.col(f"_meta{i}_{j}") if effect.metadata else F.lit(None).cast("string")
        actions.append(
            F.struct(
                F.lit(action.type).alias("type"),
                ok.alias("success"),
                F.when(~ok, F.lit(effect.error)).alias("error"),
                F.when(ok, meta).alias("metadata"),
            )
        )
    row = F.struct(
        F.lit(rule.id).alias("rule_id"),
        F.lit(rule.name).alias("rule_name"),
        F.lit(True).alias("matched"),
        decision.alias("should_keep"),
        F.lit(rule.terminates).alias("terminate"),
        F.array(*actions).cast(AUDIT_ENTRY["actions"].dataType).alias("actions"),
        F.lit(len(rule.actions)).alias("planned"),
    )
    return F.when(active, row.cast(AUDIT_ENTRY))


def evaluate_single(df: DataFrame, rule: Rule, options: Options = Options()) -> DataFrame:
    """One rule on its own: ``matched``, ``rule_keep`` and the edits. A disabled rule matches nothing."""
    if not rule.enabled:
        return df.withColumns({"matched": F.lit(False), KEEP: F.lit(True)})
    entry = Entry.of(df, options.fields, options.shadow)
    match = compile_condition(rule.condition, entry, options.operators)
    return apply_rules(df.withColumn("matched", F.coalesce(match.column, F.lit(False))), [rule], options, drop=False)


def audit_rows(audited: DataFrame, *keys: str) -> DataFrame:
    """One row per matched rule and row of the table."""
    return audited.select(*keys, F.posexplode(AUDIT).alias("position", "entry")).select(*keys, "position", "entry.*")


def rule_stats(ruled: DataFrame) -> DataFrame:
    """Engine counters of rows ruled with ``counters``: one evaluation per match, and one more for each row that no rule terminated."""
    matched, actions, failures = (F.col(c) for c in COUNTERS)
    ended = F.col(ENDED)
    return ruled.agg(
        F.coalesce(F.sum(matched + F.when(ended, 0).otherwise(1)), F.lit(0)).alias("total_evaluations"),
        F.coalesce(F.sum(matched), F.lit(0)).alias("matched_evaluations"),
        F.coalesce(F.sum(actions), F.lit(0)).alias("actions_executed"),
        F.coalesce(F.sum(failures), F.lit(0)).alias("failed_actions"),
    )


def dry_run(df: DataFrame, rules: list[Rule], options: Options = Options()) -> DataFrame:
    """Rows each rule matches on its own, and how many of them it would drop. Nothing is changed."""
    entry = Entry.of(df, options.fields, options.shadow)
    aggs = []
    for i, rule in enumerate(sorted(rules, key=lambda r: r.order)):
        match = F.coalesce(compile_condition(rule.condition, entry, options.operators).column, F.lit(False))
        ends = next((a.type for a in rule.actions if a.type in ("keep", "drop")), "")
        aggs.append(
            F.struct(
                F.lit(rule.id).alias("rule_id"),
                F.lit(rule.enabled).alias("enabled"),
                F.count_if(match).alias("matched"),
                (F.count_if(match) if ends == "drop" and rule.enabled else F.lit(0).cast("bigint")).alias("would_drop"),
                F.count(F.lit(1)).alias("tested"),
            ).alias(f"r{i}")
        )
    # one pass, one partial aggregate row per task
    counted = df.agg(*aggs)
    return counted.select(F.inline(F.array(*[F.col(f"r{i}") for i in range(len(aggs))])))


def scoped(rules: list[Rule], *, environment: str | None = "environment") -> list[Rule]:
    """Rules stored per client, each bound to its client's rows.

    A scope is ``clients/{service}.{environment}/{component}`` or ``defaults/{component}``; clients sort
    before defaults. Without an environment column the service alone selects the rows.
    """
    out = []
    for rule in rules:
        parts = rule.scope.strip("/").split("/")
        if len(parts) >= 2 and parts[0] == "clients":
            service, _, env = parts[1].rpartition(".")
            guards = [Condition("service", "eq", service)]
            if environment:
                guards.append(Condition(environment, "eq", env))
            rule = rule.with_condition(Condition(all=(*guards, rule.condition)))
        out.append(rule)
    return out


def sdk_decision(df: DataFrame, rules: list[Rule], options: Options = Options()) -> DataFrame:
    """``should_log`` and the sampling rate a rule left in ``_marks.sampling_rate``."""
    ruled = apply_rules(df, rules, options, drop=False)
    marks = Entry.of(ruled, options.fields).value("_marks.sampling_rate").raw
    rate = F.when(F.schema_of_variant(marks) != "STRING", F.try_variant_get(marks, "$", "double"))
    return ruled.withColumnRenamed(KEEP, "should_log").withColumn("sampling", F.coalesce(rate, F.lit(1.0)))
