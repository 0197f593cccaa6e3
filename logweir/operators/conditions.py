"""Condition trees as boolean Columns.

A missing field makes its leaf false, so ``not`` around it is true. A leaf that
is in error (bad pattern, unknown operator, ``in`` without a list) is NULL on
rows that have the field; ``all`` and ``any`` around such a leaf are evaluated
left to right, and everywhere else they stay plain AND / OR so that filters
reach the scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.fields import Entry
from logweir.functions.regex import InvalidPattern, java_pattern
from logweir.functions.values import Value, literal_number
from logweir.operators.model import Condition

# A custom operator takes the field and the rule's value and returns a boolean Column.
Operator = Callable[[Value, object], Column]


class Faulty(ValueError):
    """The leaf is in error wherever its field exists."""


@dataclass(frozen=True)
class Match:
    column: Column
    faulty: bool = False  # may be NULL


ALIASES = {"neq": "ne"}


def _text_operator(method: str) -> Operator:
    def evaluate(value: Value, expected) -> Column:
        if not isinstance(expected, str):
            return F.lit(False)
        return getattr(value.text, method)(expected)

    return evaluate


def _matches(value: Value, expected) -> Column:
    if not isinstance(expected, str):
        raise Faulty("matches takes a text pattern")
    try:
        return value.text.rlike(java_pattern(expected))
    except InvalidPattern as err:
        raise Faulty(str(err)) from None


def _in(value: Value, expected) -> Column:
    if not isinstance(expected, (list, tuple)):
        raise Faulty("in takes a list")
    if not expected:
        return F.lit(False)
    if value.numeric == "always" and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in expected) and not value.floating:
        return value.raw.isin([int(x) if x == int(x) else x for x in expected])
    return reduce(lambda a, b: a | b, [value.compare("eq", x) for x in expected])


BUILT_IN: dict[str, Operator] = {
    **{op: (lambda value, expected, op=op: value.compare(op, expected)) for op in ("eq", "ne", "gt", "lt", "ge", "le")},
    "contains": _text_operator("contains"),
    "starts_with": _text_operator("startswith"),
    "ends_with": _text_operator("endswith"),
    "matches": _matches,
    "in": _in,
    "not_in": lambda value, expected: ~_in(value, expected),
}


def compile_condition(cond: Condition, entry: Entry, operators: dict[str, Operator] | None = None) -> Match:
    if cond.all:
        return _all([compile_condition(c, entry, operators) for c in cond.all])
    if cond.any:
        return _any([compile_condition(c, entry, operators) for c in cond.any])
    if cond.negated is not None:
        inner = compile_condition(cond.negated, entry, operators)
        return Match(~inner.column, inner.faulty)
    return _leaf(cond, entry, operators)


def _leaf(cond: Condition, entry: Entry, operators: dict[str, Operator] | None) -> Match:
    value = entry.value(cond.field)
    if cond.operator == "exists":
        return Match(value.present)
    if cond.operator == "not_exists":
        return Match(~value.present)
    name = ALIASES.get(cond.operator, cond.operator)
    operator = {**BUILT_IN, **(operators or {})}.get(name)
    try:
        if operator is None:
            raise Faulty(f"unknown operator: {cond.operator}")
        result = operator(value, cond.value)
        # these compare without looking at the value, so they don't tell a missing field by themselves
        if name == "not_in" or name in BUILT_IN and any(x is None or math.isnan(literal_number(x) or 0.0) for x in (cond.value if isinstance(cond.value, (list, tuple)) else [cond.value])):
            result = value.present & result
        return Match(F.coalesce(result, F.lit(False)) if name != "not_in" else result)
    except Faulty:
        return Match(F.when(value.present, F.lit(None).cast("boolean")).otherwise(F.lit(False)), faulty=True)


def _all(parts: list[Match]) -> Match:
    if not any(p.faulty for p in parts):
        return Match(reduce(lambda a, b: a & b, [p.column for p in parts]))
    steps = F.when(F.lit(False), F.lit(False))
    for p in parts:
        if p.faulty:
            steps = steps.when(p.column.isNull(), F.lit(None).cast("boolean"))
        steps = steps.when(~p.column, F.lit(False))
    return Match(steps.otherwise(F.lit(True)), faulty=True)


def _any(parts: list[Match]) -> Match:
    if not any(p.faulty for p in parts):
        return Match(reduce(lambda a, b: a | b, [p.column for p in parts]))
    steps = F.when(F.lit(False), F.lit(False))
    for p in parts:
        if p.faulty:
            steps = steps.when(p.column.isNull(), F.lit(None).cast("boolean"))
        steps = steps.when(p.column, F.lit(True))
    return Match(steps.otherwise(F.lit(False)), faulty=True)


def filter_where(
    df: DataFrame, condition: Condition | dict, *, fields: str | None = "fields", shadow: bool = False, operators=None
) -> DataFrame:
    """Rows that match a condition tree; a row on which the condition is in error does not."""
    cond = condition if isinstance(condition, Condition) else Condition.parse(condition)
    return df.filter(compile_condition(cond, Entry.of(df, fields, shadow), operators).column)
