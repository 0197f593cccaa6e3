"""Projection steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose results are never inlined into later steps.

    Catalyst pushes a filter through projections by substituting their expressions; over a chain of edits
    that multiplies the expression at every step. A one-row generator stops the substitution, while
    filters on untouched columns still pass.
    """
    names = list(dict.fromkeys([*df.columns, *columns]))
    row = F.struct(*[c.alias(f"{name}") for name, c in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.inline(F.array(row))).select(*[F.col(f"`{n}`") for n in names])


def settle(df: DataFrame, *columns: str) -> DataFrame:
    """Fix the given columns (all by default) at this point of the plan.

    Use it between a step that computes costly columns and one that reads them many times.
    """
    return compute_once(df, {c: F.col(c) for c in columns or df.columns})
