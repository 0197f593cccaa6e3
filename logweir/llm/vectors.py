"""Vectors as binary columns, and cosines in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not all zero."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(vectors: list) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    return np.array(vectors, np.float64).reshape(len(vectors), -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one. The largest component goes first, so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``. It depends on those two rows alone, to the last bit."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
