"""Column expressions over feature vectors (``ARRAY<DOUBLE>``) and windows (``ARRAY<ARRAY<DOUBLE>>``).

Expressions full of fitted numbers are written as SQL text: one call builds them, where
column by column they would cost a round trip to the JVM per number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this many features, moments are written out as one aggregate per pair of features.
UNROLL_LIMIT = 8
# Up to this many features, per-window work is done by higher-order functions.  Those are
# interpreted per element: with four features Arrow batches took a third to a fifth of the time.
JVM_WIDTH = 1


def number(value: float) -> str:
    """A double literal that reads back as exactly the same value."""
    value = float(value)
    if value != value or value in (float("inf"), float("-inf")):
        return f"double('{value}')"
    return f"{value!r}D"


def numbers(values: Sequence[float]) -> str:
    return f"array({', '.join(map(number, values))})"


def vector_literal(rows: Sequence[Sequence[float]]) -> Column:
    return F.expr(f"array({', '.join(map(numbers, rows))})")


def rescaled(value: str, low: str, high: str) -> str:
    """(value - low) / (high - low); a constant feature maps to 0."""
    return f"coalesce(try_divide({value} - {low}, {high} - {low}), 0D)"


def quadratic_score(e: str, mu: Sequence[float], weight: Sequence[Sequence[float]]) -> str:
    """sqrt((e-mu)' W (e-mu)) with the symmetric matrix W written out as literals."""
    d = len(mu)
    c = [f"({e}[{i}] - {number(mu[i])})" for i in range(d)]
    terms = []
    for i in range(d):
        for j in range(i, d):
            factor = float(weight[i][j]) if i == j else float(weight[i][j]) + float(weight[j][i])
            terms.append(f"{c[i]} * {c[j]} * {number(factor)}")
    return f"sqrt(greatest({' + '.join(terms)}, 0D))"
