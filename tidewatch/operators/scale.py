"""Min-max scaling over a whole series or inside every window."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.arrow import MATRIX_TYPE, map_windows, minmax_tensor, nested_column, tensor
from tidewatch.functions.vectors import JVM_WIDTH, number, rescaled


def bounds_of(width: int, vector: str = "x") -> list[Column]:
    """Aggregates ``lo0..`` and ``hi0..``: smallest and largest value per feature."""
    return [F.expr(f"min(get({vector}, {i})) AS lo{i}") for i in range(width)] + [
        F.expr(f"max(get({vector}, {i})) AS hi{i}") for i in range(width)
    ]


def fit_minmax(df: DataFrame, width: int, vector: str = "x") -> tuple[list[float], list[float]]:
    """Smallest and largest value per feature, in one aggregate without exploding rows."""
    row = list(df.agg(*bounds_of(width, vector)).first())
    return row[:width], row[width:]


def minmax_expr(vector: str, low: list[float], high: list[float]) -> Column:
    """``vector`` scaled by given bounds."""
    cells = (rescaled(f"{vector}[{i}]", number(lo), number(hi)) for i, (lo, hi) in enumerate(zip(low, high)))
    return F.expr(f"array({', '.join(cells)})")


def minmax_global(df: DataFrame, width: int, vector: str = "x", bounds=None) -> DataFrame:
    """Scale by the bounds of the whole series (or by given ``(low, high)``)."""
    low, high = bounds or fit_minmax(df, width, vector)
    return df.withColumn(vector, minmax_expr(vector, low, high))


def minmax_window(windows: DataFrame, width: int, vector: str = "xs") -> DataFrame:
    """Scale every window by its own bounds.  Narrow: the window row holds all it needs."""
    if width > JVM_WIDTH:

        def compute(xs: pa.Array):
            length = len(xs.flatten()) // len(xs)
            return {vector: nested_column(minmax_tensor(tensor(xs, length, width)))}

        return map_windows(windows, vector, {vector: MATRIX_TYPE}, compute)

    def per_feature(pick: str) -> Column:
        return F.expr(f"array({', '.join(f'{pick}(transform({vector}, r -> r[{j}]))' for j in range(width))})")

    bounded = windows.withColumns({"_lo": per_feature("array_min"), "_hi": per_feature("array_max")})
    cells = ", ".join(rescaled(f"r[{j}]", f"_lo[{j}]", f"_hi[{j}]") for j in range(width))
    return bounded.withColumn(vector, F.expr(f"transform({vector}, r -> array({cells}))")).drop("_lo", "_hi")
