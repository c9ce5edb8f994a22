"""What a reconstruction model offers, and how it is applied to a window table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.arrow import (
    MATRIX_TYPE, VECTOR_TYPE, list_column, map_windows, minmax_tensor, nested_column, quadratic_scores, tensor,
)
from tidewatch.functions.vectors import JVM_WIDTH
from tidewatch.operators import errors, scale
from tidewatch.operators.errors import ErrorModel


class Reconstructor(Protocol):
    """A fitted model.  Its parameters are model-sized and travel with the job."""

    kind: str
    length: int
    width: int

    def expression(self) -> Column | None:
        """The reconstruction as a column, if it can be written as one."""

    def kernel(self) -> Callable[[np.ndarray], np.ndarray]:
        """Function from windows (n, length, width) to reconstructed windows."""

    def parameters(self) -> list[float]:
        """All fitted numbers as one flat list."""

    def refit(self, buffer: DataFrame, per_batch: int, **options) -> "Reconstructor":
        """Continue training on buffered windows."""


@dataclass(frozen=True)
class Model:
    """A reconstructor with its error model: everything needed to score windows."""

    reconstructor: Reconstructor
    errors: ErrorModel
    version: int = 0
    bounds: tuple[list[float], list[float]] | None = None
    history: list[tuple[int, float, float | None, float | None]] = field(default_factory=list)

    @property
    def threshold(self) -> float | None:
        return self.errors.threshold


def stays_in_jvm(model: Reconstructor) -> bool:
    return model.width <= JVM_WIDTH and model.expression() is not None


def reconstruct(windows: DataFrame, model: Reconstructor) -> DataFrame:
    """``xhat``: the reconstruction of every window.  Narrow."""
    if stays_in_jvm(model):
        return windows.withColumn("xhat", model.expression())
    kernel, length, width = model.kernel(), model.length, model.width

    def compute(xs: pa.Array):
        return {"xhat": nested_column(kernel(tensor(xs, length, width)))}

    return map_windows(windows, "xs", {"xhat": MATRIX_TYPE}, compute)


def reconstruction_errors(windows: DataFrame, model: Reconstructor) -> DataFrame:
    """``errs`` of every window, without keeping the reconstruction."""
    if stays_in_jvm(model):
        return errors.abs_error(reconstruct(windows, model)).drop("xhat")
    kernel, length, width = model.kernel(), model.length, model.width

    def compute(xs: pa.Array):
        x = tensor(xs, length, width)
        return {"errs": nested_column(np.abs(x - kernel(x)))}

    return map_windows(windows, "xs", {"errs": MATRIX_TYPE}, compute)


def score(
    windows: DataFrame, model: Model, metric: str = "cov", scale_window: bool = False, keep_errors: bool = False
) -> DataFrame:
    """``scores`` per step: scale (optionally), reconstruct, compare and score in one narrow pass."""
    rec = model.reconstructor
    if stays_in_jvm(rec):
        scaled = scale.minmax_window(windows, rec.width) if scale_window else windows
        scored = errors.score_points(reconstruction_errors(scaled, rec), model.errors, metric)
        return scored if keep_errors else scored.drop("errs")
    kernel, length, width = rec.kernel(), rec.length, rec.width
    mu, weight = np.array(model.errors.mu), np.array(model.errors.weight(metric))

    def compute(xs: pa.Array):
        x = tensor(xs, length, width)
        out = {}
        if scale_window:
            x = minmax_tensor(x)
            out["xs"] = nested_column(x)
        errs = np.abs(x - kernel(x))
        out["scores"] = list_column(quadratic_scores(errs, mu, weight))
        if keep_errors:
            out["errs"] = nested_column(errs)
        return out

    new = {"xs": MATRIX_TYPE} if scale_window else {}
    new["scores"] = VECTOR_TYPE
    if keep_errors:
        new["errs"] = MATRIX_TYPE
    return map_windows(windows, "xs", new, compute)


def flat(values) -> np.ndarray:
    return np.asarray(values, dtype=np.float64)


def window_width(windows: DataFrame) -> tuple[int, int]:
    """Length and number of features, read from one window."""
    row = windows.select(F.size("xs").alias("l"), F.size(F.col("xs")[0]).alias("d")).first()
    if row is None:
        raise ValueError("there are no windows to fit on")
    return row["l"], row["d"]
