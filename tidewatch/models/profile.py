"""Reconstruction by the mean normal window."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.arrow import tensor
from tidewatch.functions.vectors import vector_literal
from tidewatch.models.base import flat, window_width


@dataclass(frozen=True)
class Profile:
    """Every window is reconstructed as the per-(step, feature) mean of the fitted windows."""

    length: int
    width: int
    mean: tuple[float, ...]
    kind: str = "profile"

    @classmethod
    def fit(cls, windows: DataFrame, shape: tuple[int, int] | None = None, **_) -> "Profile":
        length, width = shape or window_width(windows)
        # length * width rows at most reach the driver
        cells = cell_means(windows, (length, width)).collect()
        mean = np.zeros(length * width)
        for r in cells:
            mean[r["step"] * width + r["dim"]] = r["mean"]
        return cls(length, width, tuple(mean.tolist()))

    def refit(self, buffer: DataFrame, per_batch: int, **_) -> "Profile":
        return Profile.fit(buffer, (self.length, self.width))

    def refit_arrays(self, train: np.ndarray, per_batch: int, **_) -> "Profile":
        return Profile(self.length, self.width, tuple(train.mean(axis=0).ravel().tolist()))

    def rows(self) -> list[list[float]]:
        return flat(self.mean).reshape(self.length, self.width).tolist()

    def expression(self) -> Column:
        return vector_literal(self.rows())

    def kernel(self):
        mean = flat(self.mean).reshape(1, self.length, self.width)
        return lambda x: np.broadcast_to(mean, x.shape)

    def parameters(self) -> list[float]:
        return list(self.mean)

    @classmethod
    def restore(cls, length: int, width: int, hidden: int, numbers: list[float]) -> "Profile":
        return cls(length, width, tuple(numbers))


def cell_means(windows: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean per (step, dim).  Every task sums its windows and sends one row per cell."""
    length, width = shape or window_width(windows)
    step, dim = (i.ravel().astype(np.int32) for i in np.indices((length, width)))

    def sums(batches):
        total, n = np.zeros((length, width)), 0
        for batch in batches:
            if batch.num_rows:
                x = tensor(batch.column(0), length, width)
                total += x.sum(axis=0)
                n += len(x)
        if n:
            columns = [pa.array(step), pa.array(dim), pa.array(total.ravel()), pa.array(np.full(len(step), n, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["step", "dim", "s", "n"])

    parts = windows.select("xs").mapInArrow(sums, "step int, dim int, s double, n long")
    return parts.groupBy("step", "dim").agg((F.sum("s") / F.sum("n")).alias("mean"))
