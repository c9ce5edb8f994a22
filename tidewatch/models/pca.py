"""Reconstruction by a linear autoencoder over flattened windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.models.base import flat, window_width
from tidewatch.operators.errors import moments

# Cells of a window: the covariance of that many squared is held on the driver.
MOST_CELLS = 4096


@dataclass(frozen=True)
class Linear:
    """mean + (x - mean) P P' with the first ``hidden`` principal components P.

    Mean and covariance of all cells come from one pass over the windows.
    """

    length: int
    width: int
    hidden: int
    mean: np.ndarray
    components: np.ndarray
    kind: str = "pca"

    @classmethod
    def fit(cls, windows: DataFrame, hidden: int, shape: tuple[int, int] | None = None, **_) -> "Linear":
        length, width = shape or window_width(windows)
        cells = length * width
        if not hidden <= cells <= MOST_CELLS:
            raise ValueError(f"windows of {cells} cells: {hidden} to {MOST_CELLS} are possible")
        mean, covariance = moments(windows.select(F.flatten("xs").alias("e")), cells)
        # in order of rising variance
        components = np.linalg.eigh(covariance)[1][:, ::-1][:, :hidden]
        return cls(length, width, hidden, mean, components)

    def refit(self, buffer: DataFrame, per_batch: int, **_) -> "Linear":
        return Linear.fit(buffer, self.hidden, (self.length, self.width))

    def expression(self) -> None:
        return None

    def kernel(self):
        mean, components = self.mean, self.components

        def apply(x: np.ndarray) -> np.ndarray:
            centred = x.reshape(len(x), -1) - mean
            return (mean + centred @ components @ components.T).reshape(x.shape)

        return apply

    def parameters(self) -> list[float]:
        return np.concatenate([self.mean, self.components.ravel()]).tolist()

    @classmethod
    def restore(cls, length: int, width: int, hidden: int, numbers: list[float]) -> "Linear":
        cells = length * width
        numbers = flat(numbers)
        return cls(length, width, hidden, numbers[:cells], numbers[cells:].reshape(cells, hidden))
