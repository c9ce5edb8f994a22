"""The six subsets used for fitting, calibration and tests.

Subsets are runs of windows in stream order, so each one is an interval of window numbers
within its class.  The interval ends are found from counts; marking a window is then a
comparison with literals, which needs no rank column, no shuffle of windows, and reaches
the Parquet scan as a filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordering import order_statistics

# fixed values: parts out of ten of the normal windows given to sn, vn1 and vn2; tn gets the rest
NORMAL_PARTS = (("sn", 5), ("vn1", 3), ("vn2", 1))
SUBSETS = ("sn", "vn1", "vn2", "tn", "va", "ta")


@dataclass(frozen=True)
class Split:
    """Interval ``[first, end)`` of window numbers per subset, and its number of windows."""

    bounds: dict[str, tuple[int, int]]
    sizes: dict[str, int]

    def where(self, subset: str) -> Column:
        first, end = self.bounds[subset]
        kind = F.col("is_anomaly") if subset in ("va", "ta") else ~F.col("is_anomaly")
        return kind & (F.col("w") >= first) & (F.col("w") < end)

    def column(self) -> Column:
        """``subsets ARRAY<STRING>``: both va and ta if there are fewer than two anomalous windows."""
        marks = F.array(*[F.when(self.where(s), F.lit(s)) for s in SUBSETS])
        return F.filter(marks, lambda s: s.isNotNull())


def fit_split(windows: DataFrame) -> Split:
    """Find where the subsets begin and end, reading only ``w`` and ``is_anomaly``."""
    runs: dict[bool, list[tuple[str, int]]] = {}

    def starts(anomalous: bool, n: int) -> list[int]:
        if anomalous:
            half = n // 2
            runs[anomalous] = [("va", 0), ("ta", half)]
        else:
            tenth, taken, runs[anomalous] = n // 10, 0, []
            for name, parts in NORMAL_PARTS:
                runs[anomalous].append((name, taken))
                taken += parts * tenth
            runs[anomalous].append(("tn", taken))
        return [rank for _, rank in runs[anomalous] if rank < n]

    at, limits = order_statistics(windows.select("w", "is_anomaly"), "w", "is_anomaly", starts)
    bounds, sizes = {s: (0, 0) for s in SUBSETS}, {s: 0 for s in SUBSETS}
    for kind, (n, _, last) in limits.items():
        ends = [rank for _, rank in runs[kind]][1:] + [n]
        for (name, rank), end in zip(runs[kind], ends):
            bounds[name] = (int(at.get((kind, rank), last + 1)), int(at.get((kind, end), last + 1)))
            sizes[name] = end - rank
        if kind and n < 2:
            bounds["va"], sizes["va"] = bounds["ta"], sizes["ta"]
    return Split(bounds, sizes)


def split_subsets(windows: DataFrame, split: Split | None = None) -> DataFrame:
    """Add ``subsets`` to every window."""
    split = split or fit_split(windows)
    return windows.withColumn("subsets", split.column())


def split_report(windows: DataFrame, length: int) -> DataFrame:
    """Windows and rows per subset, from a window table that has ``subsets``."""
    return (
        windows.select(F.explode("subsets").alias("subset"))
        .groupBy("subset")
        .agg(F.count(F.lit(1)).alias("windows"))
        .withColumn("rows", F.col("windows") * length)
    )


def align_row_labels(windows: DataFrame, split: Split, subset: str = "va") -> DataFrame:
    """Row labels of the windows of one subset, in window and step order columns."""
    return windows.filter(split.where(subset)).select("w", F.posexplode("flags").alias("step", "is_anomaly"))
