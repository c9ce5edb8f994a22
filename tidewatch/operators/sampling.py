"""Orders in which windows are fed to fitting and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.index import index_and_count


def shuffle_batches(windows: DataFrame, per_batch: int, seed: int = 0) -> DataFrame:
    """Seeded random order of the windows in full batches; the remainder is left out."""
    ranked, n = index_and_count(windows, [F.xxhash64(F.col("w"), F.lit(seed)), "w"], "rank")
    return _full_batches(ranked, F.col("rank"), per_batch, n)


def reverse_batches(windows: DataFrame, per_batch: int, full_only: bool = True) -> DataFrame:
    """Batches taken from the last window backwards; the remainder at the front is left out."""
    ranked, n = index_and_count(windows, ["w"], "rank")
    return _full_batches(ranked, F.lit(n - 1) - F.col("rank"), per_batch, n, full_only)


def arrival_batches(windows: DataFrame, per_batch: int, full_only: bool = True) -> DataFrame:
    """Batches in stream order; the remainder at the end is left out."""
    ranked, n = index_and_count(windows, ["w"], "rank")
    return _full_batches(ranked, F.col("rank"), per_batch, n, full_only)


def _full_batches(ranked: DataFrame, place, per_batch: int, n: int, full_only: bool = True) -> DataFrame:
    batches = (
        ranked.withColumn("_place", place)
        .withColumns({"batch": F.expr(f"_place div {int(per_batch)}"), "pos": (F.col("_place") % per_batch).cast("int")})
        .drop("_place", "rank")
    )
    return batches.filter(F.col("batch") < n // per_batch) if full_only else batches
