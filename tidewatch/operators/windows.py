"""Count windows, batches of windows, and window labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scratch import save
from tidewatch.operators.index import broadcast_if_small, trim_to_multiple


def assign_windows(df: DataFrame, length: int, n: int | str | None = None) -> DataFrame:
    """Window number ``w`` and ``step`` in it for every row of a full window."""
    return trim_to_multiple(df, length, n).withColumns(
        {"w": F.expr(f"idx div {int(length)}"), "step": (F.col("idx") % length).cast("int")}
    )


def assign_batches(df: DataFrame, per_batch: int, w: str = "w") -> DataFrame:
    """Batch of ``per_batch`` consecutive windows, and the position in the batch."""
    return df.withColumns(
        {"batch": F.expr(f"{w} div {int(per_batch)}"), "pos": (F.col(w) % per_batch).cast("int")}
    )


def collect_windows(df: DataFrame, length: int, by: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """One row per full window: ``xs`` (vectors in step order), ``flags`` (row labels), ``is_anomaly``.

    A window never has more than ``length`` rows, and windows have equal size, so the
    shuffle on the window number is even however rows spread over streams.  ``ordered`` makes
    that one shuffle by range: a table written from it is read by window interval without
    touching other files.
    """
    if ordered:
        df = df.repartitionByRange(*by, "w")
    return (
        df.groupBy(*by, "w")
        .agg(
            F.array_sort(F.collect_list(F.struct("step", "x", "is_anomaly"))).alias("_rows"),
            F.bool_or("is_anomaly").alias("is_anomaly"),
        )
        .filter(F.size("_rows") == length)
        .select(*by, "w", F.col("_rows.x").alias("xs"), F.col("_rows.is_anomaly").alias("flags"), "is_anomaly")
    )


def explode_windows(windows: DataFrame, *vectors: str, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Back to one row per step, for one or several per-step columns of the window table."""
    zipped = F.arrays_zip(*[F.col(v) for v in vectors])
    return windows.select(*by, "w", *keep, F.posexplode(zipped).alias("step", "_r")).select(
        *by, "w", *keep, "step", *[F.col("_r")[v].alias(v) for v in vectors]
    )


def window_label(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A window is anomalous if any of its rows is.  Counts are combined before the shuffle."""
    return df.groupBy(*by, "w").agg(
        F.bool_or("is_anomaly").alias("is_anomaly"), F.count_if("is_anomaly").alias("anomalous_rows")
    )


def partition_normal_anomalous(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add to every row whether its window is normal or anomalous (``win_anomaly``)."""
    marked = window_label(df, by).filter("is_anomaly").select(*by, "w", F.lit(True).alias("win_anomaly"))
    # written first: its size is looked at before it is joined
    joined = df.join(broadcast_if_small(save(marked, "marked")), [*by, "w"], "left")
    return joined.withColumn("win_anomaly", F.coalesce("win_anomaly", F.lit(False)))


def attach_expert_labels(windows: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Join the expert's verdict per window; windows without one count as normal.

    Several verdicts on a window are one: anomalous if one of them is.
    """
    verdict = labels.groupBy(*by, "w").agg(F.bool_or("is_anomaly").alias("_expert"))
    return (
        windows.drop("is_anomaly")
        .join(verdict, [*by, "w"], "left")
        .withColumn("is_anomaly", F.coalesce("_expert", F.lit(False)))
        .drop("_expert")
    )
