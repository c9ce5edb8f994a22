"""Hard-window buffers that feed retraining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.ordering import running_totals
from tidewatch.operators.index import count_rows, trim_to_multiple


def route_window(windows: DataFrame) -> DataFrame:
    """Which buffers a scored window enters, from ``flagged`` and the expert's ``is_anomaly``.

    Anomalous windows always enter the anomaly buffers.  Normal windows always give their
    errors to the normal error buffer, but enter the window buffer only as false alarms.
    """
    return windows.withColumns(
        {
            "to_anom_buf": F.col("is_anomaly"),
            "to_anom_err": F.col("is_anomaly"),
            "to_norm_buf": F.expr("flagged AND NOT is_anomaly"),
            "to_norm_err": F.expr("NOT is_anomaly"),
        }
    )


def buffer_growth(routed: DataFrame) -> DataFrame:
    """New buffered windows per batch."""
    return routed.groupBy("batch").agg(
        F.count_if("to_norm_buf").alias("new_normal"), F.count_if("to_anom_buf").alias("new_anomalous")
    )


def update_due(
    routed: DataFrame, per_batch: int, capacity: int, normal: int = 0, anomalous: int = 0, one_task: bool = False
) -> DataFrame:
    """Buffer fill after every batch, and whether an update is due then.

    ``normal`` and ``anomalous`` are the windows already buffered before the first batch.
    Due: at least ``capacity`` batches of normal windows, and any anomalous window.
    ``one_task`` sums up in one task, for callers that know the number of batches is small.
    """
    sums = {"normal_fill": "new_normal", "anomalous_fill": "new_anomalous"}
    growth = buffer_growth(routed)
    if one_task:
        so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
        filled = growth.withColumns({name: F.sum(c).over(so_far) for name, c in sums.items()})
    else:
        filled = running_totals(growth, ["batch"], sums)
    return filled.withColumns(
        {"normal_fill": F.col("normal_fill") + normal, "anomalous_fill": F.col("anomalous_fill") + anomalous}
    ).withColumn("due", (F.col("normal_fill") >= per_batch * capacity) & (F.col("anomalous_fill") > 0))


def oversample_by_doubling(buffer: DataFrame, at_least: int, rank: str = "rank", n: int | None = None) -> DataFrame:
    """Repeat a ranked buffer as a whole, doubling until it has ``at_least`` entries."""
    n = count_rows(buffer, rank) if n is None else n
    if n == 0:
        raise ValueError("an empty buffer cannot be oversampled")
    copies = 1
    while n * copies < at_least:
        copies *= 2
    return (
        buffer.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn(rank, F.col("copy") * F.lit(n) + F.col(rank))
        .drop("copy")
    )


def truncate_to_batches(buffer: DataFrame, per_batch: int, rank: str = "rank", n: int | None = None) -> DataFrame:
    """Keep whole batches only, in arrival order."""
    return trim_to_multiple(buffer, per_batch, n, rank)


def buffer_train_val(buffer: DataFrame, per_batch: int, rank: str = "rank", n: int | None = None) -> DataFrame:
    """Whole batches of a ranked buffer: the last one validates, the others train."""
    n = count_rows(buffer, rank) if n is None else n
    return truncate_to_batches(buffer, per_batch, rank, n).withColumns(
        {
            "batch": F.expr(f"{rank} div {int(per_batch)}"),
            "role": F.when(F.expr(f"{rank} div {int(per_batch)}") < n // per_batch - 1, "train").otherwise("val"),
        }
    )
