"""Verdicts of an expert that come later than the windows they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_late_verdicts(
    windows: DataFrame, verdicts: DataFrame, within: str, time: str = "time", given: str = "given", delay: str = "0 seconds", w: str = "w"
) -> DataFrame:
    """Streaming windows with ``is_anomaly`` from the verdicts given on them until ``within`` after their ``time``.

    Two streams are joined on the window and a range of time.  A window waits in the state until the watermarks of both
    (the latest ``time`` and ``given``, less ``delay``) say that no verdict in time can come any more; then it counts as normal.  Verdicts before the
    window or later than ``within`` are none.  Several verdicts on a window give a row each: ``settled`` makes one of them.
    """
    left = windows.drop("is_anomaly").withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    right = verdicts.select(F.col(w).alias("_w"), F.col("is_anomaly").alias("_expert"), F.col(given).cast("timestamp").alias("_given"))
    right = right.withWatermark("_given", delay)
    in_time = (F.col("_given") >= F.col(time)) & (F.col("_given") <= F.col(time) + F.expr(f"INTERVAL {within}"))
    joined = left.join(right, (F.col(w) == F.col("_w")) & in_time, "left_outer")
    return joined.withColumn("is_anomaly", F.coalesce("_expert", F.lit(False))).drop("_w", "_expert", "_given")


def settled(attached: DataFrame) -> DataFrame:
    """One row per window of what ``attach_late_verdicts`` wrote: anomalous if one of its verdicts is."""
    others = [c for c in attached.columns if c != "is_anomaly"]
    return attached.groupBy(*others).agg(F.bool_or("is_anomaly").alias("is_anomaly"))
