"""How well scores and flags separate anomalous windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordering import running_totals


def _ranked_scores(windows: DataFrame, score: str) -> DataFrame:
    """Distinct scores from high to low with class counts and their running sums."""
    y = F.col("is_anomaly")
    counts = windows.groupBy(F.col(score).alias("score")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")
    )
    return running_totals(
        counts,
        [F.desc("score")],
        {"tp": "pos", "fp": "neg"},
        overall={"n_pos": "tp", "n_neg": "fp"},
    )


def roc_curve(windows: DataFrame, score: str = "score_max") -> DataFrame:
    """(score, fpr, tpr) at every distinct score, positive = anomalous."""
    return _ranked_scores(windows, score).select(
        "score",
        F.try_divide(F.col("fp").cast("double"), F.col("n_neg")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("n_pos")).alias("tpr"),
    )


def auc(windows: DataFrame, score: str = "score_max") -> DataFrame:
    """Area under the ROC curve (trapezoids), one row; null if a class is missing."""
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    cells = F.max("n_pos").cast("double") * F.max("n_neg").cast("double")
    return _ranked_scores(windows, score).agg(F.try_divide(area, cells).alias("auc"))


def confusion(windows: DataFrame) -> DataFrame:
    """Number of windows per flag and expert verdict."""
    return windows.groupBy("flagged", "is_anomaly").agg(F.count(F.lit(1)).alias("windows"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Dimensions, rows and share of anomalous rows in percent."""
    return df.agg(
        F.max(F.size("x")).cast("long").alias("dimensions"),
        F.count(F.lit(1)).alias("instances"),
        (F.avg(F.col("is_anomaly").cast("double")) * 100).alias("anomaly_percent"),
    )
