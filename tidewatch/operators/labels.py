"""One meaning of "anomalous" for all phases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: spellings of the normal class, and the classes written by preparation
NORMAL_VALUES = ("normal", "normal.")
NORMAL_CLASS, ANOMALY_CLASS = "normal.", "anomaly."


def canonical_label(df: DataFrame, normal_values: Sequence[str] = NORMAL_VALUES, label: str = "label") -> DataFrame:
    """Add ``is_anomaly``: the label is none of the normal spellings; a missing label is none either."""
    return df.withColumn("is_anomaly", F.coalesce(~F.col(label).isin(*normal_values), F.lit(True)))


def smallest_class(df: DataFrame, label: str = "label") -> object:
    """The rarest class; ties go to the smallest value."""
    row = df.groupBy(label).count().orderBy("count", label).first()
    return None if row is None else row[label]


def minority_as_anomaly(df: DataFrame, cls: object = None, label: str = "label") -> DataFrame:
    """Relabel one class as anomalous and the rest as normal; default is the rarest class."""
    cls = smallest_class(df, label) if cls is None else cls
    return df.withColumn(label, F.when(F.col(label) == F.lit(cls), ANOMALY_CLASS).otherwise(NORMAL_CLASS))
