"""Choosing columns and rows of a raw table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_kinds(
    df: DataFrame, kinds: Sequence[str], keep: str = "continuous", label: int = -1, also: Sequence[str] = ()
) -> DataFrame:
    """Columns whose declared kind is ``keep``, then the label column.

    ``kinds`` lists the declared kind per ordinal; the label column need not be declared.
    """
    names = [c for c in df.columns if c not in also]
    chosen = [c for c, kind in zip(names, kinds) if kind == keep and c != names[label]]
    return df.select(*chosen, F.col(names[label]).alias("label"), *also)


def select_ordinals(df: DataFrame, ordinals: Sequence[int], label: int | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Columns by position, then the label column if given."""
    names = [c for c in df.columns if c not in also]
    tail = [] if label is None else [F.col(names[label]).alias("label")]
    return df.select(*[names[i] for i in ordinals], *tail, *also)


def filter_eq(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows of one value, e.g. one service."""
    return df.filter(F.col(column) == F.lit(value))


def to_vector(df: DataFrame, features: Sequence[str], vector: str = "x") -> DataFrame:
    """Gather the feature columns into one vector; the label stays on its row."""
    rest = [c for c in df.columns if c not in features]
    return df.select(*rest, F.array(*[F.col(c).cast("double") for c in features]).alias(vector))


def split_label(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Features and label as two series on the same positions."""
    return df.drop(label), df.select("idx", label)
