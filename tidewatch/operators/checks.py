"""Guards that stop a job early with a clear message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.scale import bounds_of
from tidewatch.operators.split import SUBSETS, Split


def check_nulls(df: DataFrame, vector: str = "x") -> DataFrame:
    """Number of rows, and of rows with a null or NaN feature."""
    bad = F.col(vector).isNull() | F.exists(vector, lambda v: v.isNull() | F.isnan(v))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad_rows"))


def require_no_nulls(df: DataFrame, vector: str = "x") -> None:
    bad = check_nulls(df, vector).first()["bad_rows"]
    if bad:
        raise ValueError(f"{bad} rows have a null or NaN feature")


def check_dim(df: DataFrame, width: int, vector: str = "x") -> None:
    """All rows have the configured number of features."""
    wrong = df.agg(F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != width)).first()[0]
    if wrong:
        raise ValueError(f"{wrong} rows do not have {width} features")


def guard_rows(df: DataFrame, width: int, position: str = "idx", vector: str = "x", label: str = "is_anomaly") -> DataFrame:
    """The same rows; reading one with a wrong number of features, a null or NaN feature, or no label fails and names it.

    Narrow and without a pass of its own, for rows that nothing has inspected.
    """
    features = f"""CASE WHEN coalesce(size({vector}), -1) != {int(width)} THEN 'does not have {int(width)} features'
        WHEN exists({vector}, v -> v IS NULL OR isnan(v)) THEN 'has a null or NaN feature' END"""
    named = F.concat(F.lit("row "), F.col(position).cast("string"), F.lit(" "))
    reason = F.expr(features)
    checked = {vector: F.when(reason.isNull(), F.col(vector)).otherwise(F.raise_error(F.concat(named, reason)))}
    if label in df.columns:
        missing = F.raise_error(F.concat(named, F.lit("has no label")))
        checked[label] = F.when(F.col(label).isNotNull(), F.col(label)).otherwise(missing)
    return df.withColumns(checked)


def _row_counts(df: DataFrame, width: int, vector: str) -> list:
    unlabelled = "count_if(is_anomaly IS NULL)" if "is_anomaly" in df.columns else "0L"
    return [
        F.expr(f"count_if(coalesce(size({vector}), -1) != {int(width)}) AS wrong_width"),
        F.expr(f"count_if({vector} IS NULL OR exists({vector}, v -> v IS NULL OR isnan(v))) AS bad_features"),
        F.expr(f"{unlabelled} AS unlabelled"),
    ]


def row_report(df: DataFrame, width: int, vector: str = "x") -> DataFrame:
    """Number of rows, and of those with a wrong number of features, a null or NaN feature, or no label."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *_row_counts(df, width, vector))


def inspect(df: DataFrame, width: int, vector: str = "x") -> tuple[list[float], list[float]]:
    """All row checks and the bounds of every feature, in one pass over the series."""
    row = df.agg(*_row_counts(df, width, vector), *bounds_of(width, vector)).first()
    if row["wrong_width"]:
        raise ValueError(f"{row['wrong_width']} rows do not have {width} features")
    if row["bad_features"]:
        raise ValueError(f"{row['bad_features']} rows have a null or NaN feature")
    if row["unlabelled"]:
        raise ValueError(f"{row['unlabelled']} rows have no label")
    return [row[f"lo{i}"] for i in range(width)], [row[f"hi{i}"] for i in range(width)]


def require_nonempty(
    split: Split, per_batch: int, n0: int | None = None, rows: int | None = None,
    length: int | None = None, capacity: int | None = None,
) -> list[str]:
    """Raise unless all subsets have windows; return warnings about sizes that limit the run."""
    sizes = split.sizes
    normal = sum(sizes[s] for s in ("sn", "vn1", "vn2", "tn"))
    if normal < 10:
        raise ValueError(f"only {normal} normal windows, at least 10 are needed")
    if any(sizes[s] == 0 for s in SUBSETS):
        raise ValueError(f"a subset has no windows: {sizes}")
    notes = [f"{s} has {sizes[s]} windows, less than one batch of {per_batch}" for s in SUBSETS if sizes[s] < per_batch]
    if n0 is not None and rows is not None:
        if n0 >= rows:
            notes.append(f"initialization takes {n0} rows, the series has only {rows}: nothing is left for the online phase")
        elif length is not None and capacity is not None and (rows - n0) // length < per_batch * capacity:
            notes.append(
                f"{(rows - n0) // length} online windows can never fill the buffer of {per_batch * capacity} windows"
            )
    return notes
