"""From raw tables to uniform series: features, then the label, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidewatch.operators.index import downsample, index_and_count, ordered_union, slice_rows, zip_columns
from tidewatch.operators.labels import canonical_label, minority_as_anomaly
from tidewatch.operators.project import filter_eq, select_kinds, select_ordinals, to_vector
from tidewatch.sources.series import write_series

# fixed values: sampling rate and kept range of the power series, service ordinal and names,
# feature ordinals and target class of the forest table
POWER_RATE, POWER_START, POWER_STOP = 8, 60, -36
SERVICE_ORDINAL, SERVICES = 2, ("smtp", "http")
FOREST_ORDINALS, FOREST_CLASS = (0, 1, 2, 3, 4, 5, 9), 4


def prepare_power(
    data: DataFrame, labels: DataFrame, rate: int = POWER_RATE, start: int = POWER_START, stop: int = POWER_STOP
) -> DataFrame:
    """Every ``rate``-th row, cut to full weeks, beside its labels.  Both inputs carry ``idx``."""
    return zip_columns(slice_rows(downsample(data, rate), start, stop), labels)


def prepare_services(
    raw: DataFrame, kinds: Sequence[str], services: Sequence[str] = SERVICES, service: int = SERVICE_ORDINAL
) -> dict[str, DataFrame]:
    """Numeric columns and label of every service, re-indexed, and all of them one after the other."""
    column = [c for c in raw.columns if c != "idx"][service]
    parts, sizes = {}, []
    for value in services:
        rows = select_kinds(filter_eq(raw, column, value), kinds, also=["idx"])
        parts[value], n = index_and_count(rows, ["idx"])
        sizes.append(n)
    parts["".join(services)] = ordered_union(*parts.values(), sizes=sizes).drop("src_ord")
    return parts


def prepare_forest(
    raw: DataFrame, ordinals: Sequence[int] = FOREST_ORDINALS, cls: object = FOREST_CLASS
) -> DataFrame:
    """Chosen features by position; one class is the anomaly (``None``: the rarest)."""
    return minority_as_anomaly(select_ordinals(raw, ordinals, label=-1, also=["idx"]), cls)


def canonical_series(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """(idx, x, label, is_anomaly) from a prepared table."""
    features = features or [c for c in df.columns if c not in ("idx", "label")]
    return canonical_label(to_vector(df.select("idx", "label", *features), features)).select(
        "idx", "x", "label", "is_anomaly"
    )


def store_series(df: DataFrame, path: str, source: str = "parquet") -> None:
    """Keep a prepared series: Parquet sorted by ``idx`` (prunes by row range), or headerless CSV."""
    if source == "csv":
        write_series(df, path)
        return
    df.repartitionByRange("idx").sortWithinPartitions("idx").write.parquet(path)
