"""Row positions and the positional operators built on them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.ordering import sorted_table
from tidewatch.functions.scratch import save

# A lookup table is broadcast up to this many rows; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def index_and_count(
    df: DataFrame, order_by: Sequence[Column | str], idx: str = "idx", keep: Sequence[str] | None = None
) -> tuple[DataFrame, int]:
    """Dense 0-based position in the order of ``order_by``, and the number of rows.

    One range shuffle on the whole sort key, so a hot timestamp does not end up in one task.
    Positions are completed from one count per range partition.  ``keep`` names the columns
    to store; others only serve the sort.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != idx]
    table = sorted_table(df, order_by, "indexed", keep)
    sizes = partition_sizes(table)
    placed = _place(table, sizes).select(*keep, (F.col("_pos") + F.col("_shift")).alias(idx))
    return placed, sum(sizes.values())


def with_index(
    df: DataFrame,
    order_by: Sequence[Column | str],
    by: Sequence[str] = (),
    idx: str = "idx",
    total: str | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Dense 0-based position, counted per stream if ``by`` is given.

    Streams are sorted together, so a hot one is spread over many range partitions; positions
    are completed from one count per range partition and stream.  ``total`` names an optional
    column with the number of rows of the stream.
    """
    by = list(by)
    if not by:
        placed, n = index_and_count(df, order_by, idx, keep)
        return placed.withColumn(total, F.lit(n).cast("long")) if total else placed
    kept = [c for c in dict.fromkeys([*by, *(df.columns if keep is None else keep)]) if c not in (idx, total)]
    table = sorted_table(df, [*by, *order_by], "indexed", kept)
    runs = table.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_pid",
        *by,
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("_total"),
    )
    runs = save(runs, "runs")
    right = runs.select(F.col("_pid").alias("_rp"), "_shift", "_total", *[F.col(c).alias(f"_r_{c}") for c in by])
    match = F.col("_pid") == F.col("_rp")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    extra = [F.col("_total").alias(total)] if total else []
    return table.join(broadcast_if_small(right), match).select(
        *kept, (F.col("_pos") + F.col("_shift")).alias(idx), *extra
    )


def partition_sizes(table: DataFrame) -> dict[int, int]:
    """Rows per range partition of a sorted table: as many numbers as there are partitions."""
    return {r["_pid"]: r["n"] for r in table.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}


def _place(table: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Add ``_shift``, the rows in earlier partitions: one row per range partition is broadcast."""
    pids = sorted(sizes)
    before = list(accumulate((sizes[p] for p in pids), initial=0))[:-1]
    offsets = pa.table({"_pid": pa.array(pids, pa.int32()), "_shift": pa.array(before, pa.int64())})
    return table.join(F.broadcast(table.sparkSession.createDataFrame(offsets)), "_pid")


def count_rows(df: DataFrame, idx: str = "idx") -> int:
    """Length of a densely indexed series."""
    last = df.agg(F.max(idx)).first()[0]
    return 0 if last is None else int(last) + 1


def downsample(df: DataFrame, k: int, offset: int = 0, idx: str = "idx") -> DataFrame:
    """Every ``k``-th row starting at ``offset``, re-indexed."""
    return df.filter(F.col(idx) % k == offset).withColumn(
        idx, F.expr(f"({_q(idx)} - {int(offset)}) div {int(k)}")
    )


def slice_rows(
    df: DataFrame, start: int | None = None, stop: int | None = None, n: int | None = None, idx: str = "idx"
) -> DataFrame:
    """Rows ``[start:stop]`` by position, with negative bounds counted from the end; re-indexed."""
    if n is None and any(b is not None and b < 0 for b in (start, stop)):
        n = count_rows(df, idx)
    first = 0 if start is None else start if start >= 0 else max(n + start, 0)
    keep = F.col(idx) >= first
    if stop is not None:
        keep = keep & (F.col(idx) < (stop if stop >= 0 else n + stop))
    return df.filter(keep).withColumn(idx, F.col(idx) - F.lit(first))


def trim_to_multiple(
    df: DataFrame, size: int, n: int | str | None = None, idx: str = "idx"
) -> DataFrame:
    """Drop the tail that does not fill a group of ``size`` rows.

    ``n`` is the length of the series, or the name of a column holding the length of the
    row's stream (``with_index(..., total=)``).
    """
    if isinstance(n, str):
        return df.filter(F.col(idx) < F.expr(f"({_q(n)} div {int(size)}) * {int(size)}"))
    n = count_rows(df, idx) if n is None else n
    return df.filter(F.col(idx) < n // size * size)


def read_init(df: DataFrame, n0: int, idx: str = "idx") -> DataFrame:
    """The first ``n0`` rows, used for initialization."""
    return df.filter(F.col(idx) < n0)


def read_online(df: DataFrame, n0: int, idx: str = "idx") -> DataFrame:
    """The rows after the first ``n0``, re-indexed from 0."""
    return df.filter(F.col(idx) >= n0).withColumn(idx, F.col(idx) - F.lit(n0))


def zip_columns(a: DataFrame, b: DataFrame, idx: str = "idx") -> DataFrame:
    """Side-by-side union of the columns of two indexed series; unmatched positions give nulls."""
    return a.join(b, idx, "full_outer")


def ordered_union(
    *parts: DataFrame, idx: str = "idx", source: str = "src_ord", sizes: Sequence[int] | None = None
) -> DataFrame:
    """The series one after the other, with one running position.  No shuffle.

    ``sizes`` are the lengths of the parts, if they are known.
    """
    result, offset = None, 0
    for i, part in enumerate(parts):
        shifted = part.withColumn(source, F.lit(i)).withColumn(idx, F.col(idx) + F.lit(offset).cast("long"))
        result = shifted if result is None else result.unionByName(shifted)
        if i + 1 < len(parts):
            offset += count_rows(part, idx) if sizes is None else sizes[i]
    return result


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
