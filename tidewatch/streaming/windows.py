"""Count windows over a stream, per key or over the whole stream.

Every micro-batch is put in order behind the rows left over from the last one, numbered by
the same skew-proof index as in batch, and cut into full windows; the tail of every key is
the state.  State and results of a micro-batch are folders named by its number, so a
repeated micro-batch overwrites its own output and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.operators.index import broadcast_if_small, with_index
from tidewatch.operators.windows import assign_batches, collect_windows

WindowSink = Callable[[DataFrame, int], None]


def count_windows_stream(
    stream: DataFrame,
    length: int,
    order_by: Sequence[str],
    state: str,
    sink: WindowSink,
    by: Sequence[str] = (),
    per_batch: int = 1,
) -> DataStreamWriter:
    """Hand the full windows of every micro-batch to ``sink(windows, batch_id)``.

    ``stream`` has ``x``, ``is_anomaly``, the ``order_by`` and the ``by`` columns.  Rows keep
    the order of micro-batches, then of ``order_by``.  With ``per_batch`` only whole batches
    of windows are handed on.
    """

    def step(rows: DataFrame, batch_id: int) -> None:
        sink(cut_windows(rows, batch_id, length, order_by, state, by, per_batch), batch_id)

    return stream.writeStream.foreachBatch(step)


def global_windows_stream(
    stream: DataFrame, length: int, per_batch: int, order_by: Sequence[str], state: str, sink: WindowSink
) -> DataStreamWriter:
    """One series over the whole stream, in whole batches."""
    return count_windows_stream(stream, length, order_by, state, sink, per_batch=per_batch)


def cut_windows(
    rows: DataFrame, batch_id: int, length: int, order_by: Sequence[str], state: str, by: Sequence[str], per_batch: int
) -> DataFrame:
    """Full windows of one micro-batch; writes the state for the next one."""
    spark, by, order_by = rows.sparkSession, list(by), list(order_by)
    size = length * per_batch
    columns = [*by, *order_by, "x", "is_anomaly"]
    fresh = rows.select(*columns, F.lit(1).alias("_new"), F.lit(0).cast("long").alias("_at"))
    before = read_state(spark, state, "rest", batch_id - 1)
    if before is not None:
        fresh = before.select(*columns, F.lit(0).alias("_new"), "_at").unionByName(fresh)
    placed = with_index(fresh, ["_new", "_at", *order_by], by=by, total="_n")
    starts = read_state(spark, state, "next", batch_id - 1)
    if starts is None:
        placed = placed.withColumn("_start", F.lit(0).cast("long"))
    elif by:
        right = starts.select("_start", *[F.col(c).alias(f"_k_{c}") for c in by])
        match = F.lit(True)
        for c in by:
            match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        placed = placed.join(broadcast_if_small(right), match, "left").drop(*[f"_k_{c}" for c in by])
        placed = placed.withColumn("_start", F.coalesce("_start", F.lit(0).cast("long")))
    else:
        placed = placed.withColumn("_start", F.lit(starts.first()["_start"]).cast("long"))
    placed = placed.withColumn("_full", F.expr(f"_n div {size} * {size}"))

    rest = placed.filter(F.col("idx") >= F.col("_full"))
    rest = rest.select(*columns, (F.col("idx") - F.col("_full")).alias("_at"))
    rest.write.mode("overwrite").parquet(f"{state}/rest/batch={batch_id}")
    _next_starts(placed, starts, by).write.mode("overwrite").parquet(f"{state}/next/batch={batch_id}")

    full = placed.filter(F.col("idx") < F.col("_full")).withColumn("idx", F.col("_start") + F.col("idx"))
    numbered = full.withColumns({"w": F.expr(f"idx div {length}"), "step": (F.col("idx") % length).cast("int")})
    windows = collect_windows(numbered, length, by)
    return assign_batches(windows, per_batch) if per_batch > 1 else windows


def _next_starts(placed: DataFrame, starts: DataFrame | None, by: list[str]) -> DataFrame:
    """Position of the next row to be cut, per key: one row per key seen so far."""
    moved = placed.groupBy(*by).agg(F.max(F.col("_start") + F.col("_full")).alias("_start"))
    if starts is None:
        return moved.na.fill({"_start": 0})
    return starts.select(*by, "_start").unionByName(moved).groupBy(*by).agg(F.max("_start").alias("_start"))


def read_state(spark: SparkSession, state: str, name: str, batch_id: int) -> DataFrame | None:
    """State written by a micro-batch; none before the first."""
    return spark.read.parquet(f"{state}/{name}/batch={batch_id}") if batch_id >= 0 else None


def parquet_windows(path: str) -> WindowSink:
    """Sink that keeps the windows of every micro-batch in a folder of its own."""

    def write(windows: DataFrame, batch_id: int) -> None:
        windows.write.mode("overwrite").parquet(f"{path}/micro={batch_id}")

    return write
