"""The online phase as a continuous query.

A micro-batch may span several model versions: it is handled by the same steps as a bounded
replay.  Model versions, buffers and the place reached are stored per micro-batch, so the
query can be stopped, or lose its driver, and go on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidewatch.functions.scratch import save, scratch_path
from tidewatch.models.base import Model
from tidewatch.operators.checks import guard_rows
from tidewatch.plans.online import Buffered, advance, buffer_rows, committed, decide
from tidewatch.plans.params import Params
from tidewatch.sources.models import load_model, save_model, save_models, write_run_log
from tidewatch.streaming.windows import WindowSink, global_windows_stream, read_state


def score_stream(model: Model, params: Params, path: str) -> WindowSink:
    """Sink that scores and flags windows with one fixed model."""

    def write(windows: DataFrame, batch_id: int) -> None:
        decide(windows, model, params).drop("xs", "flags").write.mode("overwrite").parquet(f"{path}/micro={batch_id}")

    return write


def adapt_stream(model: Model, params: Params, root: str, path: str) -> WindowSink:
    """Sink that scores windows and moves to new model versions where they are due.

    ``root`` holds the models, buffers and progress; decisions go to ``path``.
    """
    buffers, moments, progress = f"{root}/buffers", f"{root}/moments", f"{root}/progress"

    def write(windows: DataFrame, batch_id: int) -> None:
        spark = windows.sparkSession
        current, buffered, has_stored = model, Buffered(), False
        if batch_id == 0:
            if _exists(spark, f"{progress}/reached/batch=1"):
                raise ValueError(f"{root} holds the state of another run: take a new folder, or its checkpoint")
            save_model(spark, model, f"{root}/models", params)
        else:
            at = read_state(spark, progress, "reached", batch_id - 1).first()
            current = load_model(spark, f"{root}/models", params, at["version"])
            buffered, has_stored = Buffered(at["normal"], at["anomalous"]), at["has_stored"]
        # in the order of windows: every leg or stretch reads its own part of the table
        windows = save(windows.repartitionByRange("w"), "micro-windows")
        ends = windows.agg(F.min("batch").alias("first"), F.max("batch").alias("last")).first()
        if ends["first"] is None:
            _mark(spark, progress, batch_id, current, buffered, has_stored)
            return
        stored = None
        if has_stored:
            stored = (_stored(spark, buffers, current.version, batch_id), None if _all_errors(params) else _stored(spark, moments, current.version, batch_id))
        results = scratch_path(spark, "decisions")
        done = advance(
            windows, ends["first"], ends["last"], current, params, results, True, buffered, stored,
            lambda models: save_models(spark, models, f"{root}/models", params),
        )
        decisions = committed(spark, results, done.segments)
        decisions.write.mode("overwrite").parquet(f"{path}/micro={batch_id}")
        newest = done.versions[-1]
        left, sums = buffer_rows(windows.filter(F.col("batch") >= done.since), newest, params)
        left.write.mode("overwrite").parquet(f"{buffers}/v={newest.version}/micro={batch_id}")
        if sums is not None:
            sums.write.mode("overwrite").parquet(f"{moments}/v={newest.version}/micro={batch_id}")
        _mark(spark, progress, batch_id, newest, done.buffered, True)

    return write


def stream_online(
    source: DataFrame, model: Model, params: Params, order_by: Sequence[str], root: str, path: str, adapt: bool = True
) -> DataStreamWriter:
    """Continuous query from rows (``x``, ``is_anomaly``, order columns) to window decisions."""
    source = guard_rows(source, params.width, position=order_by[0])
    sink = adapt_stream(model, params, root, path) if adapt else score_stream(model, params, path)
    return global_windows_stream(source, params.length, params.per_batch, order_by, f"{root}/windows", sink)


def _stored(spark: SparkSession, buffers: str, version: int, before: int) -> DataFrame:
    """What earlier micro-batches buffered under the present version."""
    rows = spark.read.option("basePath", f"{buffers}/v={version}").parquet(f"{buffers}/v={version}")
    return rows.filter(F.col("micro") < before).drop("micro")


def _all_errors(params: Params) -> bool:
    """Updates read the errors of all windows, and not their moments."""
    return params.rescore_errors or params.refresh_threshold


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _mark(spark: SparkSession, progress: str, batch_id: int, model: Model, buffered: Buffered, has_stored: bool) -> None:
    """Where a micro-batch ended, and whether windows are stored under its version."""
    row = [(model.version, buffered.normal, buffered.anomalous, has_stored)]
    frame = spark.createDataFrame(row, "version long, normal long, anomalous long, has_stored boolean").coalesce(1)
    frame.write.mode("overwrite").parquet(f"{progress}/reached/batch={batch_id}")


def log_progress(spark: SparkSession, query: StreamingQuery, path: str, run: str) -> None:
    """Append batches, rows and seconds of the last micro-batch to the run metrics."""
    last = query.lastProgress
    if last is None:
        return
    duration = last.get("durationMs", {}).get("triggerExecution", 0) / 1000
    rows = [("batch", last["batchId"]), ("rows", last["numInputRows"]), ("seconds", duration)]
    write_run_log(spark, rows, path, run)
