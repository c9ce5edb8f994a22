"""What streaming queries report about themselves, as run metrics."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from tidewatch.sources.models import write_run_log

#: Micro-batches held before they are written, and seconds to wait for the last report of a query that has ended.
HELD, LAST_REPORT = 1000, 60


class RunLog(StreamingQueryListener):
    """Writes one row per metric and micro-batch: rows, rows that came too late, seconds.

    Spark counts them on the way, so the log needs no pass over the data.  The run of a row is ``run/number of the micro-batch``.
    """

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run
        self.rows: list[tuple[int, list[tuple[str, object]]]] = []
        self.running, self.idle = 0, threading.Event()
        self.idle.set()

    def onQueryStarted(self, event) -> None:
        self.running += 1
        self.idle.clear()

    def onQueryProgress(self, event) -> None:
        done = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in done.stateOperators)
        kept = sum(s.numRowsTotal for s in done.stateOperators)
        seconds = done.durationMs.get("triggerExecution", 0) / 1000
        self.rows.append((done.batchId, [("rows", done.numInputRows), ("late_rows", late), ("state_rows", kept), ("seconds", seconds)]))
        if len(self.rows) >= HELD:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running -= 1
        if not self.running:
            self.idle.set()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            write_run_log(self.spark, [(f"{batch}/{name}", value) for batch, metrics in rows for name, value in metrics], self.path, self.run)


@contextmanager
def run_log(spark: SparkSession, path: str, run: str) -> Iterator[RunLog]:
    """Log all streaming queries that start and end inside, as ``batch/metric`` rows of ``run``."""
    log = RunLog(spark, path, run)
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        log.idle.wait(LAST_REPORT)
        spark.streams.removeListener(log)
        log.flush()
