"""Count windows of many keyed series as state of the stream itself.

The state of a key is what its next windows need: the rows of its unfinished window and the number of
the next one, and with event time the rows that the watermark has not passed yet.  Spark keeps it in its
state store (RocksDB), checkpoints it with the query, and lets it go after a time to live.

All new rows of a key (in the order of event time: of a bucket of keys) in one micro-batch are put in order by one task, in memory; so the largest
key's rows of one micro-batch must fit there, and a key that brings a third of all rows is worked on by one
task.  ``streaming.windows.count_windows_stream`` has no such bound (its index sorts across tasks).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Groups that the keys of an ordered stream fall into; as the number of its state partitions, fixed for the life of a query.
BUCKETS = 256
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store; a query takes the session's setting when it starts."""
    spark.conf.set(_STORE, _ROCKS)


class CountWindows(StatefulProcessor):
    """Full windows of ``length`` rows per key, in the order of micro-batches and then of ``order_by``."""

    def __init__(self, length: int, order_by: Sequence[str], by: Sequence[str], rows: T.StructType, ttl_ms: int | None = None):
        self.length, self.order_by, self.by, self.ttl = length, list(order_by), list(by), ttl_ms
        self.rows = T.StructType([f for f in rows if f.name in self.order_by or f.name in ("x", "is_anomaly")])
        self.columns = self.rows.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getListState("tail", self.rows, self.ttl)
        self.next = handle.getValueState("next", T.StructType([T.StructField("w", T.LongType())]), self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True)[self.columns].sort_values(self.order_by, kind="stable")
        yield self.cut(key, [tuple(r) for r in fresh.itertuples(index=False)])

    def cut(self, key, fresh: list[tuple]) -> pd.DataFrame:
        """The windows that end with these rows; keeps what is left over."""
        held = [tuple(r) for r in self.tail.get()] if self.tail.exists() else []
        held += [tuple(_plain(v) for v in r) for r in fresh]
        w = self.next.get()[0] if self.next.exists() else 0
        full = len(held) // self.length
        out = []
        x, flag = self.columns.index("x"), self.columns.index("is_anomaly")
        for i in range(full):
            rows = held[i * self.length : (i + 1) * self.length]
            flags = [bool(r[flag]) for r in rows]
            out.append((*key, w + i, [list(r[x]) for r in rows], flags, any(flags)))
        self.next.update((w + full,))
        left = held[full * self.length :]
        if left:
            self.tail.put(left)
        else:
            self.tail.clear()
        return pd.DataFrame(out, columns=[*self.by, "w", "xs", "flags", "is_anomaly"])

    def close(self) -> None:
        pass


class OrderedCountWindows(StatefulProcessor):
    """Full windows of ``length`` rows per key in the order of event time: rows wait until the watermark has passed them.

    A group is a bucket of keys, and its state are blocks of rows (Arrow streams): calls to the state store go by bucket and
    micro-batch, whatever the number of keys.  A bucket's waiting rows and unfinished windows must fit in memory.
    """

    def __init__(self, length: int, time: str, order_by: Sequence[str], by: Sequence[str]):
        self.length, self.time, self.by, self.order_by = length, time, list(by), [time, *order_by]
        self.columns = [*self.by, *self.order_by, "x", "is_anomaly"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, block = handle, T.StructType([T.StructField("block", T.BinaryType())])
        self.waiting = handle.getListState("waiting", block)
        self.tail, self.next = handle.getValueState("tail", block), handle.getValueState("next", block)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self.release([part[self.columns] for part in rows if len(part)], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.release([], timerValues)

    def release(self, fresh: list[pd.DataFrame], timerValues) -> pd.DataFrame:
        """Windows of what the watermark has passed; a timer wakes the bucket for the rest."""
        held = [_rows(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = pd.concat(held + fresh, ignore_index=True) if held or fresh else pd.DataFrame(columns=self.columns)
        if not len(rows):
            return self.cut(rows)
        at = -(-rows[self.time].astype("datetime64[ns]").astype("int64") // 1_000_000)  # milliseconds since 1970, rounded up
        passed = at <= timerValues.getCurrentWatermarkInMs()
        if passed.all():
            self.waiting.clear()
        else:
            if passed.any():
                self.waiting.put([_block(rows[~passed])])
            elif fresh:
                self.waiting.appendList([_block(pd.concat(fresh, ignore_index=True))])
            self.handle.registerTimer(int(at[~passed].min()))
        return self.cut(rows[passed].sort_values(self.order_by, kind="stable"))

    def cut(self, passed: pd.DataFrame) -> pd.DataFrame:
        """The windows that end with these rows; keeps what is left over, and the number of every key's next window."""
        names = [*self.by, "w", "xs", "flags", "is_anomaly"]
        if not len(passed):
            return pd.DataFrame(columns=names)
        parts = [_rows(self.tail.get())] if self.tail.exists() else []
        rows = pd.concat([*parts, passed], ignore_index=True)
        rows = rows.iloc[rows.groupby(self.by, sort=False, dropna=False).ngroup().argsort(kind="stable")]
        keys = rows.groupby(self.by, sort=False, dropna=False)
        place, size = keys.cumcount(), keys["is_anomaly"].transform("size")
        full = (place < size // self.length * self.length).to_numpy()
        left, rows, place = rows[~full], rows[full], place[full]
        if len(left):
            self.tail.update(_block(left))
        elif self.tail.exists():
            self.tail.clear()
        if not len(rows):
            return pd.DataFrame(columns=names)
        starts = range(0, len(rows), self.length)
        out = rows[self.by].iloc[:: self.length].reset_index(drop=True)
        out["w"] = (place.to_numpy()[:: self.length] // self.length).astype("int64")
        if self.next.exists():
            before = _rows(self.next.get())
            out["w"] += out[self.by].merge(before, on=self.by, how="left")["_next"].fillna(0).to_numpy().astype("int64")
        else:
            before = None
        after = out.groupby(self.by, sort=False, dropna=False)["w"].max().add(1).rename("_next").reset_index()
        if before is not None:
            after = pd.concat([before, after], ignore_index=True).groupby(self.by, sort=False, dropna=False)["_next"].max().reset_index()
        self.next.update(_block(after))
        xs, flags = rows["x"].tolist(), rows["is_anomaly"].astype(bool).tolist()
        out["xs"] = [[list(x) for x in xs[i : i + self.length]] for i in starts]
        out["flags"] = [flags[i : i + self.length] for i in starts]
        out["is_anomaly"] = [any(f) for f in out["flags"]]
        return out[names]

    def close(self) -> None:
        pass


def _block(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as one value of the state."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _rows(value: tuple) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(value[0])).read_pandas()


def _plain(value):
    """Values of pandas and NumPy as the state store takes them."""
    if hasattr(value, "to_pydatetime"):
        return value.to_pydatetime()
    if hasattr(value, "tolist"):
        return value.tolist()
    return value


def window_type(rows: T.StructType, by: Sequence[str]) -> T.StructType:
    fields = [T.StructField("w", T.LongType()), T.StructField("xs", T.ArrayType(T.ArrayType(T.DoubleType())))]
    fields += [T.StructField("flags", T.ArrayType(T.BooleanType())), T.StructField("is_anomaly", T.BooleanType())]
    return T.StructType([*[rows[c] for c in by], *fields])


def keyed_windows_stream(stream: DataFrame, length: int, order_by: Sequence[str], by: Sequence[str], ttl_ms: int | None = None) -> DataFrame:
    """Streaming table of full windows (``by``, w, xs, flags, is_anomaly), numbered per key.

    ``stream`` has ``x``, ``is_anomaly``, the ``order_by`` and the ``by`` columns.  Rows keep the order of micro-batches, then of ``order_by``.
    With ``ttl_ms``, the state of a key that was quiet for so long goes: its unfinished
    window is lost, and if the key comes back its windows are numbered from 0 again.
    """
    use_state_store(stream.sparkSession)
    rows = stream.select(*by, *order_by, "x", "is_anomaly")
    processor = CountWindows(length, order_by, by, rows.schema, ttl_ms)
    return rows.groupBy(*by).transformWithStateInPandas(processor, window_type(rows.schema, by), "Append", "ProcessingTime" if ttl_ms else "None")


def with_event_time(df: DataFrame, time: str, delay: str) -> DataFrame:
    """``time`` as an instant (streams take no zoneless timestamps) under a watermark that lags by ``delay``."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def ordered_windows_stream(stream: DataFrame, length: int, time: str, order_by: Sequence[str], by: Sequence[str], delay: str, buckets: int = BUCKETS) -> DataFrame:
    """As ``keyed_windows_stream``, in the order of event time, whatever the order of arrival.

    A row waits until the watermark (the latest ``time`` seen, less ``delay``) has passed it.  Rows that
    arrive behind the watermark are dropped and counted in the progress of the query (``RunLog``);
    what the last watermark has not passed stays in the state.
    """
    use_state_store(stream.sparkSession)
    rows = with_event_time(stream.select(*by, time, *order_by, "x", "is_anomaly"), time, delay)
    # a key that is null has a group of its own: its columns hold no numbers
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in by])
    rows = rows.withColumn("_bucket", F.when(missing, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*by), F.lit(buckets))).cast("int"))
    processor = OrderedCountWindows(length, time, order_by, by)
    return rows.groupBy("_bucket").transformWithStateInPandas(processor, window_type(rows.schema, by), "Append", "EventTime")
