"""Keyed state, late rows, late verdicts, positions as offsets, and moments that are merged."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_jobs import finish, indexed, settings, wave, write_parts
from tidewatch.operators.errors import fit_error_model, merge_moments, moment_rows
from tidewatch.plans.initialize import initialize
from tidewatch.plans.online import buffer_rows, online_windows, replay_online
from tidewatch.sources.positions import SeriesReader, SeriesSource, Span
from tidewatch.streaming.keyed import keyed_windows_stream, ordered_windows_stream
from tidewatch.streaming.log import run_log
from tidewatch.streaming.online import stream_online
from tidewatch.streaming.verdicts import attach_late_verdicts, settled


@pytest.fixture
def few_partitions(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def rows_of(spark, n):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5))
    return spark.range(n).select(F.col("id").alias("idx"), key.alias("key"), F.array(F.col("id").cast("double")).alias("x"), (F.col("id") % 17 == 0).alias("is_anomaly"))


def windows_by_hand(rows, length):
    out = Counter()
    for key, part in rows.groupby("key"):
        for w in range(len(part) // length):
            cut = part.iloc[w * length : (w + 1) * length]
            out[key, w, tuple(v[0] for v in cut.x), tuple(cut.is_anomaly), bool(cut.is_anomaly.any())] += 1
    return out


def found_in(df):
    return Counter((r.key, r.w, tuple(v[0] for v in r.xs), tuple(r.flags), r.is_anomaly) for r in df.collect())


def source_of(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def test_keyed_state_over_micro_batches_and_a_restart(spark, tmp_path, few_partitions):
    df, at = rows_of(spark, 160), str(tmp_path / "in")
    write_parts(spark, df, at, [3, 50, 1])

    def run():
        windows = keyed_windows_stream(source_of(spark, df, at), 4, ["idx"], ["key"])
        finish(windows.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "check"))

    run()
    write_parts(spark, df.filter("idx >= 54").withColumn("idx", F.col("idx") - 54), str(tmp_path / "later"), [106])
    df.filter("idx >= 54").coalesce(1).write.parquet(f"{at}/part=9")
    run()
    assert found_in(spark.read.parquet(str(tmp_path / "out"))) == windows_by_hand(df.toPandas(), 4)


def test_state_of_quiet_keys_goes(spark, tmp_path, few_partitions):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else the query is never idle
    df, at = rows_of(spark, 6).withColumn("key", F.lit("a")), str(tmp_path / "in")
    df.coalesce(1).write.parquet(f"{at}/part=0")
    windows = keyed_windows_stream(source_of(spark, df, at), 4, ["idx"], ["key"], ttl_ms=2000)
    query = windows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        time.sleep(4)
        df.filter("idx < 4").coalesce(1).write.parquet(f"{at}/part=1")
        query.processAllAvailable()
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.w, r.xs[0][0]) for r in rows) == [(0, 0.0), (0, 0.0)]  # the two rows left over are gone, and numbers start anew


def test_event_time_puts_rows_in_order_and_drops_those_behind_the_watermark(spark, tmp_path, few_partitions):
    df = rows_of(spark, 120).withColumn("ts", F.timestamp_seconds(1000 + F.col("idx") * 10).cast("timestamp_ntz"))
    # files of 40 rows; rows 5 and 45 come one file late (within the delay), row 7 two files late
    moved = {5: 1, 45: 2, 7: 2}
    file = F.floor(F.col("idx") / 40)
    for i, f in moved.items():
        file = F.when(F.col("idx") == i, f).otherwise(file)
    at = str(tmp_path / "in")
    for f in range(3):
        df.filter(file == f).coalesce(1).write.parquet(f"{at}/part={f}")
    df.filter("idx = 0").withColumns({"idx": F.lit(500).cast("long"), "ts": F.timestamp_seconds(F.lit(90_000)).cast("timestamp_ntz")}).write.parquet(f"{at}/part=3")
    windows = ordered_windows_stream(source_of(spark, df, at), 4, "ts", ["idx"], ["key"], "300 seconds")
    with run_log(spark, str(tmp_path / "log"), "late"):
        finish(windows.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "check"))
    kept = df.filter("idx != 7").toPandas()
    assert found_in(spark.read.parquet(str(tmp_path / "out"))) == windows_by_hand(kept, 4)
    log = {r.metric: r.value for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert sum(int(v) for k, v in log.items() if k.endswith("/late_rows")) == 1
    assert [int(log[f"{b}/rows"]) for b in range(4)] == [38, 40, 42, 1]


def test_verdicts_reach_windows_of_earlier_micro_batches(spark, tmp_path, few_partitions):
    minutes = lambda m: F.timestamp_seconds(F.lit(m) * 60)
    windows = spark.range(1, 21).select(F.col("id").alias("w"), F.timestamp_seconds(F.col("id") * 600).alias("time"), F.lit(True).alias("is_anomaly"))
    given = [(2, True, 25), (2, False, 26), (5, True, 51), (5, True, 52), (7, True, 131), (9, False, 95), (11, True, 100), (12, True, 180)]
    # window 7 (minute 70): 61 minutes late; 11 (minute 110): before the window; 12 (minute 120): at the limit
    verdicts = spark.createDataFrame(given, "w long, is_anomaly boolean, m long").select("w", "is_anomaly", F.timestamp_seconds(F.col("m") * 60).alias("given"))
    for f in range(2):
        windows.filter(F.col("w").between(f * 10 + 1, f * 10 + 10)).coalesce(1).write.parquet(f"{tmp_path}/w/part={f}")
    windows.filter("w = 1").withColumns({"w": F.lit(-1).cast("long"), "time": minutes(100_000)}).write.parquet(f"{tmp_path}/w/part=2")
    for f, (lo, hi) in enumerate([(0, 30), (30, 100), (100, 200)]):
        verdicts.filter(F.unix_seconds("given").between(lo * 60, hi * 60 - 1)).coalesce(1).write.parquet(f"{tmp_path}/v/part={f}")
    verdicts.limit(1).withColumns({"w": F.lit(-1).cast("long"), "given": minutes(100_000)}).write.parquet(f"{tmp_path}/v/part=3")
    out = attach_late_verdicts(source_of(spark, windows, f"{tmp_path}/w"), source_of(spark, verdicts, f"{tmp_path}/v"), "60 MINUTES")
    finish(out.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "check"))
    rows = settled(spark.read.parquet(str(tmp_path / "out")).filter("w > 0")).collect()
    assert sorted((r.w, r.is_anomaly) for r in rows) == [(w, w in (2, 5, 12)) for w in range(1, 21)]


def test_positions_are_handed_out_once(tmp_path, spark):
    path, progress = str(tmp_path / "series"), str(tmp_path / "progress" / "at.json")
    spark.range(100).select(F.col("id").alias("idx"), F.array(F.col("id").cast("double")).alias("x")).repartition(3).write.parquet(path)
    schema = spark.read.parquet(path).schema
    reader = SeriesReader(path, 30, progress, 4, schema)
    assert reader.initialOffset() == {"at": 0} and [reader.latestOffset()["at"] for _ in range(2)] == [30, 60]
    again = SeriesReader(path, 30, progress, 4, schema)  # after a restart: the last one once more, then on
    assert [again.latestOffset()["at"] for _ in range(4)] == [60, 90, 100, 100]
    spans = again.partitions({"at": 30}, {"at": 60})
    assert [(s.start, s.stop) for s in spans] == [(30, 38), (38, 46), (46, 54), (54, 60)]
    assert sorted(i for s in spans for b in again.read(s) for i in b.column(0).to_pylist()) == list(range(30, 60))
    assert again.partitions({"at": 60}, {"at": 60}) == [] and not list(again.read(Span(5, 5)))
    with pytest.raises(ValueError, match="progress|checkpoint"):
        again.partitions({"at": 60}, {"at": 30})


def test_a_stream_of_positions_stops_and_goes_on(spark, tmp_path):
    x, bad = wave(2300, 3, 1, 2100, 24)
    p = settings(1, 3, 8)
    s = indexed(spark, x, np.flatnonzero(bad).tolist())
    model = initialize(s, p)
    rest = s.filter(F.col("idx") >= p.init_rows).withColumn("idx", F.col("idx") - p.init_rows)
    rest.select("idx", "x", "is_anomaly").repartition(3).write.parquet(str(tmp_path / "series"))
    spark.dataSource.register(SeriesSource)

    def writer():
        source = spark.readStream.format("series").option("path", str(tmp_path / "series")).option("progress", str(tmp_path / "at.json"))
        rows = stream_online(source.option("step", p.length * p.per_batch * 4).load(), model, p, ["idx"], str(tmp_path / "run"), str(tmp_path / "out"), adapt=False)
        return rows.option("checkpointLocation", str(tmp_path / "check"))

    for _ in range(2):  # one step each; the second run takes the first one's position up
        writer().trigger(availableNow=True).start().awaitTermination()
    query = writer().start()
    try:
        for _ in range(2):
            query.processAllAvailable()
    finally:
        query.stop()
    got = {(r.w, r.is_anomaly, round(r.score_max, 9), r.flagged) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.w, r.is_anomaly, round(r.score_max, 9), r.flagged) for r in replay_online(s, model, p, adapt=False).windows.collect()}


@pytest.mark.parametrize("width", [1, 3, 12])
def test_merged_moments_are_those_of_all_rows(spark, tmp_path, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(500, width)) @ rng.normal(size=(width, width)) + 1e3
    errors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i long, e array<double>").repartition(5)
    for part, rows in enumerate(("i < 7", "i = 7", "i > 7 AND i < 300", "i >= 300", "i < 0")):
        moment_rows(errors.filter(rows).select("e"), width).write.parquet(f"{tmp_path}/micro={part}")
    merged = merge_moments(spark.read.parquet(str(tmp_path)).drop("micro"), width)
    whole = fit_error_model(errors.select("e"), width)
    assert np.allclose(merged.mu, whole.mu, rtol=1e-9) and np.allclose(merged.sigma, whole.sigma, rtol=1e-9, atol=1e-9)
    assert np.allclose(merged.sigma, x.var() if width == 1 else np.cov(x.T))
    with pytest.raises(ValueError, match="too few"):
        merge_moments(spark.read.parquet(f"{tmp_path}/micro=4"), width)


def test_buffers_hold_false_alarms_and_moments_only(spark):
    x, bad = wave(4000, 3, 1, 2700, 96)
    p = settings(1, 3, 8)
    s = indexed(spark, x, np.flatnonzero(bad).tolist())
    model = initialize(s, p)
    windows = online_windows(s, p)
    rows, moments = buffer_rows(windows, model, p)
    flagged = replay_online(s, model, p, adapt=False).windows.filter("flagged AND NOT is_anomaly").count()
    assert rows.columns == ["w", "xs", "to_norm_buf"] and rows.count() == flagged
    assert moments.count() == 1 and moments.first()["n"] == windows.filter("NOT is_anomaly").count() * p.length


def test_state_of_an_ordered_stream_goes_by_bucket(spark, tmp_path, few_partitions):
    """Windows are right and the state has few values, however many keys there are."""
    df = rows_of(spark, 2000).withColumns({"key": F.concat(F.lit("k"), F.col("idx") % 300), "ts": F.timestamp_seconds(1000 + F.col("idx")).cast("timestamp_ntz")})
    at = str(tmp_path / "in")
    for part in range(2):
        df.filter(F.col("idx") % 2 == part).coalesce(1).write.parquet(f"{at}/part={part}")
    df.filter("idx = 0").withColumns({"idx": F.lit(5000).cast("long"), "ts": F.timestamp_seconds(F.lit(90_000)).cast("timestamp_ntz")}).write.parquet(f"{at}/part=2")
    windows = ordered_windows_stream(source_of(spark, df, at), 4, "ts", ["idx"], ["key"], "3000 seconds", buckets=3)
    with run_log(spark, str(tmp_path / "log"), "ordered"):
        finish(windows.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "check"))
    assert found_in(spark.read.parquet(str(tmp_path / "out"))) == windows_by_hand(df.toPandas(), 4)
    state = [int(r.value) for r in spark.read.parquet(str(tmp_path / "log")).collect() if r.metric.endswith("/state_rows")]
    assert 0 < max(state) < 100
