"""Queries that run as streams with state, late rows and late verdicts, over the whole of the given tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.queries import B, L, query, run_to_end, setup
from registry.streams import HARD, WIDTH, table, vector, windows_of
from tidewatch.functions.scratch import save, scratch_path
from tidewatch.models.base import reconstruction_errors
from tidewatch.models.profile import Profile
from tidewatch.operators import index, windows as win
from tidewatch.operators.errors import error_rows, merge_moments, moment_rows
from tidewatch.plans.initialize import initialize
from tidewatch.plans.online import DECISION, replay_online
from tidewatch.sources.positions import SeriesSource
from tidewatch.streaming.keyed import keyed_windows_stream, ordered_windows_stream
from tidewatch.streaming.log import run_log
from tidewatch.streaming.online import stream_online
from tidewatch.streaming.verdicts import attach_late_verdicts, settled

#: The events arrive in so many files; every fifth comes one file late and every seventh three files late.
SLOTS, SOMETIMES, SELDOM = 6, (5, 1), (7, 3)
#: Partitions of the state, and seconds that the state of a quiet key is kept.
STATE_PARTITIONS, QUIET = 8, 3600
#: Hours after which the verdict on a window comes (its number modulo LAGS), and how late it may come.
LAGS, IN_TIME = 5, 3


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for the streams that start inside."""
    conf = {f"spark.sql.{k.replace('__', '.')}": v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stateful(spark: SparkSession, **conf: str):
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")  # set anew by the operator, and back afterwards
    return settings(spark, shuffle__partitions=str(STATE_PARTITIONS), streaming__stateStore__providerClass=store, **conf)


def write_stream(df: DataFrame, home: str, name: str):
    return df.writeStream.format("parquet").option("path", f"{home}/{name}")


def opened(windows: DataFrame, *by: str) -> DataFrame:
    steps = win.explode_windows(windows.drop("is_anomaly"), "xs", "flags", by=by)
    return steps.select(*by, "w", "step", F.col("xs")[0].alias("value"), F.col("flags").alias("is_anomaly"))


@query
def stream_keyed_state(spark, sf):
    """As ``stream_keyed_windows``, with the unfinished window of every key in the state store."""
    home = scratch_path(spark, "stream")
    source = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = source.select("user_id", "ts", "event_id", vector("value"), (F.col("value") > 200).alias("is_anomaly"))
    # With a time to live, an idle query goes on looking for state to clean; this one is to end with its input.
    with stateful(spark, streaming__noDataMicroBatches__enabled="false"):
        windows = keyed_windows_stream(rows, L, ["ts", "event_id"], ["user_id"], ttl_ms=QUIET * 1000)
        run_to_end(write_stream(windows, home, "windows"), f"{home}/checkpoint")
    return opened(spark.read.schema(windows.schema).parquet(f"{home}/windows"), "user_id")


def late_events(spark, sf, home: str) -> tuple[DataFrame, int]:
    """The events as a stream of files, some rows in a later file than their time says, and the delay of the watermark in seconds."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", vector("value"), (F.col("value") > 200).alias("is_anomaly"))
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    ends = events.agg(F.min(second).alias("first"), F.max(second).alias("last")).first()
    first, span = ends["first"] or 0, (ends["last"] or 0) - (ends["first"] or 0) + 1
    slot = F.expr("slot").cast("int")
    late = F.when(F.col("event_id") % SELDOM[0] == 0, SELDOM[1]).when(F.col("event_id") % SOMETIMES[0] == 0, SOMETIMES[1]).otherwise(0)
    placed = events.withColumn("slot", F.floor((second - first) * SLOTS / span)).withColumn("file", slot + late).drop("slot")
    placed = save(placed, "late_events")
    for file in range(SLOTS + SELDOM[1]):
        placed.filter(F.col("file") == file).drop("file").coalesce(1).write.parquet(f"{home}/in/file={file}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in/file=*"), span // 4


def run_late(spark, sf) -> str:
    home = scratch_path(spark, "stream")
    source, delay = late_events(spark, sf, home)
    with stateful(spark), run_log(spark, f"{home}/log", "late"):
        windows = ordered_windows_stream(source, L, "ts", ["event_id"], ["user_id"], f"{delay} seconds")
        run_to_end(write_stream(windows, home, "windows"), f"{home}/checkpoint")
    return home


@query
def stream_ordered_windows(spark, sf):
    """Windows in the order of event time from files out of order; rows behind the watermark are dropped."""
    home = run_late(spark, sf)
    return opened(spark.read.parquet(f"{home}/windows"), "user_id")


@query
def stream_late_rows(spark, sf):
    """What the log of the same query says: rows and late rows of every micro-batch that had rows."""
    home = run_late(spark, sf)
    log = spark.read.parquet(f"{home}/log").filter("run = 'late'")
    batch, name = F.split("metric", "/")[0].cast("long").alias("batch"), F.split("metric", "/")[1]
    rows = log.groupBy(batch).agg(*[F.max(F.when(name == c, F.col("value").cast("long"))).alias(c) for c in ("rows", "late_rows")])
    return rows.filter("rows > 0")


@query
def stream_late_verdicts(spark, sf):
    """Decisions of a fixed model as one stream, an expert's verdicts as another one that comes later."""
    home = scratch_path(spark, "stream")
    s, n, params = setup(spark, sf, "U", hard=HARD)
    decided = replay_online(s, initialize(s, params, n=n), params, adapt=False, n=n).windows.select(*DECISION)
    at = F.timestamp_seconds((F.col("w") + 1) * 600)  # a watermark starts at 0
    decided = save(decided.withColumn("time", at), "decided")
    online = win.assign_windows(index.read_online(s, params.init_rows), L, n - params.init_rows).filter(F.col("x")[0] > 220).select("w").distinct()
    verdicts = save(online.select("w", F.lit(True).alias("is_anomaly"), (at + F.make_dt_interval(hours=F.col("w") % LAGS)).alias("given")), "verdicts")
    last = F.timestamp_seconds(F.lit(4_000_000_000))
    # Both streams in four files in the order of time, and a far later row that closes them.
    for name, rows, time in (("decided", decided, "time"), ("verdicts", verdicts, "given")):
        top = rows.agg(F.max(F.unix_seconds(time))).first()[0] or 0
        for part in range(4):
            rows.filter(F.floor(F.unix_seconds(time) * 4 / (top + 1)) == part).coalesce(1).write.parquet(f"{home}/{name}/file={part}")
        closing = spark.range(1).select(*[(F.lit(-1) if c == "w" else last if c == time else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes])
        closing.write.parquet(f"{home}/{name}/file=4")
    left, right = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/{name}/file=*") for name, rows in (("decided", decided), ("verdicts", verdicts)))
    with settings(spark, shuffle__partitions=str(STATE_PARTITIONS)):
        run_to_end(write_stream(attach_late_verdicts(left, right, f"{IN_TIME} HOURS"), home, "attached"), f"{home}/checkpoint")
    return settled(spark.read.parquet(f"{home}/attached").filter("w >= 0").drop("time")).select(*DECISION)


@query
def stream_positions(spark, sf):
    """The prepared series as a stream of positions, stopped after its first step and taken up again."""
    home = scratch_path(spark, "stream")
    s, n, params = setup(spark, sf, "U", hard=HARD)
    model = initialize(s, params, n=n)
    index.read_online(s, params.init_rows).select("idx", "x", "is_anomaly").write.parquet(f"{home}/series")
    batches = max(1, (n - params.init_rows) // (L * B))
    spark.dataSource.register(SeriesSource)

    def writer():
        source = spark.readStream.format("series").option("path", f"{home}/series").option("progress", f"{home}/progress/at.json")
        source = source.option("step", L * B * -(-batches // 4)).load()
        rows = stream_online(source, model, params, ["idx"], f"{home}/run", f"{home}/decisions", adapt=False)
        return rows.option("checkpointLocation", f"{home}/checkpoint")

    writer().trigger(availableNow=True).start().awaitTermination()  # one step
    rest = writer().start()
    try:
        for _ in range(2):  # the source first hands out once more what it did last
            rest.processAllAvailable()
    finally:
        rest.stop()
    return spark.read.parquet(f"{home}/decisions").select(*DECISION)


@query
def refresh_error_model(spark, sf):
    """Mean and covariance of the errors, merged from moments that were stored part by part."""
    windows, split = windows_of(spark, sf, "M")
    profile = Profile.fit(windows.filter(split.where("sn")), (L, WIDTH["M"]))
    errors = reconstruction_errors(windows.filter(split.where("vn1")), profile)
    home = scratch_path(spark, "moments")
    for part in range(3):  # as micro-batches leave them
        moment_rows(error_rows(errors.filter(F.col("w") % 3 == part)), WIDTH["M"]).write.parquet(f"{home}/micro={part}")
    merged = merge_moments(spark.read.parquet(home).drop("micro"), WIDTH["M"])
    rows = [(i, j, merged.mu[i], v) for i, r in enumerate(merged.sigma) for j, v in enumerate(r) if i <= j]
    return spark.createDataFrame(rows, "i int, j int, mu double, sigma double")
