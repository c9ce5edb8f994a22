"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.streams import (
    HARD, LENGTH, MEASURES, PER_BATCH, WIDTH, fitted, raw_stream, scored, series, table, tidy, vector, whole, windows_of,
)
from tidewatch.functions.scratch import save, scratch_path
from tidewatch.models.base import Model, reconstruct, reconstruction_errors, score
from tidewatch.models.profile import Profile, cell_means
from tidewatch.operators import buffers, checks, errors, evaluate, index, labels, project, sampling, scale, split as splits
from tidewatch.operators import threshold as thresholds
from tidewatch.operators import windows as win
from tidewatch.plans.initialize import init_windows, initialize
from tidewatch.plans.online import DECISION, replay_online, update_report
from tidewatch.plans.prepare import prepare_forest, prepare_power, prepare_services
from tidewatch.sources.models import load_model, save_model, train_metrics
from tidewatch.sources.series import parse_column_kinds, read_series, series_schema, spread_vector, write_series
from tidewatch.streaming.online import stream_online
from tidewatch.streaming.windows import count_windows_stream, parquet_windows

L, B = LENGTH, PER_BATCH
# batches of false alarms that make an update due in the adaptive runs, as for the published series of one feature
CAPACITY = 9
QUERIES: dict[str, object] = {}


def query(f):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return tidy(f(spark, sf))

    QUERIES[f.__name__] = run
    return f


def init_rows(n: int) -> int:
    """60 % of the windows."""
    return n // L * 6 // 10 * L


def with_threshold(spark, sf, stream):
    """Scored windows and a calibrated model over the whole stream."""
    windows, split, model = scored(spark, sf, stream)
    found = thresholds.find_threshold(windows, split, B)
    model = Model(model.reconstructor, errors.ErrorModel(model.errors.mu, model.errors.sigma, found))
    return windows, split, model


def flagged(spark, sf, stream, hard=1):
    windows, _, model = with_threshold(spark, sf, stream)
    decided = errors.flag_windows(errors.score_windows(windows), model.threshold, hard)
    return win.assign_batches(decided.select("w", "is_anomaly", "score_max", "n_over", "flagged"), B)


# ---- positions


@query
def with_index(spark, sf):
    rows, order = raw_stream(spark, sf, "U")
    return index.with_index(rows.select(*order), order, keep=["event_id"])


@query
def with_index_lineitem(spark, sf):
    rows, order = raw_stream(spark, sf, "M")
    return index.with_index(rows.select(*order), order, keep=order[1:])


def events_index(spark, sf):
    return series(spark, sf, "U", ("event_id",))


@query
def downsample(spark, sf):
    return index.downsample(events_index(spark, sf)[0], 8)


@query
def slice_rows(spark, sf):
    s, n = events_index(spark, sf)
    return index.slice_rows(s, 60, -36, n)


@query
def trim_to_multiple(spark, sf):
    s, n = events_index(spark, sf)
    return index.trim_to_multiple(s, L * B, n)


@query
def read_init(spark, sf):
    s, n = events_index(spark, sf)
    return index.read_init(s, init_rows(n))


@query
def read_online(spark, sf):
    s, n = events_index(spark, sf)
    return index.read_online(s, init_rows(n))


@query
def zip_columns(spark, sf):
    events = table(spark, sf, "events")
    order = ["ts", "event_id"]
    views = index.with_index(events.filter("event_type = 'view'").select(*order, "value"), order, keep=["value"])
    clicks = index.with_index(events.filter("event_type = 'click'").select(*order, "user_id"), order, keep=["user_id"])
    return index.zip_columns(views, clicks)


@query
def ordered_union(spark, sf):
    rows, _ = series(spark, sf, "D", ("event_id", "x"))
    return rows.select("idx", "src_ord", "event_id", F.col("x")[0].alias("value"))


# ---- columns and labels


@query
def filter_eq(spark, sf):
    rows = project.filter_eq(table(spark, sf, "events"), "event_type", "view").select("ts", "event_id")
    return index.with_index(rows, ["ts", "event_id"], keep=["event_id"])


@query
def select_ordinals(spark, sf):
    return project.select_ordinals(table(spark, sf, "lineitem"), [4, 5, 6, 7], label=8)


@query
def select_kinds(spark, sf):
    lines = table(spark, sf, "lineitem").drop("l_shipdate")
    kinds = ["continuous" if t == "double" else "symbolic" for _, t in lines.dtypes]
    return project.select_kinds(lines, kinds)


@query
def parse_column_kinds_text(spark, sf):
    text = F.concat("p_name", F.lit(": symbolic. "), "p_brand", F.lit(": "), "p_type", F.lit(". size: continuous."))
    return parse_column_kinds(table(spark, sf, "part").select("p_partkey", text.alias("value")), keep=["p_partkey"])


QUERIES["parse_column_kinds"] = QUERIES.pop("parse_column_kinds_text")


@query
def canonical_label(spark, sf):
    spelled = F.when(F.col("event_type") == "view", "normal.").when(F.col("event_type") == "click", "normal")
    rows = table(spark, sf, "events").select("event_id", spelled.otherwise(F.col("event_type")).alias("label"))
    return labels.canonical_label(rows).drop("label")


@query
def minority_as_anomaly(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    return labels.minority_as_anomaly(rows)


# ---- windows


def indexed_windows(spark, sf, stream, keep):
    s, n = series(spark, sf, stream, keep)
    return win.assign_windows(s, L, n)


@query
def assign_windows(spark, sf):
    return indexed_windows(spark, sf, "U", ())


@query
def assign_batches(spark, sf):
    rows = indexed_windows(spark, sf, "U", ("is_anomaly",))
    return win.assign_batches(win.window_label(rows).select("w"), B)


@query
def collect_windows(spark, sf):
    rows = indexed_windows(spark, sf, "M", ("x", "is_anomaly",))
    windows = win.collect_windows(rows, L).withColumnRenamed("is_anomaly", "win_anomaly")
    return spread(win.explode_windows(windows, "xs", "flags"), "xs", 4).withColumnRenamed("flags", "is_anomaly")


def spread(rows: DataFrame, column: str, width: int) -> DataFrame:
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, *[F.col(column)[i].alias(f"x{i}") for i in range(width)])


@query
def keyed_windows(spark, sf):
    rows, order = raw_stream(spark, sf, "U")
    keyed = index.with_index(
        rows.select(*order, "user_id", "x", "is_anomaly"), order, by=["user_id"], total="n", keep=["x", "is_anomaly"]
    )
    windows = win.collect_windows(win.assign_windows(keyed, L, "n"), L, by=["user_id"]).drop("is_anomaly")
    steps = win.explode_windows(windows, "xs", "flags", by=["user_id"])
    return steps.select("user_id", "w", "step", F.col("xs")[0].alias("value"), F.col("flags").alias("is_anomaly"))


@query
def window_label(spark, sf):
    return win.window_label(indexed_windows(spark, sf, "M", ("is_anomaly",)))


@query
def partition_normal_anomalous(spark, sf):
    rows = indexed_windows(spark, sf, "U", ("is_anomaly",))
    return win.partition_normal_anomalous(rows).select("idx", "win_anomaly")


@query
def attach_expert_labels(spark, sf):
    rows = indexed_windows(spark, sf, "U", ("event_type", "is_anomaly",))
    verdicts = rows.filter("event_type = 'error'").select("w").distinct().withColumn("is_anomaly", F.lit(True))
    return win.attach_expert_labels(win.window_label(rows).drop("anomalous_rows"), verdicts)


# ---- scaling


@query
def minmax_global(spark, sf):
    s, n = series(spark, sf, "M", ("x",))
    rows = win.assign_windows(scale.minmax_global(s, 4), L, n).drop("idx")
    return spread(rows, "x", 4)


@query
def minmax_window(spark, sf):
    rows = indexed_windows(spark, sf, "M", ("x", "is_anomaly",))
    scaled = scale.minmax_window(win.collect_windows(rows, L), 4)
    return spread(win.explode_windows(scaled, "xs"), "xs", 4)


# ---- subsets


@query
def split_subsets(spark, sf):
    windows, split = windows_of(spark, sf, "M")
    return splits.split_subsets(windows, split).select("w", F.explode("subsets").alias("subset"))


@query
def split_report(spark, sf):
    windows, split = windows_of(spark, sf, "M")
    return splits.split_report(splits.split_subsets(windows, split), L)


@query
def align_row_labels(spark, sf):
    windows, split = windows_of(spark, sf, "U")
    return splits.align_row_labels(windows, split)


@query
def reverse_batches(spark, sf):
    windows, split = windows_of(spark, sf, "U")
    return sampling.reverse_batches(windows.filter(split.where("sn")).select("w"), B)


@query
def shuffle_batches(spark, sf):
    windows, split = windows_of(spark, sf, "U")
    return sampling.shuffle_batches(windows.filter(split.where("vn1")).select("w"), B, seed=7)


# ---- reconstruction, errors, scores


@query
def profile_model(spark, sf):
    windows, split = windows_of(spark, sf, "M")
    return cell_means(windows.filter(split.where("sn")))


def profiled(spark, sf, stream):
    windows, split = windows_of(spark, sf, stream)
    return windows, split, Profile.fit(windows.filter(split.where("sn")), (L, WIDTH[stream]))


@query
def abs_error(spark, sf):
    windows, _, profile = profiled(spark, sf, "M")
    steps = errors.abs_error(reconstruct(windows, profile)).select("w", F.posexplode("errs").alias("step", "_e"))
    return steps.select("w", "step", F.posexplode("_e").alias("dim", "e"))


@query
def mse(spark, sf):
    windows, split, profile = profiled(spark, sf, "M")
    parts = [
        errors.mse(reconstruct(windows.filter(split.where(s)), profile)).select(F.lit(s).alias("subset"), "mse")
        for s in splits.SUBSETS
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def fit_mu(spark, sf):
    windows, split, profile = profiled(spark, sf, "M")
    vn1 = errors.error_rows(reconstruction_errors(windows.filter(split.where("vn1")), profile))
    return spark.createDataFrame(list(enumerate(errors.fit_mu(vn1, 4))), "dim long, mu double")


def sigma_rows(spark, sf, stream):
    _, _, model = fitted(spark, sf, stream)
    cells = [(i, j, v) for i, row in enumerate(model.errors.sigma) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, "i long, j long, sigma double")


@query
def fit_sigma_univariate(spark, sf):
    return sigma_rows(spark, sf, "U")


@query
def fit_sigma_multivariate(spark, sf):
    return sigma_rows(spark, sf, "M")


@query
def fit_sigma_wide(spark, sf):
    return sigma_rows(spark, sf, "E")


def point_scores(spark, sf, stream):
    windows, _, _ = scored(spark, sf, stream)
    return windows.select("w", F.posexplode("scores").alias("step", "score"))


@query
def score_points_univariate(spark, sf):
    return point_scores(spark, sf, "U")


@query
def score_points_multivariate(spark, sf):
    return point_scores(spark, sf, "M")


@query
def score_points_wide(spark, sf):
    return point_scores(spark, sf, "E")


@query
def score_windows(spark, sf):
    windows, _, _ = scored(spark, sf, "M")
    return errors.score_windows(windows).select("w", "score_max")


@query
def window_scores(spark, sf):
    windows, _, _ = scored(spark, sf, "U")
    return errors.score_windows(windows).select("w", "is_anomaly", "score_max")


@query
def flag_windows(spark, sf):
    return flagged(spark, sf, "M", HARD).select("w", "n_over", "flagged")


# ---- threshold


def pools(spark, sf, stream):
    windows, split, _ = scored(spark, sf, stream)
    return save(thresholds.score_pools(windows, split), "pools")


@query
def score_pools(spark, sf):
    return pools(spark, sf, "U")


@query
def threshold_fallback(spark, sf):
    return thresholds.threshold_fallback(pools(spark, sf, "U"))


@query
def threshold_candidates(spark, sf):
    found = thresholds.threshold_candidates(pools(spark, sf, "M"))
    return spark.createDataFrame(list(enumerate(found)), "i long, candidate double")


def evaluated(spark, sf):
    scores = pools(spark, sf, "M")
    return thresholds.evaluate_threshold(scores, thresholds.threshold_candidates(scores))


@query
def evaluate_threshold(spark, sf):
    return evaluated(spark, sf)


@query
def best_threshold(spark, sf):
    return thresholds.best_threshold(evaluated(spark, sf)).select("threshold")


# ---- routing and buffers


@query
def route_window(spark, sf):
    return buffers.route_window(flagged(spark, sf, "M", HARD)).select(
        "w", "to_anom_buf", "to_anom_err", "to_norm_buf", "to_norm_err"
    )


@query
def update_due(spark, sf):
    routed = buffers.route_window(flagged(spark, sf, "M"))
    return buffers.update_due(routed, B, 4).select("batch", "normal_fill", "anomalous_fill", "due")


def anomalous_buffer(spark, sf):
    windows, _ = windows_of(spark, sf, "M")
    return index.with_index(windows.filter("is_anomaly").select("w"), ["w"], idx="rank"), windows


@query
def oversample_by_doubling(spark, sf):
    buffer, windows = anomalous_buffer(spark, sf)
    return buffers.oversample_by_doubling(buffer, windows.count())


@query
def truncate_to_batches(spark, sf):
    return buffers.truncate_to_batches(anomalous_buffer(spark, sf)[0], B)


@query
def buffer_train_val(spark, sf):
    return buffers.buffer_train_val(anomalous_buffer(spark, sf)[0], B)


# ---- evaluation and checks


@query
def roc_curve(spark, sf):
    return evaluate.roc_curve(flagged(spark, sf, "M"))


@query
def auc(spark, sf):
    windows, _, _ = scored(spark, sf, "U")
    return evaluate.auc(errors.score_windows(windows))


@query
def auc_lineitem(spark, sf):
    windows, _, _ = scored(spark, sf, "M")
    return evaluate.auc(errors.score_windows(windows))


@query
def confusion(spark, sf):
    return evaluate.confusion(flagged(spark, sf, "M", HARD))


@query
def dataset_profile(spark, sf):
    parts = []
    for stream in "UME":
        rows, _ = raw_stream(spark, sf, stream)
        parts.append(evaluate.dataset_profile(rows).withColumn("stream", F.lit(stream)))
    drift = raw_stream(spark, sf, "D")[0].filter("event_type IN ('view', 'click')")
    parts.append(evaluate.dataset_profile(drift).withColumn("stream", F.lit("D")))
    return reduce(DataFrame.unionByName, parts)


@query
def row_report(spark, sf):
    return checks.row_report(raw_stream(spark, sf, "M")[0], WIDTH["M"])


@query
def to_vector(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", *MEASURES)
    made = project.to_vector(rows, MEASURES)
    return made.select("l_orderkey", "l_partkey", "l_suppkey", F.posexplode("x").alias("dim", "value"))


@query
def read_series_back(spark, sf):
    """The line items as headerless CSV files, read again in file order."""
    home = scratch_path(spark, "csv")
    s, _ = series(spark, sf, "M")
    marked = s.select("idx", "x", F.when(F.col("is_anomaly"), "anomaly.").otherwise("normal.").alias("label"))
    write_series(spread_vector(marked, WIDTH["M"]), home)
    return labels.canonical_label(read_series(spark, home, series_schema(WIDTH["M"]))).drop("label")


@query
def load_model_scores(spark, sf):
    """A model stored, loaded, and applied."""
    windows, _, model = fitted(spark, sf, "U")
    home, params = scratch_path(spark, "models"), whole("U", 0)
    save_model(spark, model, home, params)
    scores = errors.score_windows(score(windows, load_model(spark, home, params)))
    return scores.select("w", "is_anomaly", "score_max")


@query
def check_nulls(spark, sf):
    return checks.check_nulls(raw_stream(spark, sf, "M")[0])


# ---- whole jobs


@query
def prepare_power_series(spark, sf):
    events = table(spark, sf, "events").select("ts", "event_id", "value", "event_type")
    data = index.with_index(events, ["ts", "event_id"], keep=["value"])
    backwards = index.with_index(events, [F.desc("ts"), "event_id"], keep=["event_type"])
    backwards = backwards.withColumnRenamed("event_type", "label")
    return prepare_power(data, index.slice_rows(index.downsample(backwards, 8), 60, -36))


QUERIES["prepare_power"] = QUERIES.pop("prepare_power_series")


@query
def prepare_service_series(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value", "props")
    raw = index.with_index(events, ["ts", "event_id"])
    kinds = ["symbolic", "symbolic", "symbolic", "continuous"]
    made = prepare_services(raw, kinds, services=("view", "click"))
    return reduce(DataFrame.unionByName, [df.withColumn("series", F.lit(name)) for name, df in made.items()])


QUERIES["prepare_services"] = QUERIES.pop("prepare_service_series")


@query
def prepare_forest_series(spark, sf):
    rows, order = raw_stream(spark, sf, "M")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *MEASURES, "l_shipdate", "l_returnflag")
    return prepare_forest(index.with_index(lines, order), [4, 5, 6, 7], None)


QUERIES["prepare_forest"] = QUERIES.pop("prepare_forest_series")


def setup(spark, sf, stream, **changes):
    """The series, its length, and parameters that initialize on 60 % of it."""
    s, n = series(spark, sf, stream)
    return s, n, whole(stream, init_rows(n)).but(**changes)


def a_few_updates(spark, sf, stream):
    """As ``setup``, with a buffer that fills several times on the way."""
    s, n, params = setup(spark, sf, stream)
    return s, n, params.but(capacity=CAPACITY)


def fixed_replay(spark, sf, stream):
    s, n, params = setup(spark, sf, stream, hard=HARD)
    return replay_online(s, initialize(s, params, n=n), params, adapt=False, n=n).windows


@query
def replay_fixed(spark, sf):
    return fixed_replay(spark, sf, "U").drop("version")


@query
def replay_fixed_lineitem(spark, sf):
    return fixed_replay(spark, sf, "M").drop("version")


@query
def replay_fixed_auc(spark, sf):
    return evaluate.auc(fixed_replay(spark, sf, "M"))


@query
def replay_adaptive(spark, sf):
    s, n, params = a_few_updates(spark, sf, "D")
    return replay_online(s, initialize(s, params, n=n), params, n=n).windows


@query
def replay_adaptive_events(spark, sf):
    s, n, params = a_few_updates(spark, sf, "U")
    return replay_online(s, initialize(s, params, n=n), params, n=n).windows


@query
def replay_adaptive_lineitem(spark, sf):
    s, n, params = a_few_updates(spark, sf, "M")
    return replay_online(s, initialize(s, params, n=n), params.but(capacity=50), n=n).windows


@query
def replay_adaptive_lstm(spark, sf):
    s, n, params = a_few_updates(spark, sf, "D")
    params = params.but(kind="lstm")
    return replay_online(s, initialize(s, params, n=n), params, n=n).windows


@query
def replay_adaptive_rows(spark, sf):
    """What every window of an adaptive run is known by, whatever the versions decide."""
    s, n, params = a_few_updates(spark, sf, "U")
    return replay_online(s, initialize(s, params, n=n), params, n=n).windows.select("w", "batch", "is_anomaly")


@query
def update_losses(spark, sf):
    """Losses of every epoch of every version: trained on, kept out, and of anomalous windows."""
    s, n, params = a_few_updates(spark, sf, "D")
    params, root = params.but(kind="lstm", watch_updates=True), scratch_path(spark, "models")
    replay_online(s, initialize(s, params, root=root, n=n), params, root=root, n=n)
    return train_metrics(spark, root, params)


@query
def run_log_rows(spark, sf):
    """What a run writes about itself, read back; its seconds only as a mark that they are there."""
    s, n, params = setup(spark, sf, "M")
    log = scratch_path(spark, "log")
    replay_online(s, initialize(s, params, n=n), params, adapt=False, n=n, log=log, run="night")
    value = F.when(F.col("metric") != "seconds", F.round(F.col("value").cast("double"), 6))
    return spark.read.parquet(log).select("run", "metric", value.alias("value"))


@query
def replay_with_labels(spark, sf):
    """Verdicts of an expert, several a window, in place of the labels of the rows."""
    s, n, params = setup(spark, sf, "U", hard=HARD)
    online = win.assign_windows(index.read_online(s, params.init_rows), L, n - params.init_rows)
    verdicts = online.select("w", (F.col("x")[0] > 220).alias("is_anomaly"))
    done = replay_online(s, initialize(s, params, n=n), params, adapt=False, n=n, labels=verdicts)
    return done.windows.drop("version")


def model_scores(spark, sf, stream, **changes):
    s, n = series(spark, sf, stream)
    params = whole(stream, n).but(**changes)
    model = initialize(s, params, n=n)
    windows = init_windows(s, params, n, model.bounds)
    return errors.score_windows(score(windows, model)).select("w", "is_anomaly", "score_max")


@query
def pca_scores(spark, sf):
    return model_scores(spark, sf, "M", kind="pca", hidden=4)


@query
def lstm_scores(spark, sf):
    return model_scores(spark, sf, "U", kind="lstm", hidden=8)


@query
def lstm_scores_lineitem(spark, sf):
    return model_scores(spark, sf, "M", kind="lstm", hidden=8)


@query
def adaptation_report(spark, sf):
    s, n, params = a_few_updates(spark, sf, "D")
    return update_report(s, initialize(s, params, n=n), params, n)


@query
def adaptation_report_events(spark, sf):
    s, n, params = a_few_updates(spark, sf, "U")
    return update_report(s, initialize(s, params, n=n), params, n)


# ---- streams


def run_to_end(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def streamed(spark, sf, by):
    """The event table as a file stream, cut into count windows."""
    home = scratch_path(spark, "stream")
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = source.select(*by, "ts", "event_id", vector("value"), (F.col("value") > 200).alias("is_anomaly"))
    sink = parquet_windows(f"{home}/windows")
    run_to_end(count_windows_stream(rows, L, ["ts", "event_id"], f"{home}/state", sink, by=by), f"{home}/checkpoint")
    windows = spark.read.parquet(f"{home}/windows").drop("is_anomaly")
    steps = win.explode_windows(windows, "xs", "flags", by=by)
    return steps.select(*by, "w", "step", F.col("xs")[0].alias("value"), F.col("flags").alias("is_anomaly"))


@query
def stream_windows(spark, sf):
    return streamed(spark, sf, [])


@query
def stream_keyed_windows(spark, sf):
    return streamed(spark, sf, ["user_id"])


def online_stream(spark, sf, stream, adapt):
    """Initialization in batch, the rest of the stream as a continuous query."""
    home = scratch_path(spark, "stream")
    s, n, params = a_few_updates(spark, sf, stream)
    params = params if adapt else params.but(hard=HARD)
    model = initialize(s, params, n=n)
    rest = index.read_online(s, params.init_rows)
    rest.write.parquet(f"{home}/rows")
    source = spark.readStream.schema(rest.schema).parquet(f"{home}/rows")
    writer = stream_online(source, model, params, ["idx"], f"{home}/run", f"{home}/decisions", adapt)
    run_to_end(writer, f"{home}/checkpoint")
    return spark.read.parquet(f"{home}/decisions").drop("micro")


@query
def stream_scores(spark, sf):
    return online_stream(spark, sf, "U", False).select(*DECISION)


@query
def stream_adaptive(spark, sf):
    return online_stream(spark, sf, "D", True)


@query
def stream_adaptive_rows(spark, sf):
    """The adaptive stream over all events, and what every window is known by."""
    return online_stream(spark, sf, "U", True).select("w", "batch", "is_anomaly")
