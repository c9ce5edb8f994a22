"""Online phase over a bounded series, with adaptation.

Weights change only when an update is due, so windows are scored in parallel with the
present version as far as that version reaches: a stretch of batches is scored, buffer
growth is summed per batch, and the first batch where an update is due ends the version.
Scores after that batch are discarded and the next version goes on from there.  Where versions
are short, ``plans.walk`` makes many of them in one job.  The result is the same as handling one batch after the other.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scratch import save, scratch_path
from tidewatch.models.base import Model, reconstruction_errors, score
from tidewatch.operators.buffers import (
    buffer_train_val, oversample_by_doubling, route_window, truncate_to_batches, update_due,
)
from tidewatch.operators.checks import guard_rows
from tidewatch.operators.errors import (
    ErrorModel, error_rows, fit_error_model, flag_windows, merge_moments, moment_rows, score_points, score_windows,
)
from tidewatch.operators.evaluate import auc
from tidewatch.operators.index import count_rows, index_and_count, read_online
from tidewatch.operators.threshold import point_pools, search_threshold
from tidewatch.operators.windows import assign_batches, assign_windows, attach_expert_labels, collect_windows
from tidewatch.plans.params import Params
from tidewatch.plans.walk import LEG_UPDATES, buffered_since, leg_batches, walk, walkable
from tidewatch.sources.models import save_models, write_run_log

# Up to this many batches (one row each) are summed up in one task.
ONE_TASK_BATCHES = 1 << 20
DECISION = ["w", "batch", "is_anomaly", "score_max", "n_over", "flagged"]
DECISION_SCHEMA = "w long, batch long, is_anomaly boolean, score_max double, n_over int, flagged boolean"


@dataclass
class Buffered:
    """Windows buffered since the last update."""

    normal: int = 0
    anomalous: int = 0


@dataclass(frozen=True)
class Advance:
    """Where a run over some batches ended."""

    segments: list[tuple[int, int, int, int]]  # stretch, version, first batch, last batch
    versions: list[Model]
    buffered: Buffered
    since: int  # first batch of the present version


@dataclass(frozen=True)
class Replay:
    """Committed window results and the versions that made them."""

    windows: DataFrame
    segments: list[tuple[int, int, int, int]]  # stretch, version, first batch, last batch
    versions: list[Model] = field(default_factory=list)

    @property
    def updates(self) -> int:
        return self.versions[-1].version - self.versions[0].version

    def auc(self) -> float | None:
        return auc(self.windows).first()["auc"]


def online_windows(series: DataFrame, params: Params, n: int | None = None, ordered: bool = False) -> DataFrame:
    """Batched windows of the rows after initialization; the tail that fills no batch is dropped."""
    rest = guard_rows(read_online(series, params.init_rows), params.width)
    n = max((count_rows(series) if n is None else n) - params.init_rows, 0)
    batch_rows = params.length * params.per_batch
    kept = assign_windows(rest, params.length, n // batch_rows * batch_rows)
    return assign_batches(collect_windows(kept, params.length, ordered=ordered), params.per_batch)


def decide(windows: DataFrame, model: Model, params: Params, keep_errors: bool = False) -> DataFrame:
    """Scores, flag and routing of every window under one model version.  Narrow."""
    scored = score(windows, model, params.metric, params.scale_online == "window", keep_errors)
    return route_window(flag_windows(score_windows(scored), model.threshold, params.hard))


def first_due(
    decided: DataFrame, params: Params, buffered: Buffered, batches: int
) -> tuple[int | None, Buffered]:
    """First of ``batches`` batches after which an update is due, and the fill then (or at the end)."""
    marked = update_due(
        decided, params.per_batch, params.capacity, buffered.normal, buffered.anomalous,
        one_task=batches <= ONE_TASK_BATCHES,
    )
    row = marked.agg(
        F.expr("min(batch) FILTER (WHERE due) AS cut"),
        F.expr("coalesce(min(normal_fill) FILTER (WHERE due), max(normal_fill)) AS normal"),
        F.expr("coalesce(min(anomalous_fill) FILTER (WHERE due), max(anomalous_fill)) AS anomalous"),
    ).first()
    return row["cut"], Buffered(row["normal"], row["anomalous"])


def update_model(
    model: Model,
    rows: DataFrame,
    moments: DataFrame | None,
    params: Params,
    buffered: Buffered,
) -> Model:
    """Next version: refit on buffered false alarms, and replace mu and sigma.

    ``rows`` and ``moments`` are those of ``buffer_rows`` since the last update: the scaled windows (w, xs) of the
    false alarms, and the moments of the errors of all expert-normal windows, from which
    mu and sigma follow exactly.  ``watch_updates``, ``rows`` has the anomalous windows too: repeated until they fill a batch,
    whole batches of them are the second set whose loss is measured after every epoch.  If errors are made anew or the threshold is searched again, ``rows`` has
    the errors of all windows instead.
    """
    ranked, n = index_and_count(rows.filter("to_norm_buf").select("w", "xs"), ["w"], "rank")
    roles = buffer_train_val(ranked, params.per_batch, n=n)
    train = roles.filter(F.col("role") == "train") if n // params.per_batch > 1 else roles
    reconstructor = model.reconstructor.refit(
        train,
        per_batch=params.per_batch,
        max_epochs=params.update_epochs,
        patience=params.update_patience,
        min_delta=params.update_min_delta,
        stop_metric=params.stop_metric,
        validation=roles.filter(F.col("role") == "val"),
        shards=params.update_shards,
        anomalous=anomalous_batches(rows.filter("is_anomaly"), params.per_batch) if params.watch_updates else None,
    )
    threshold = model.threshold
    if moments is not None:
        fitted = merge_moments(moments, params.width)
    else:
        normal_errors, anomalous = rows.filter("to_norm_err"), rows.filter("to_anom_err")
        if params.rescore_errors:
            normal_errors = reconstruction_errors(normal_errors.drop("errs"), reconstructor)
            anomalous = reconstruction_errors(anomalous.drop("errs"), reconstructor)
        fitted = fit_error_model(error_rows(normal_errors), params.width)
    if params.refresh_threshold:
        scored = score_points(normal_errors.unionByName(anomalous), fitted, params.metric)
        threshold = search_threshold(
            point_pools(scored, F.col("is_anomaly")), buffered.anomalous < params.per_batch, params.beta, params.objective
        )
    return Model(
        reconstructor,
        ErrorModel(fitted.mu, fitted.sigma, threshold),
        model.version + 1,
        model.bounds,
        list(getattr(reconstructor, "history", ())),
    )


def anomalous_batches(rows: DataFrame, per_batch: int) -> DataFrame | None:
    """Whole batches of the buffered anomalous windows, repeated if they are fewer than a batch; None without any."""
    ranked, n = index_and_count(rows.select("w", "xs"), ["w"], "rank")
    if n == 0:
        return None
    return truncate_to_batches(oversample_by_doubling(ranked, per_batch, n=n), per_batch)


def advance(
    windows: DataFrame,
    begin: int,
    last: int,
    model: Model,
    params: Params,
    results: str,
    adapt: bool = True,
    buffered: Buffered | None = None,
    stored: tuple[DataFrame, DataFrame | None] | None = None,
    on_update: Callable[[list[Model]], None] = lambda models: None,
) -> Advance:
    """Decide batches ``begin..last`` of a window table, moving to new versions where they are due.

    Decisions are written under ``results``, one folder per stretch or leg.  ``buffered`` and
    ``stored`` are the counts, and the rows and moments buffered earlier under the present version.

    A new version starts with a leg of ``plans.walk``; if it outlives that, stretches of doubling length are scored in parallel until it ends.
    """
    spark = windows.sparkSession
    segments: list[tuple[int, int, int, int]] = []
    versions, buffered = [model], buffered or Buffered()
    since, stretch, folders = begin, _first_stretch(params, buffered), 0
    walks = can_walk = adapt and walkable(model, params)
    walks = walks and stored is None and buffered == Buffered()
    while begin <= last:
        path, folders = f"{results}/stretch={folders}", folders + 1
        if walks:
            end = min(begin + leg_batches(params) - 1, last)
            found = walk(windows.filter(F.col("batch").between(begin, end)), model, params, path)
            for cut, newer in found:
                segments.append((folders - 1, model.version, begin, cut))
                model, begin = newer, cut + 1
            versions += [m for _, m in found]
            if found:
                on_update([m for _, m in found])
            since = begin
            if found and (end < last or len(found) == LEG_UPDATES):
                continue  # what the leg decided after its last update is decided once more
            if begin <= end:
                segments.append((folders - 1, model.version, begin, end))
                decided = spark.read.schema(DECISION_SCHEMA).parquet(path).filter("w IS NOT NULL")
                buffered = Buffered(*buffered_since(decided, begin))
            begin, stretch, walks = end + 1, 2 * leg_batches(params), False
            continue
        end = min(begin + stretch - 1, last) if adapt else last
        part = windows.filter(F.col("batch").between(begin, end))
        decided = decide(part, model, params).select(*DECISION, F.lit(model.version).alias("version"))
        decided.write.mode("overwrite").parquet(path)
        cut = None
        if adapt:
            decided = route_window(spark.read.schema(DECISION_SCHEMA).parquet(path))
            cut, buffered = first_due(decided, params, buffered, end - begin + 1)
        segments.append((folders - 1, model.version, begin, end if cut is None else cut))
        if cut is None:
            begin, stretch = end + 1, stretch * 2
            continue
        # The buffers are the windows of this version's batches, scored once more with their errors kept.
        mine, moments = buffer_rows(windows.filter(F.col("batch").between(since, cut)), model, params)
        mine = save(mine, "buffered")
        if stored is not None:
            mine = stored[0].unionByName(mine)
            moments = moments if moments is None else stored[1].unionByName(moments)
        model = update_model(model, mine, moments, params, buffered)
        versions.append(model)
        on_update([model])
        begin = since = cut + 1
        buffered, stored, walks = Buffered(), None, can_walk
        stretch = _first_stretch(params, buffered)
    return Advance(segments, versions, buffered, since)


def _first_stretch(params: Params, buffered: Buffered) -> int:
    """Batches to decide before an update can be due: each brings one batch of false alarms at most.

    Stretches double after that, so at most about half of what is scored is beyond the update.
    """
    if params.look_ahead is not None:
        return params.look_ahead
    return max(1, params.capacity - buffered.normal // params.per_batch)


def buffer_rows(windows: DataFrame, model: Model, params: Params) -> tuple[DataFrame, DataFrame | None]:
    """What the next update needs of these windows, and no more: the scaled false alarms (and anomalous windows, if they are watched), and the moments of the errors of normal windows.

    If the update makes errors anew or searches the threshold again, all windows with their errors, and no moments.
    """
    decided = decide(windows, model, params, keep_errors=True)
    rows = decided.select("w", "xs", "errs", "flags", "is_anomaly", "to_norm_buf", "to_norm_err", "to_anom_err")
    if params.rescore_errors or params.refresh_threshold:
        return rows, None
    moments = moment_rows(error_rows(rows.filter("to_norm_err")), params.width)
    if params.watch_updates:
        return rows.filter("to_norm_buf OR is_anomaly").select("w", "xs", "to_norm_buf", "is_anomaly"), moments
    return rows.filter("to_norm_buf").select("w", "xs", "to_norm_buf"), moments


def committed(spark: SparkSession, results: str, segments: list[tuple[int, int, int, int]]) -> DataFrame:
    """Decisions up to the end of every stretch; what was scored beyond an update is left out."""
    if not segments:
        return spark.createDataFrame([], DECISION_SCHEMA).withColumn("version", F.lit(0))
    ends = {stretch: last for stretch, _, _, last in segments}
    table = pa.table({"stretch": pa.array(ends.keys(), pa.int32()), "last": pa.array(ends.values(), pa.int64())})
    decided = spark.read.schema(f"{DECISION_SCHEMA}, version int, stretch int").option("basePath", results).parquet(results).filter("w IS NOT NULL")
    # one row per stretch: updates or legs, plus doublings
    joined = decided.join(F.broadcast(spark.createDataFrame(table)), "stretch")
    return joined.filter(F.col("batch") <= F.col("last")).select(*DECISION, "version")


def replay_online(
    series: DataFrame,
    model: Model,
    params: Params,
    adapt: bool = True,
    root: str | None = None,
    log: str | None = None,
    run: str = "online",
    n: int | None = None,
    labels: DataFrame | None = None,
) -> Replay:
    """Score the rows after initialization, updating the model on the way if ``adapt``.

    ``labels`` (``w``, ``is_anomaly``) are an expert's verdicts on the online windows, in place of those of the rows.
    """
    started = time.time()
    spark = series.sparkSession
    n = count_rows(series) if n is None else n
    batches = max(n - params.init_rows, 0) // (params.length * params.per_batch)
    windows = online_windows(series, params, n, ordered=adapt)
    if labels is not None:
        windows = attach_expert_labels(windows, labels)
    if adapt:
        # in the order of windows: every stretch reads its own part of the table
        windows = save(windows if labels is None else windows.repartitionByRange("w"), "online-windows")
    results = scratch_path(spark, "decisions")
    store = (lambda models: save_models(spark, models, root, params)) if root else (lambda models: None)
    done = advance(windows, 0, batches - 1, model, params, results, adapt, on_update=store)
    replay = Replay(committed(spark, results, done.segments), done.segments, done.versions)
    if log:
        rows = [("updates", replay.updates), ("batches", batches), ("auc", replay.auc())]
        write_run_log(spark, rows + [("seconds", time.time() - started)], log, run)
    return replay


def update_report(series: DataFrame, model: Model, params: Params, n: int | None = None) -> DataFrame:
    """AUC without and with updating, and the number of updates, one row."""
    fixed = replay_online(series, model, params, adapt=False, n=n)
    adapted = replay_online(series, model, params, adapt=True, n=n)
    row = [(fixed.auc(), adapted.auc(), adapted.updates)]
    return series.sparkSession.createDataFrame(row, "auc_without double, auc_with double, updates int")
