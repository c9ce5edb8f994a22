"""Initialization: split, fit, calibrate."""

from __future__ import annotations

import time
import warnings

from pyspark.sql import DataFrame

from tidewatch.functions.scratch import save
from tidewatch.models import KINDS
from tidewatch.models.base import Model, reconstruction_errors, score
from tidewatch.operators.checks import inspect, require_nonempty
from tidewatch.operators.errors import ErrorModel, error_rows, fit_error_model
from tidewatch.operators.index import count_rows, read_init
from tidewatch.operators.sampling import shuffle_batches
from tidewatch.operators.scale import minmax_global, minmax_window
from tidewatch.operators.split import SUBSETS, Split, fit_split
from tidewatch.operators.threshold import find_threshold
from tidewatch.operators.windows import assign_windows, collect_windows
from tidewatch.plans.params import Params
from tidewatch.sources.models import save_model, write_run_log


def init_windows(series: DataFrame, params: Params, n: int | None = None, bounds=None) -> DataFrame:
    """Scaled windows of the initialization rows, written once: every later step scans them."""
    init = read_init(series, params.init_rows)
    n = min(count_rows(series) if n is None else n, params.init_rows)
    if params.scale_init == "global":
        init = minmax_global(init, params.width, bounds=bounds)
    windows = collect_windows(assign_windows(init, params.length, n), params.length, ordered=True)
    if params.scale_init == "window":
        windows = minmax_window(windows, params.width)
    return save(windows, "init-windows")


def calibrate(windows: DataFrame, split: Split, reconstructor, params: Params) -> ErrorModel:
    """Error distribution from vn1, then the threshold from vn2 and va."""
    vn1 = windows.filter(split.where("vn1"))
    if params.sample == "drop_remainder":
        vn1 = shuffle_batches(vn1, params.per_batch, params.seed)
    fitted = fit_error_model(error_rows(reconstruction_errors(vn1, reconstructor)), params.width)
    pool = windows.filter(split.where("vn2") | split.where("va"))
    scored = score(pool, Model(reconstructor, fitted), params.metric)
    threshold = find_threshold(
        scored, split, params.per_batch, params.beta, params.objective, params.drop_partial_batch
    )
    return ErrorModel(fitted.mu, fitted.sigma, threshold)


def initialize(
    series: DataFrame,
    params: Params,
    root: str | None = None,
    log: str | None = None,
    run: str = "init",
    n: int | None = None,
) -> Model:
    """Fit a model on the first rows of an indexed series (idx, x, is_anomaly) of ``n`` rows."""
    started = time.time()
    spark = series.sparkSession
    bounds = inspect(read_init(series, params.init_rows), params.width)
    n = count_rows(series) if n is None else n
    windows = init_windows(series, params, n, bounds)
    split = fit_split(windows)
    notes = require_nonempty(split, params.per_batch, params.init_rows, n, params.length, params.capacity)
    for note in notes:
        warnings.warn(note, stacklevel=2)
    reconstructor = KINDS[params.kind].fit(
        windows.filter(split.where("sn")),
        hidden=params.hidden,
        validation=windows.filter(split.where("tn")),
        per_batch=params.per_batch,
        max_epochs=params.max_epochs,
        patience=params.patience,
        min_delta=params.min_delta,
        shards=params.shards,
        seed=params.seed,
        shape=(params.length, params.width),
    )
    errors = calibrate(windows, split, reconstructor, params)
    model = Model(
        reconstructor, errors, 0, bounds if params.scale_init == "global" else None, list(getattr(reconstructor, "history", ()))
    )
    if root:
        save_model(spark, model, root, params)
    if log:
        rows = [(f"windows_{s}", split.sizes[s]) for s in SUBSETS]
        rows += [(f"rows_{s}", split.sizes[s] * params.length) for s in SUBSETS]
        rows += [("epochs", len(model.history)), ("threshold", errors.threshold), ("notes", notes)]
        rows += [("per_batch", params.per_batch), ("hidden", params.hidden), ("length", params.length)]
        write_run_log(spark, rows + [("seconds", time.time() - started)], log, run)
    return model
