"""Parameters of a run, shared by all phases."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    length: int  # rows per window
    per_batch: int  # windows per batch
    hidden: int  # size of the model's code
    width: int  # features
    init_rows: int
    hard: int  # points over the threshold that make a window anomalous
    capacity: int  # batches of false alarms that trigger an update
    kind: str = "lstm"
    metric: str = "cov"
    objective: str = "as_written"
    beta: float = 0.5
    scale_init: str = "global"
    scale_online: str = "window"
    drop_partial_batch: bool = False
    sample: str = "all"  # "drop_remainder": shuffle vn1 into full batches before fitting mu and sigma
    max_epochs: int = 6
    patience: int = 20
    min_delta: float = 1e-4
    update_epochs: int = 300
    update_patience: int = 10
    update_min_delta: float = 0.005
    stop_metric: str = "last_batch"
    refresh_threshold: bool = False
    rescore_errors: bool = False
    watch_updates: bool = False  # an update's history has the losses of its last normal batch and of the anomalous windows, by epoch
    shards: int = 8  # parts of the training batches that are walked side by side in an epoch of the first fit
    update_shards: int = 1  # the same at an update
    seed: int = 0
    look_ahead: int | None = None  # batches scored before first looking for a due update; None: as many as it takes at least

    def but(self, **changes) -> "Params":
        return replace(self, **changes)


# fixed values: settings of the published datasets
#                  L   B   H   d   N0           hard  capacity
_DATASETS = {
    "power": (84, 8, 15, 1, 84 * 12, 5, 9),
    "smtp": (10, 8, 15, 34, 10 * 6000, 5, 50),
    "http": (30, 8, 35, 34, 30 * 30000, 5, 1000),
    "smtphttp": (10, 8, 15, 34, 10 * 2500, 5, 1500),
    "forest": (10, 8, 25, 7, 10 * 10000, 4, 400),
}


def params(dataset: str, **changes) -> Params:
    if dataset not in _DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}, known are {sorted(_DATASETS)}")
    length, per_batch, hidden, width, init_rows, hard, capacity = _DATASETS[dataset]
    return Params(length, per_batch, hidden, width, init_rows, hard, capacity, **changes)
