"""Versioned model table and run metrics."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.models import KINDS
from tidewatch.models.base import Model
from tidewatch.operators.errors import ErrorModel

_SCHEMA = (
    "version long, kind string, length int, width int, hidden int, numbers array<double>, mu array<double>, "
    "sigma array<array<double>>, threshold double, low array<double>, high array<double>, "
    "history array<struct<epoch:int,loss:double,val_loss:double,anomalous_loss:double>>, optimizer array<double>"
)


def _home(root: str, params) -> str:
    return f"{root.rstrip('/')}/B={params.per_batch}/H={params.hidden}/L={params.length}"


def save_model(spark: SparkSession, model: Model, root: str, params) -> None:
    save_models(spark, [model], root, params)


def save_models(spark: SparkSession, models: Sequence[Model], root: str, params) -> None:
    """One row per version, in a folder of its own: writing a version twice leaves one copy."""
    rows = spark.createDataFrame([_row(m, params) for m in models], _SCHEMA).coalesce(1).withColumn("v", F.col("version"))
    # only the folders of these versions are replaced
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("v").parquet(_home(root, params))


def _row(model: Model, params) -> tuple:
    rec, err = model.reconstructor, model.errors
    low, high = model.bounds or (None, None)
    return (
        model.version, rec.kind, rec.length, rec.width, params.hidden, rec.parameters(),
        [float(m) for m in err.mu], [[float(v) for v in r] for r in err.sigma], err.threshold, low, high,
        [(int(h[0]), *(None if v is None else float(v) for v in (*h[1:], None, None)[:3])) for h in model.history],
        None if getattr(rec, "optimizer", None) is None else rec.optimizer.tolist(),
    )


def model_table(spark: SparkSession, root: str, params) -> DataFrame:
    """All stored versions."""
    return spark.read.schema(_SCHEMA).parquet(f"{_home(root, params)}/v=*")


def load_model(spark: SparkSession, root: str, params, version: int | str = "latest") -> Model:
    table = model_table(spark, root, params)
    if version != "latest":
        table = table.filter(F.col("version") == version)
    row = table.orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"no model of version {version} under {root}")
    trained = {} if row["optimizer"] is None else {"optimizer": row["optimizer"]}
    rec = KINDS[row["kind"]].restore(row["length"], row["width"], row["hidden"], row["numbers"], **trained)
    errors = ErrorModel(list(row["mu"]), [list(r) for r in row["sigma"]], row["threshold"])
    bounds = (list(row["low"]), list(row["high"])) if row["low"] is not None else None
    return Model(rec, errors, row["version"], bounds, [tuple(h) for h in row["history"]])


def train_metrics(spark: SparkSession, root: str, params) -> DataFrame:
    """(version, epoch, loss, val_loss, anomalous_loss) of every stored version; losses that were not measured are null."""
    return model_table(spark, root, params).select("version", F.inline("history"))


def write_run_log(spark: SparkSession, rows: list[tuple[str, object]], path: str, run: str) -> None:
    """Append (run, at, metric, value) rows to a metrics table."""
    now = datetime.now(timezone.utc)
    data = [(run, now, name, json.dumps(value)) for name, value in rows]
    spark.createDataFrame(data, "run string, at timestamp, metric string, value string").coalesce(1).write.mode(
        "append"
    ).parquet(path)
