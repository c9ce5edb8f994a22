"""Reconstruction errors, their distribution, and anomaly scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.arrow import VECTOR_TYPE, list_column, map_windows, matrix, quadratic_scores, tensor
from tidewatch.functions.vectors import JVM_WIDTH, UNROLL_LIMIT, number, quadratic_score


@dataclass(frozen=True)
class ErrorModel:
    """Mean and spread of the error vectors; ``threshold`` is set once it has been searched."""

    mu: list[float]
    sigma: list[list[float]]
    threshold: float | None = None

    def weight(self, metric: str = "cov") -> list[list[float]]:
        """Matrix of the score: the covariance itself (default), or its pseudo-inverse."""
        if metric == "cov":
            return self.sigma
        if metric == "inv_cov":
            return np.linalg.pinv(np.array(self.sigma)).tolist()
        raise ValueError(f"unknown metric {metric!r}")


def abs_error(windows: DataFrame) -> DataFrame:
    """``errs``: |x - xhat| per step and feature."""
    return windows.withColumn("errs", F.expr("zip_with(xs, xhat, (a, b) -> zip_with(a, b, (u, v) -> abs(u - v)))"))


def mse(windows: DataFrame) -> DataFrame:
    """Mean squared reconstruction error over all cells."""
    squared = F.expr("flatten(zip_with(xs, xhat, (a, b) -> zip_with(a, b, (u, v) -> (u - v) * (u - v))))")
    summed = windows.select(squared.alias("e2")).select(F.expr("aggregate(e2, 0D, (a, v) -> a + v)").alias("s"), F.size("e2").alias("n"))
    return summed.agg((F.sum("s") / F.sum("n")).alias("mse"))


def error_rows(windows: DataFrame) -> DataFrame:
    """One error vector ``e`` per row."""
    return windows.select(F.explode("errs").alias("e"))


def fit_mu(errors: DataFrame, width: int) -> list[float]:
    """Mean error per feature; all features in one aggregate."""
    return list(errors.agg(*[F.expr(f"avg(e[{i}])") for i in range(width)]).first())


def fit_sigma(errors: DataFrame, width: int) -> list[list[float]]:
    """Population variance for one feature, sample covariance matrix for several."""
    return fit_error_model(errors, width).sigma


def fit_error_model(errors: DataFrame, width: int) -> ErrorModel:
    """Mean and spread in one pass over the error rows."""
    if width == 1:
        row = errors.agg(F.expr("avg(e[0]) AS m"), F.expr("var_pop(e[0]) AS v")).first()
        if row["m"] is None:
            raise ValueError("no error rows to fit an error model on")
        return ErrorModel([row["m"]], [[row["v"]]])
    if width > UNROLL_LIMIT:
        mu, sigma = moments(errors, width)
        return ErrorModel(mu.tolist(), sigma.tolist())
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    row = errors.agg(
        *[F.expr(f"avg(e[{i}]) AS m{i}") for i in range(width)],
        *[F.expr(f"covar_samp(e[{i}], e[{j}]) AS c{i}_{j}") for i, j in pairs],
    ).first()
    if row["c0_0"] is None:
        raise ValueError("too few error rows to fit an error model on")
    sigma = np.zeros((width, width))
    for i, j in pairs:
        sigma[i, j] = sigma[j, i] = row[f"c{i}_{j}"]
    return ErrorModel([row[f"m{i}"] for i in range(width)], sigma.tolist())


def moments(errors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of many features (``e``): every partition sends its count, means and cross products.

    Cross products of partitions add up after a correction by their means, so Spark merges
    them per matrix cell; only the finished d x d matrix reaches the driver.
    """
    upper = np.triu_indices(width)

    def parts(batches):
        n, mean, cross = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width)
            if len(x):
                n, mean, cross = with_rows(n, mean, cross, x)
        if n:
            i, j = upper
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(i.astype(np.int32)),
                    pa.array(j.astype(np.int32)),
                    pa.array(np.full(len(i), float(n))),
                    pa.array(mean[i]),
                    pa.array(mean[j]),
                    pa.array(cross[upper]),
                ],
                names=["i", "j", "n", "mi", "mj", "c"],
            )

    n, mi, mj = F.col("n"), F.col("mi"), F.col("mj")
    cells = (
        errors.select("e")
        .mapInArrow(parts, "i int, j int, n double, mi double, mj double, c double")
        .groupBy("i", "j")
        .agg(
            F.sum("n").alias("n"),
            F.sum(n * mi).alias("si"),
            (F.sum("c") + F.sum(n * mi * mj) - F.sum(n * mi) * F.sum(n * mj) / F.sum("n")).alias("c"),
        )
        .collect()
    )
    if not cells or cells[0]["n"] < 2:
        raise ValueError("too few error rows to fit an error model on")
    mu, sigma = np.zeros(width), np.zeros((width, width))
    for r in cells:
        sigma[r["i"], r["j"]] = sigma[r["j"], r["i"]] = r["c"] / (r["n"] - 1)
        if r["i"] == r["j"]:
            mu[r["i"]] = r["si"] / r["n"]
    return mu, sigma


MOMENT_TYPE = "n double, mean array<double>, cross array<double>"


def moment_rows(errors: DataFrame, width: int) -> DataFrame:
    """Moments of error vectors that can be stored and merged later: number, means, and centred cross products (upper triangle, by rows).

    Few features: one row, summed in the JVM.  Many: one row per task.  No errors give no row with ``n`` above 0.
    """
    upper = [(i, j) for i in range(width) for j in range(i, width)]
    if width <= UNROLL_LIMIT:
        n = F.count(F.lit(1)).cast("double")
        mean = F.array(*[F.expr(f"avg(e[{i}])") for i in range(width)])
        cross = F.array(*[F.expr(f"covar_pop(e[{i}], e[{j}])") for i, j in upper])
        row = errors.agg(n.alias("n"), mean.alias("mean"), cross.alias("spread"))
        return row.select("n", "mean", F.transform("spread", lambda v: v * F.col("n")).alias("cross"))

    def parts(batches):
        n, mean, cross = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width)
            if len(x):
                n, mean, cross = with_rows(n, mean, cross, x)
        if n:
            columns = [pa.array([float(n)]), pa.array([mean.tolist()]), pa.array([cross[np.triu_indices(width)].tolist()])]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "mean", "cross"])

    return errors.select("e").mapInArrow(parts, MOMENT_TYPE)


def merge_moments(rows: DataFrame, width: int) -> ErrorModel:
    """The error model of all rows whose moments these are (``moment_rows``, of any number of tables together).

    Cross products of parts add up after a correction by their means, cell by cell in Spark; only
    the finished matrix reaches the driver.  The variance of one feature is that of the population, as in ``fit_error_model``.
    """
    upper = [(i, j) for i in range(width) for j in range(i, width)]
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in upper])
    cells = rows.filter("n > 0").withColumn("pairs", pairs).select("n", "mean", "cross", F.posexplode("pairs").alias("k", "pair"))
    n, mi, mj = F.col("n"), F.expr("mean[pair.i]"), F.expr("mean[pair.j]")
    cells = cells.select("n", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), F.expr("cross[k]").alias("c"), mi.alias("mi"), mj.alias("mj"))
    total = cells.groupBy("i", "j").agg(F.sum("n").alias("n"), (F.sum(n * F.col("mi")) / F.sum("n")).alias("mi"), (F.sum(n * F.col("mj")) / F.sum("n")).alias("mj"))
    # One row for each cell of the matrix.
    shifted = cells.join(F.broadcast(total.select("i", "j", F.col("mi").alias("ti"), F.col("mj").alias("tj"))), ["i", "j"])
    cross = F.sum(F.col("c") + n * (F.col("mi") - F.col("ti")) * (F.col("mj") - F.col("tj")))
    found = shifted.groupBy("i", "j").agg(F.sum("n").alias("n"), cross.alias("c"), F.first("ti").alias("mu")).collect()
    mu, sums = np.zeros(width), np.zeros((width, width))
    for r in found:
        sums[r["i"], r["j"]] = sums[r["j"], r["i"]] = r["c"]
        if r["i"] == r["j"]:
            mu[r["i"]] = r["mu"]
    return from_moments(found[0]["n"] if found else 0, mu, sums)


def from_moments(n: float, mean: np.ndarray, cross: np.ndarray) -> ErrorModel:
    """The error model of ``n`` rows with these means and centred cross products."""
    width = len(mean)
    if n < min(width, 2):
        raise ValueError("too few error rows to fit an error model on")
    return ErrorModel(mean.tolist(), (cross / (n - (width > 1))).tolist())


def with_rows(n: int, mean: np.ndarray, cross: np.ndarray, x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred cross products with the rows of ``x`` added."""
    m = x.mean(axis=0)
    centred, shift, total = x - m, m - mean, n + len(x)
    return total, mean + shift * (len(x) / total), cross + centred.T @ centred + np.outer(shift, shift) * (n * len(x) / total)


def score_points(windows: DataFrame, model: ErrorModel, metric: str = "cov") -> DataFrame:
    """``scores``: one anomaly score per step of every window.  Narrow."""
    weight, mu = model.weight(metric), model.mu
    if len(mu) <= JVM_WIDTH:
        return windows.withColumn("scores", F.expr(f"transform(errs, e -> {quadratic_score('e', mu, weight)})"))
    centre, matrix_ = np.array(mu), np.array(weight)

    def compute(errs: pa.Array):
        length = len(errs.flatten()) // len(errs)
        return {"scores": list_column(quadratic_scores(tensor(errs, length, len(centre)), centre, matrix_))}

    return map_windows(windows, "errs", {"scores": VECTOR_TYPE}, compute)


def score_windows(windows: DataFrame) -> DataFrame:
    """``score_max``: the largest point score of the window."""
    return windows.withColumn("score_max", F.array_max("scores"))


def flag_windows(windows: DataFrame, threshold: float, hard: int) -> DataFrame:
    """``flagged``: at least ``hard`` points score above the threshold."""
    return windows.withColumn("n_over", F.expr(f"size(filter(scores, s -> s > {number(threshold)}))")).withColumn(
        "flagged", F.col("n_over") >= hard
    )
