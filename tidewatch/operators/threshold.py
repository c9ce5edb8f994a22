"""Search for the decision threshold on point scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordering import medians
from tidewatch.functions.scratch import save
from tidewatch.functions.vectors import number
from tidewatch.operators.sampling import arrival_batches
from tidewatch.operators.split import Split

# fixed values: parts between the two medians, and beta of the objective
CANDIDATES, BETA = 20, 0.5


def point_pools(scored: DataFrame, anomalous_window: Column) -> DataFrame:
    """(pool, score) per point: abnormal are the anomalous rows of anomalous windows."""
    points = scored.select(anomalous_window.alias("_aw"), F.explode(F.arrays_zip("scores", "flags")).alias("_p"))
    pool = F.when(F.col("_aw") & F.col("_p.flags"), "abnormal").otherwise("normal")
    return points.select(pool.alias("pool"), F.col("_p.scores").alias("score"))


def score_pools(scored: DataFrame, split: Split, per_batch: int | None = None) -> DataFrame:
    """Points of vn2 and normal points of va against the other points of va.

    With ``per_batch`` the windows after the last full batch of vn2 and of va are left out.
    """
    if per_batch is None:
        kept = scored.filter(split.where("vn2") | split.where("va"))
    else:
        vn2, va = (arrival_batches(scored.filter(split.where(s)), per_batch) for s in ("vn2", "va"))
        kept = vn2.unionByName(va)
    return point_pools(kept, F.col("is_anomaly"))


def threshold_fallback(pools: DataFrame) -> DataFrame:
    """Twice the largest normal score, for when there are too few anomalous windows."""
    return pools.filter(F.col("pool") == "normal").agg((F.max("score") * 2).alias("threshold"))


def threshold_candidates(pools: DataFrame, n: int = CANDIDATES, approx: bool = False) -> list[float]:
    """``n`` steps from the median of the normal scores towards that of the abnormal ones."""
    if approx:
        mid = F.percentile_approx("score", 0.5, 10_000)
        middle = {r["pool"]: r["m"] for r in pools.groupBy("pool").agg(mid.alias("m")).collect()}
    else:
        middle = medians(pools, "score", "pool")
    missing = {"normal", "abnormal"} - set(middle)
    if missing:
        raise ValueError(f"no points in the pool of {sorted(missing)} scores")
    delta = (middle["abnormal"] - middle["normal"]) / n
    candidates = [middle["normal"]]
    while len(candidates) < n:
        candidates.append(candidates[-1] + delta)
    return candidates


def evaluate_threshold(
    pools: DataFrame, candidates: Sequence[float], beta: float = BETA, objective: str = "as_written"
) -> DataFrame:
    """(i, candidate, tp, missed, false_alarms, f) for all candidates, in one pass over the scores.

    ``objective='as_written'`` weighs recall where the usual F-beta weighs precision, which
    makes beta act like 1/beta; ``'fbeta'`` is the usual one.
    """
    counts = pools.agg(
        F.expr("count_if(pool = 'abnormal') AS n_abnormal"),
        *[F.expr(f"count_if(pool = 'abnormal' AND score > {number(c)}) AS tp{i}") for i, c in enumerate(candidates)],
        *[F.expr(f"count_if(pool = 'normal' AND score > {number(c)}) AS fa{i}") for i, c in enumerate(candidates)],
    )
    rows = ", ".join(
        f"struct({i}L AS i, {number(c)} AS candidate, tp{i} AS tp, n_abnormal - tp{i} AS missed, fa{i} AS false_alarms)"
        for i, c in enumerate(candidates)
    )
    recall = F.col("tp") / (F.col("tp") + F.col("missed"))
    precision = F.col("tp") / (F.col("tp") + F.col("false_alarms"))
    if objective == "as_written":
        p, r = recall, precision
    elif objective == "fbeta":
        p, r = precision, recall
    else:
        raise ValueError(f"unknown objective {objective!r}")
    f = (1 + beta * beta) * p * r / (beta * beta * p + r)
    return counts.select(F.expr(f"inline(array({rows}))")).withColumn("f", F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(f))


def best_threshold(evaluated: DataFrame) -> DataFrame:
    """The first candidate with the largest objective; 0 if none scores above 0."""
    top = evaluated.orderBy(F.desc("f"), F.asc("i")).limit(1)
    return top.select(F.when(F.col("f") > 0, F.col("candidate")).otherwise(F.lit(0.0)).alias("threshold"), "f")


def search_threshold(
    pools: DataFrame, too_few: bool, beta: float = BETA, objective: str = "as_written", approx: bool = False
) -> float:
    """Best candidate, or the fallback if there are too few anomalous windows."""
    pools = save(pools, "pools")
    if too_few:
        value = threshold_fallback(pools).first()["threshold"]
        if value is None:
            raise ValueError("no normal scores to set a threshold from")
        return value
    candidates = threshold_candidates(pools, approx=approx)
    return best_threshold(evaluate_threshold(pools, candidates, beta, objective)).first()["threshold"]


def find_threshold(
    scored: DataFrame,
    split: Split,
    per_batch: int,
    beta: float = BETA,
    objective: str = "as_written",
    drop_partial_batch: bool = False,
    approx: bool = False,
) -> float:
    """Threshold from scored vn2 and va windows, with the fallback for a short va."""
    pools = score_pools(scored, split, per_batch if drop_partial_batch else None)
    return search_threshold(pools, split.sizes["va"] < per_batch, beta, objective, approx)
