"""Hand-computed cases, skewed inputs, and comparisons with NumPy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions.ordering import medians, order_statistics, running_totals
from tidewatch.operators import (
    buffers, checks, errors, evaluate, index, labels, project, sampling, scale, split, threshold, windows,
)

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def numbered(spark, n):
    return spark.range(n).select(F.col("id").alias("idx"))


def indexed(spark, rows, anomalies=()):
    marks = set(anomalies)
    data = [(i, [float(v) for v in x], i in marks) for i, x in enumerate(rows)]
    return spark.createDataFrame(data, "idx long, x array<double>, is_anomaly boolean")


def make_windows(spark, tensor, anomalous=()):
    data = [
        (w, [[float(v) for v in r] for r in xs], [w in anomalous] * len(xs), w in anomalous)
        for w, xs in enumerate(tensor)
    ]
    return spark.createDataFrame(data, "w long, xs array<array<double>>, flags array<boolean>, is_anomaly boolean")


# ---- positions


def test_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("k"))
    got = index.with_index(df, ["k"]).collect()
    assert sorted((r.idx, r.k) for r in got) == [(i, i) for i in range(1000)]


def test_index_spreads_copies(spark):
    """A third of the rows are exact copies: still dense, and not in one partition."""
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 5000).otherwise(F.col("id")).alias("k"))
    placed = index.with_index(df, ["k"])
    got = sorted((r.idx, r.k) for r in placed.collect())
    assert [i for i, _ in got] == list(range(3000))
    assert [k for _, k in got] == sorted(k for _, k in got)
    from tidewatch.functions.ordering import sorted_table

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = sorted_table(df, ["k"], "t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert table.filter("k = 5000").select("_pid").distinct().count() > 1


def test_keyed_index_with_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 40).alias("key"), F.col("id").alias("t")
    )
    got = index.with_index(df, ["t"], by=["key"], total="n").toPandas()
    for _, part in got.groupby("key", dropna=False):
        part = part.sort_values("t")
        assert part.idx.tolist() == list(range(len(part)))
        assert set(part.n) == {len(part)}


def test_keyed_index_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(index, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(index.broadcast_if_small, "__defaults__", (1,))
    df = spark.range(500).select((F.col("id") % 7).alias("key"), F.col("id").alias("t"))
    placed = index.with_index(df, ["t"], by=["key"])
    got = placed.toPandas()
    for _, part in got.groupby("key"):
        assert part.sort_values("t").idx.tolist() == list(range(len(part)))


def test_index_of_nothing(spark):
    assert index.with_index(spark.range(0), ["id"]).count() == 0
    assert index.count_rows(index.with_index(spark.range(0), ["id"])) == 0


def test_downsample_and_slice(spark):
    """35 040 rows, every 8th, without the first 60 and the last 36."""
    raw = numbered(spark, 35040).withColumn("at", F.col("idx"))
    kept = index.slice_rows(index.downsample(raw, 8), 60, -36)
    assert kept.count() == 4284
    assert kept.agg(F.min("at")).first()[0] == 480
    assert sorted(r.idx for r in kept.collect()) == list(range(4284))


@QUICK
@given(st.integers(0, 30), st.one_of(st.none(), st.integers(-35, 35)), st.one_of(st.none(), st.integers(-35, 35)))
def test_slice_like_a_list(spark, n, start, stop):
    got = index.slice_rows(numbered(spark, n).withColumn("at", F.col("idx")), start, stop).collect()
    assert sorted(r["at"] for r in got) == list(range(n))[start:stop]


def test_windows_and_batches(spark):
    rows = windows.assign_windows(numbered(spark, 25), 3)
    assert rows.count() == 24
    w = windows.assign_batches(rows.select("w").distinct(), 2)
    assert w.count() == 8 and w.select("batch").distinct().count() == 4


def test_collect_and_explode_are_inverse(spark):
    s = indexed(spark, [[i, -i] for i in range(25)], {4})
    w = windows.collect_windows(windows.assign_windows(s, 3), 3)
    assert w.count() == 8
    back = windows.explode_windows(w, "xs", "flags").collect()
    assert sorted((r.w * 3 + r.step, r.xs, r.flags) for r in back) == [
        (i, [float(i), float(-i)], i == 4) for i in range(24)
    ]


def test_zip_and_union(spark):
    a = numbered(spark, 3).withColumn("a", F.col("idx"))
    b = numbered(spark, 2).withColumn("b", F.col("idx"))
    assert sorted((r.idx, r.a, r.b) for r in index.zip_columns(a, b).collect())[2] == (2, 2, None)
    joined = index.ordered_union(a, a, a).orderBy("idx").collect()
    assert [(r.idx, r.src_ord, r.a) for r in joined] == [(i, i // 3, i % 3) for i in range(9)]


# ---- order


@QUICK
@given(st.lists(st.sampled_from([-1e9, -2.5, 0.0, 1e-12, 1.0, 1.0 + 1e-12, 3.0, 7e8]) | st.floats(-100, 100), min_size=1, max_size=60))
def test_order_statistics(spark, values):
    df = spark.createDataFrame([("p", v) for v in values], "pool string, v double")
    ranks = sorted({0, len(values) // 3, len(values) // 2, len(values) - 1})
    got, limits = order_statistics(df, "v", "pool", lambda _, n: ranks, few=4)
    assert [got["p", i] for i in ranks] == [sorted(values)[i] for i in ranks]
    assert limits["p"] == (len(values), min(values), max(values))


def test_order_statistics_take_few_scans_whatever_the_spread(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([10 ** rng.uniform(-300, 300, 15_000), np.full(5_000, 2.5)]).tolist()
    df = spark.createDataFrame([("p", v) for v in values], "pool string, v double")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("order statistics", "")
    got, _ = order_statistics(df, "v", "pool", lambda _, n: [n // 2, n // 2 - 1, 17])
    scans = len(jobs.getJobIdsForGroup("order statistics"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [got["p", k] for k in (10_000, 9_999, 17)] == [sorted(values)[k] for k in (10_000, 9_999, 17)]
    assert scans <= 10  # two jobs, before and behind the exchange, for each of five scans


def test_order_statistics_refuse_values_of_no_pool(spark):
    df = spark.createDataFrame([("p", 1.0), (None, 2.0)], "pool string, v double")
    with pytest.raises(ValueError, match="no pool"):
        order_statistics(df, "v", "pool", lambda _, n: [0])


@pytest.mark.parametrize("odd", [float("nan"), float("inf")])
def test_order_statistics_need_finite_values(spark, odd):
    df = spark.createDataFrame([("p", 1.0), ("p", odd)], "pool string, v double")
    with pytest.raises(ValueError, match="not finite"):
        order_statistics(df, "v", "pool", lambda _, n: [0])


def test_median_with_a_third_ties(spark):
    df = spark.range(3001).select(
        F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.rand(3)).alias("v"), (F.col("id") % 2).cast("string").alias("p")
    ).persist()
    rows = df.toPandas()
    expected = rows.groupby("p").v.median().to_dict()
    assert medians(df, "v", "p") == pytest.approx(expected, abs=0)


def test_running_totals(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit(2).alias("a"))
    got = running_totals(df, ["k"], {"s": "a"}, overall={"t": "s"}).orderBy("k").collect()
    assert [(r.s, r.t) for r in got] == [(2 * (i + 1), 1000) for i in range(500)]


# ---- labels, projection, scaling


def test_labels(spark):
    df = spark.createDataFrame([("normal.",), ("normal",), ("smurf.",)], "label string")
    assert [r.is_anomaly for r in labels.canonical_label(df).collect()] == [False, False, True]
    classes = spark.createDataFrame([(4,), (1,), (1,), (7,), (7,)], "label int")
    assert [r.label for r in labels.minority_as_anomaly(classes).collect()] == ["anomaly."] + ["normal."] * 4
    assert [r.label for r in labels.minority_as_anomaly(classes, 1).collect()].count("anomaly.") == 2


def test_select_kinds_and_ordinals(spark):
    df = spark.createDataFrame([(1.0, "tcp", 2.0, "normal.")], "a double, b string, c double, y string")
    assert project.select_kinds(df, ["continuous", "symbolic", "continuous"]).first().asDict() == {"a": 1.0, "c": 2.0, "label": "normal."}
    assert project.select_ordinals(df, [2, 0], -1).columns == ["c", "a", "label"]
    features, label = project.split_label(project.to_vector(df.withColumnRenamed("y", "label").withColumn("idx", F.lit(0)), ["a", "c"]))
    assert features.first().x == [1.0, 2.0] and label.first().label == "normal."


def test_minmax(spark):
    s = indexed(spark, [[1, 5], [3, 5], [2, 5]])
    expected = [[0.0, 0.0], [1.0, 0.0], [0.5, 0.0]]
    assert [r.x for r in scale.minmax_global(s, 2).orderBy("idx").collect()] == expected
    w = make_windows(spark, [[[1, 5], [3, 5], [2, 5]]])
    assert scale.minmax_window(w, 2).first().xs == expected


# ---- subsets


@pytest.mark.parametrize("normal, anomalous", [(25, 5), (10, 1), (100, 0), (31, 2), (7, 3)])
def test_split(spark, normal, anomalous):
    total = normal + anomalous
    bad = set(np.random.default_rng(total).choice(total, anomalous, replace=False).tolist())
    w = spark.createDataFrame([(i, i in bad) for i in range(total)], "w long, is_anomaly boolean")
    found = split.fit_split(w)
    marked = split.split_subsets(w, found).collect()
    good, ill, t = [i for i in range(total) if i not in bad], sorted(bad), normal // 10
    half = anomalous // 2
    expected = {
        "sn": good[: 5 * t], "vn1": good[5 * t : 8 * t], "vn2": good[8 * t : 9 * t], "tn": good[9 * t :],
        "va": ill[:half] if half else ill, "ta": ill[half:] if half else ill,
    }
    for name, members in expected.items():
        assert sorted(r.w for r in marked if name in r.subsets) == members
        assert found.sizes[name] == len(members)
        assert sorted(r.w for r in w.filter(found.where(name)).collect()) == members


def test_reverse_batches(spark):
    got = sampling.reverse_batches(spark.range(11).select(F.col("id").alias("w")), 4).orderBy("batch", "pos").collect()
    assert [(r.batch, r.w) for r in got] == [(0, 10), (0, 9), (0, 8), (0, 7), (1, 6), (1, 5), (1, 4), (1, 3)]


def test_shuffle_batches(spark):
    w = spark.range(11).select(F.col("id").alias("w"))
    once = {(r.w, r.batch, r.pos) for r in sampling.shuffle_batches(w, 4, 1).collect()}
    assert len(once) == 8 and once == {(r.w, r.batch, r.pos) for r in sampling.shuffle_batches(w, 4, 1).collect()}
    assert once != {(r.w, r.batch, r.pos) for r in sampling.shuffle_batches(w, 4, 2).collect()}


# ---- errors and scores


def test_error_model(spark):
    e = spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],), ([2.0, 2.0],)], "e array<double>")
    model = errors.fit_error_model(e, 2)
    assert model.mu == [2, 3]
    assert np.allclose(model.sigma, [[1, 1.5], [1.5, 3]])
    single = errors.fit_error_model(spark.createDataFrame([([1.0],), ([3.0],), ([2.0],)], "e array<double>"), 1)
    assert single.mu == [2] and single.sigma[0][0] == pytest.approx(2 / 3)


@pytest.mark.parametrize("width", [3, 12, 34])
def test_error_model_like_numpy(spark, width):
    x = np.random.default_rng(1).normal(1e3, 1, (500, width)) @ np.random.default_rng(2).normal(size=(width, width))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "e array<double>").repartition(5)
    model = errors.fit_error_model(df, width)
    assert np.allclose(model.mu, x.mean(axis=0))
    assert np.allclose(model.sigma, np.cov(x.T))


def with_errs(spark, tensor, width):
    return make_windows(spark, tensor).withColumn("errs", F.col("xs"))


def test_scores(spark):
    model = errors.ErrorModel([1, 1], [[1, 0.5], [0.5, 2]])
    got = errors.score_points(with_errs(spark, [[[1, 2], [3, 4]]], 2), model).first().scores
    assert got == pytest.approx([1.414214, 5.291503], abs=1e-6)
    single = errors.score_points(with_errs(spark, [[[3]]], 1), errors.ErrorModel([2], [[2 / 3]])).first().scores
    assert single == pytest.approx([0.816497], abs=1e-6)


@pytest.mark.parametrize("width", [4, 20])
@pytest.mark.parametrize("metric", ["cov", "inv_cov"])
def test_scores_like_numpy(spark, width, metric):
    rng = np.random.default_rng(0)
    x, a = rng.normal(size=(6, 5, width)), rng.normal(size=(width, width))
    model = errors.ErrorModel(rng.normal(size=width).tolist(), (a @ a.T).tolist())
    weight = a @ a.T if metric == "cov" else np.linalg.inv(a @ a.T)
    c = x - np.array(model.mu)
    expected = np.sqrt(np.einsum("nti,ij,ntj->nt", c, weight, c))
    got = errors.score_points(with_errs(spark, x, width), model, metric).orderBy("w").collect()
    assert np.allclose([r.scores for r in got], expected, rtol=1e-6)


def test_flags(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [2.0, 2.0, 5.0])], "w long, scores array<double>")
    got = errors.flag_windows(errors.score_windows(df), 2.0, 1).orderBy("w").collect()
    assert [(r.score_max, r.n_over, r.flagged) for r in got] == [(3.0, 1, True), (5.0, 1, True)]
    assert [r.flagged for r in errors.flag_windows(df, 1.5, 3).orderBy("w").collect()] == [False, True]


# ---- threshold


def pools(spark, normal, abnormal):
    rows = [("normal", float(v)) for v in normal] + [("abnormal", float(v)) for v in abnormal]
    return spark.createDataFrame(rows, "pool string, score double")


def test_threshold(spark):
    p = pools(spark, [1, 2, 3, 4, 5, 9], [6, 8, 10, 12, 3.5])
    c = threshold.threshold_candidates(p)
    assert c[0] == 3.5 and c[1] - c[0] == pytest.approx(0.225) and len(c) == 20
    table = threshold.evaluate_threshold(p, c)
    assert table.orderBy("i").first().f == pytest.approx(0.740741, abs=1e-6)
    best = threshold.best_threshold(table).first()
    assert best.threshold == pytest.approx(5.075) and best.f == pytest.approx(0.8)
    row = table.filter(F.abs(F.col("candidate") - 5.075) < 1e-9).first()
    assert (row.tp, row.missed, row.false_alarms) == (4, 1, 1)


def test_objectives_mirror_each_other(spark):
    p = pools(spark, [1, 2, 3, 4, 5, 9, 2.5], [6, 8, 10, 12, 3.5])
    c = threshold.threshold_candidates(p)
    a = [r.f for r in threshold.evaluate_threshold(p, c, 0.5).orderBy("i").collect()]
    b = [r.f for r in threshold.evaluate_threshold(p, c, 2.0, "fbeta").orderBy("i").collect()]
    assert a == pytest.approx(b)


def test_threshold_edge_cases(spark):
    assert threshold.search_threshold(pools(spark, [4, 9], []), too_few=True) == 18
    with pytest.raises(ValueError, match="abnormal"):
        threshold.threshold_candidates(pools(spark, [4, 9], []))
    nothing = threshold.evaluate_threshold(pools(spark, [1, 2], [0.1, 0.2]), [5.0, 6.0])
    assert threshold.best_threshold(nothing).first().threshold == 0


# ---- buffers


def test_routing(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "flagged boolean, is_anomaly boolean")
    got = [(r.to_anom_buf, r.to_anom_err, r.to_norm_buf, r.to_norm_err) for r in buffers.route_window(df).collect()]
    assert got == [(True, True, False, False), (False, False, True, True), (True, True, False, False), (False, False, False, True)]


def ranked(spark, n):
    return spark.range(n).select(F.col("id").alias("rank"), F.col("id").alias("w"))


def test_oversample_and_truncate(spark):
    more = buffers.oversample_by_doubling(ranked(spark, 3), 10)
    assert sorted((r["rank"], r.w) for r in more.collect()) == [(i, i % 3) for i in range(12)]
    assert buffers.truncate_to_batches(more, 10).count() == 10
    with pytest.raises(ValueError):
        buffers.oversample_by_doubling(ranked(spark, 0), 10)


def test_train_val(spark):
    got = buffers.buffer_train_val(ranked(spark, 19), 4).collect()
    assert sorted(r.w for r in got if r.role == "val") == [12, 13, 14, 15]
    assert sorted(r.w for r in got if r.role == "train") == list(range(12))


@pytest.mark.parametrize("one_task", [True, False])
def test_update_due(spark, one_task):
    rows = [(b, i < 2, b == 3) for b in range(6) for i in range(4)]
    df = spark.createDataFrame(rows, "batch long, to_norm_buf boolean, to_anom_buf boolean")
    got = buffers.update_due(df, 2, 2, normal=1, one_task=one_task).orderBy("batch").collect()
    assert [r.normal_fill for r in got] == [3, 5, 7, 9, 11, 13]
    assert [r.due for r in got] == [False, False, False, True, True, True]


# ---- evaluation and checks


def test_auc_and_roc(spark):
    data = [(0.1, False), (0.4, False), (0.4, True), (0.8, True), (0.4, False), (0.3, True)]
    df = spark.createDataFrame(data, "score_max double, is_anomaly boolean")
    assert evaluate.auc(df).first().auc == pytest.approx(0.666667, abs=1e-6)
    curve = [(r.score, r.fpr, r.tpr) for r in evaluate.roc_curve(df).orderBy(F.desc("score")).collect()]
    assert curve == [(0.8, 0, pytest.approx(1 / 3)), (0.4, pytest.approx(2 / 3), pytest.approx(2 / 3)), (0.3, pytest.approx(2 / 3), 1), (0.1, 1, 1)]


@QUICK
@given(st.lists(st.tuples(st.integers(0, 9), st.booleans()), min_size=2, max_size=40))
def test_auc_is_a_rank_statistic(spark, pairs):
    df = spark.createDataFrame([(float(s), y) for s, y in pairs], "score_max double, is_anomaly boolean")
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    got = evaluate.auc(df).first().auc
    if not pos or not neg:
        assert got is None
        return
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got == pytest.approx(wins / len(pos) / len(neg))
    cubed = df.withColumn("score_max", F.pow("score_max", 3))
    assert evaluate.auc(cubed).first().auc == pytest.approx(got)


def test_checks(spark):
    s = indexed(spark, [[1, 2], [3, float("nan")]])
    assert tuple(checks.check_nulls(s).first()) == (2, 1)
    with pytest.raises(ValueError, match="null or NaN"):
        checks.require_no_nulls(s)
    with pytest.raises(ValueError, match="3 features"):
        checks.check_dim(s, 3)
    with pytest.raises(ValueError, match="3 features"):
        checks.inspect(s, 3)
    assert checks.inspect(indexed(spark, [[1, 2], [3, 0]]), 2) == ([1, 0], [3, 2])
    sizes = {"sn": 5, "vn1": 3, "vn2": 1, "tn": 1, "va": 1, "ta": 1}
    notes = checks.require_nonempty(split.Split({}, sizes), 8, n0=1008, rows=4284, length=84, capacity=9)
    assert any("72 windows" in n for n in notes) and any("sn has 5" in n for n in notes)
    assert any("nothing is left" in n for n in checks.require_nonempty(split.Split({}, sizes), 1, n0=900, rows=600))
    with pytest.raises(ValueError, match="normal windows"):
        checks.require_nonempty(split.Split({}, dict(sizes, sn=1)), 8)
    with pytest.raises(ValueError, match="no windows"):
        checks.require_nonempty(split.Split({}, dict(sizes, va=0)), 8)


def test_profile_table(spark):
    got = evaluate.dataset_profile(indexed(spark, [[1, 2]] * 4, {1})).first()
    assert tuple(got) == (2, 4, 25.0)


def test_expert_labels(spark):
    w = spark.createDataFrame([(0,), (1,)], "w long")
    verdict = spark.createDataFrame([(1, True)], "w long, is_anomaly boolean")
    assert [r.is_anomaly for r in windows.attach_expert_labels(w, verdict).orderBy("w").collect()] == [False, True]
