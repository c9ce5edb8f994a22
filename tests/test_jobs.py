"""Whole jobs: files, preparation, initialization, adaptation, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.index import with_index
from tidewatch.plans.initialize import initialize
from tidewatch.plans.online import replay_online, update_report
from tidewatch.plans.params import Params
from tidewatch.plans.prepare import canonical_series, prepare_forest, prepare_power, prepare_services, store_series
from tidewatch.sources.models import load_model
from tidewatch.sources.series import parse_column_kinds, read_column_kinds, read_series, series_schema, spread_vector, write_series
from tidewatch.streaming.online import log_progress, stream_online
from tidewatch.streaming.windows import count_windows_stream, parquet_windows
from tests.test_operators import indexed


# ---- files


def test_csv_keeps_file_order(spark, tmp_path):
    """Many splits of several files: positions follow the files, not the tasks."""
    for part in range(3):
        lines = [f"{part * 1000 + i},{i % 7},normal." for i in range(1000)]
        (tmp_path / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = read_series(spark, str(tmp_path), series_schema(2))
        assert got.columns == ["idx", "f0", "f1", "label"]
        rows = got.toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(rows.idx) == list(range(3000))
    assert (rows.f0 == rows.idx).all()


def test_series_round_trip(spark, tmp_path):
    s = canonical_series(spark.range(500).select(F.col("id").alias("idx"), (F.col("id") * 0.5).alias("f0"), F.lit("normal.").alias("label")))
    write_series(spread_vector(s.drop("is_anomaly"), 1), str(tmp_path / "csv"))
    back = read_series(spark, str(tmp_path / "csv"), series_schema(1)).toPandas()
    assert (back.f0 == back.idx * 0.5).all() and len(back) == 500
    store_series(s, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 500


def test_column_kinds(spark, tmp_path):
    (tmp_path / "kinds.txt").write_text("duration: continuous.proto: symbolic. service: symbolic.bytes: continuous.\n")
    assert read_column_kinds(spark, str(tmp_path / "kinds.txt")) == [
        ("duration", "continuous"), ("proto", "symbolic"), ("service", "symbolic"), ("bytes", "continuous"),
    ]
    assert parse_column_kinds(spark.createDataFrame([("",)], "value string")).count() == 0


# ---- preparation


def test_prepare_power(spark, tmp_path):
    (tmp_path / "data.csv").write_text("\n".join(str(float(i)) for i in range(35040)))
    (tmp_path / "labels.csv").write_text("\n".join("anomaly." if i % 84 == 3 else "normal." for i in range(4284)))
    data = read_series(spark, str(tmp_path / "data.csv"), "f0 double")
    labels = read_series(spark, str(tmp_path / "labels.csv"), "label string")
    got = prepare_power(data, labels).toPandas().sort_values("idx")
    assert len(got) == 4284 and got.f0.iloc[0] == 480 and got.f0.iloc[1] == 488
    assert (got.label == "anomaly.").sum() == 51 and got.label.iloc[3] == "anomaly."


def test_prepare_services(spark, tmp_path):
    services = ["http", "smtp", "ftp", "http"]
    lines = [f"{i}.0,tcp,{services[i % 4]},{i * 2}.0,{'normal.' if i % 5 else 'smurf.'}" for i in range(40)]
    (tmp_path / "raw.csv").write_text("\n".join(lines))
    raw = read_series(spark, str(tmp_path / "raw.csv"), "a double, proto string, service string, b double, y string")
    made = prepare_services(raw, ["continuous", "symbolic", "symbolic", "continuous"])
    assert set(made) == {"smtp", "http", "smtphttp"}
    both = canonical_series(made["smtphttp"].select("idx", "a", "b", "label")).toPandas().sort_values("idx")
    expected = [i for i in range(40) if i % 4 == 1] + [i for i in range(40) if i % 4 in (0, 3)]
    assert [x[0] for x in both.x] == expected and [x[1] for x in both.x] == [2 * i for i in expected]
    assert both.is_anomaly.tolist() == [i % 5 == 0 for i in expected]
    assert sorted(r.idx for r in made["http"].collect()) == list(range(20))


def test_prepare_forest(spark, tmp_path):
    lines = [",".join(str(float(i * 100 + c)) for c in range(12)) + f",{4 if i == 5 else 1 + i % 3}" for i in range(30)]
    (tmp_path / "raw.csv").write_text("\n".join(lines))
    raw = read_series(spark, str(tmp_path / "raw.csv"), ", ".join(f"c{i} double" for i in range(12)) + ", y int")
    for cls in (4, None):
        got = prepare_forest(raw, cls=cls).toPandas().sort_values("idx")
        assert got.columns.tolist() == ["c0", "c1", "c2", "c3", "c4", "c5", "c9", "label", "idx"]
        assert got[got.label == "anomaly."].idx.tolist() == [5]


# ---- initialization and adaptation, against one batch after the other in NumPy


def wave(n, seed, d, drift_at, anomalies):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    x = np.stack([np.sin(2 * np.pi * (t % 6) / 6 + k) for k in range(d)], axis=1) + 0.05 * rng.normal(size=(n, d))
    late = t >= drift_at
    x[late] = np.stack([np.sin(2 * np.pi * (t % 6) / 6 + k + 1.5) for k in range(d)], axis=1)[late] + 0.05 * rng.normal(size=(late.sum(), d))
    bad = np.zeros(n, dtype=bool)
    for a in rng.choice(n // 6, anomalies, replace=False):
        rows = slice(a * 6, a * 6 + 6)
        x[rows] += rng.normal(size=(6, d)) * 1.5
        bad[a * 6 + rng.integers(6, size=3)] = True
    return x, bad


def minmax(x, axis):
    low, high = x.min(axis=axis, keepdims=True), x.max(axis=axis, keepdims=True)
    return np.where(high > low, (x - low) / np.where(high > low, high - low, 1), 0)


def spread_of(e):
    return (e.mean(axis=0), np.array([[e.var()]])) if e.shape[1] == 1 else (e.mean(axis=0), np.cov(e.T))


def by_hand(x, bad, p):
    """Profile model, everything sequential and in memory."""
    d, L, B = x.shape[1], p.length, p.per_batch
    init = minmax(x[: p.init_rows], 0)
    n = len(init) // L
    xs, flags = init[: n * L].reshape(n, L, d), bad[: n * L].reshape(n, L)
    good, ill = np.flatnonzero(~flags.any(axis=1)), np.flatnonzero(flags.any(axis=1))
    t, half = len(good) // 10, len(ill) // 2
    profile = xs[good[: 5 * t]].mean(axis=0)
    errs = np.abs(xs - profile)
    mu, sigma = spread_of(errs[good[5 * t : 8 * t]].reshape(-1, d))

    def points(e):
        c = e - mu
        return np.sqrt(np.maximum(np.einsum("...i,ij,...j->...", c, sigma, c), 0))

    va = ill[:half] if half else ill
    normal = np.concatenate([points(errs[good[8 * t : 9 * t]]).ravel(), points(errs[va])[~flags[va]]])
    if len(va) < B:
        threshold = 2 * normal.max()
    else:
        abnormal = points(errs[va])[flags[va]]
        lo, hi = np.median(normal), np.median(abnormal)
        best, threshold, c = 0, 0.0, lo
        for _ in range(20):
            tp, fa = (abnormal > c).sum(), (normal > c).sum()
            if tp:
                r, q = tp / len(abnormal), tp / (tp + fa)
                f = 1.25 * r * q / (0.25 * r + q)
                if f > best:
                    best, threshold = f, c
            c += (hi - lo) / 20
    rest, rest_bad = x[p.init_rows :], bad[p.init_rows :]
    batches = len(rest) // (L * B)
    w = minmax(rest[: batches * B * L].reshape(-1, L, d), 1)
    expert = rest_bad[: batches * B * L].reshape(-1, L).any(axis=1)
    version, out, nbuf, abuf, nerr = 0, [], [], 0, []
    for b in range(batches):
        for k in range(b * B, b * B + B):
            e = np.abs(w[k] - profile)
            s = points(e)
            flag = (s > threshold).sum() >= p.hard
            out.append((k, version, s.max(), bool(flag)))
            if expert[k]:
                abuf += 1
            else:
                nerr.append(e)
                if flag:
                    nbuf.append(w[k])
        if len(nbuf) >= B * p.capacity and abuf:
            full = len(nbuf) // B
            profile = np.mean(nbuf[: (full - 1) * B] if full > 1 else nbuf, axis=0)
            mu, sigma = spread_of(np.concatenate(nerr))
            version, nbuf, abuf, nerr = version + 1, [], 0, []
    return threshold, out, expert, version


# features, points that flag a window, buffer capacity, anomalous windows / 4, least number of updates;
# the second case has too few anomalous windows to search a threshold
CASES = [(1, 3, 6, 24, 2), (3, 5, 3, 3, 0), (3, 3, 8, 24, 2)]


def settings(d, hard, capacity, **changes):
    return Params(6, 4, 2, d, 1800, hard, capacity, kind="profile", look_ahead=8, **changes)


@pytest.mark.parametrize("d, hard, capacity, anomalies, updates", CASES)
def test_replay_is_the_sequential_result(spark, d, hard, capacity, anomalies, updates):
    x, bad = wave(4000, 3, d, 2700, anomalies * 4)
    p = settings(d, hard, capacity)
    s = indexed(spark, x, np.flatnonzero(bad).tolist())
    threshold, expected, expert, version = by_hand(x, bad, p)
    model = initialize(s, p)
    assert model.threshold == pytest.approx(threshold)
    replay = replay_online(s, model, p)
    got = replay.windows.orderBy("w").collect()
    assert replay.updates == version >= updates
    assert [(r.w, r.version, r.flagged) for r in got] == [(k, v, f) for k, v, _, f in expected]
    assert np.allclose([r.score_max for r in got], [s for _, _, s, _ in expected])
    assert [r.is_anomaly for r in got] == expert.tolist()


def test_updating_helps_after_a_drift(spark):
    x, bad = wave(6000, 11, 1, 2400, 60)
    p = settings(1, 2, 8)
    s = indexed(spark, x, np.flatnonzero(bad).tolist())
    report = update_report(s, initialize(s, p), p).first()
    assert report.updates > 0
    assert report.auc_with > report.auc_without


@pytest.mark.parametrize("kind", ["lstm", "pca"])
def test_other_models_run_through(spark, tmp_path, kind):
    x, bad = wave(4000, 3, 2, 2700, 40)
    p = settings(2, 2, 2).but(kind=kind, max_epochs=2, update_epochs=2, refresh_threshold=True, rescore_errors=True, sample="drop_remainder", drop_partial_batch=True, metric="inv_cov")
    s = indexed(spark, x, np.flatnonzero(bad).tolist())
    root, log = str(tmp_path / "models"), str(tmp_path / "log")
    model = initialize(s, p, root, log)
    replay = replay_online(s, model, p, root=root, log=log)
    assert replay.updates >= 1 and replay.windows.count() == 2200 // 24 * 4
    assert load_model(spark, root, p).version == replay.updates
    metrics = {r.metric for r in spark.read.parquet(log).collect()}
    assert {"windows_sn", "rows_ta", "threshold", "auc", "updates", "seconds"} <= metrics


def test_nothing_left_for_the_online_phase(spark):
    x, bad = wave(1900, 3, 1, 1900, 20)
    p = settings(1, 2, 2).but(init_rows=1900)
    s = indexed(spark, x, np.flatnonzero(bad).tolist())
    replay = replay_online(s, initialize(s, p), p)
    assert replay.windows.count() == 0 and replay.updates == 0


# ---- streams


def write_parts(spark, df, path, sizes):
    """One file per micro-batch, in the order of idx."""
    start = 0
    for i, size in enumerate(sizes):
        part = df.filter(F.col("idx").between(start, start + size - 1))
        part.coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
        start += size


def stream_of(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def finish(writer, checkpoint):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.mark.parametrize("by", [[], ["key"]])
def test_stream_windows_equal_batch(spark, tmp_path, by):
    df = spark.range(200).select(
        F.col("id").alias("idx"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("key"),
        F.array(F.col("id").cast("double")).alias("x"), (F.col("id") % 17 == 0).alias("is_anomaly"),
    )
    write_parts(spark, df, str(tmp_path / "in"), [3, 60, 1, 70, 66])
    source = stream_of(spark, df, str(tmp_path / "in"))
    writer = count_windows_stream(source, 4, ["idx"], str(tmp_path / "state"), parquet_windows(str(tmp_path / "out")), by=by)
    finish(writer, str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    rows = df.toPandas()
    expected = set()
    for key, part in rows.groupby("key") if by else [((), rows)]:
        part = part.sort_values("idx")
        for w in range(len(part) // 4):
            cut = part.iloc[w * 4 : w * 4 + 4]
            expected.add((key, w, tuple(v[0] for v in cut.x), bool(cut.is_anomaly.any())))
    found = {(r.key if by else (), r.w, tuple(v[0] for v in r.xs), r.is_anomaly) for r in got.itertuples()}
    assert found == expected and len(got) == len(expected)


def test_stream_adapts_like_the_replay_and_restarts(spark, tmp_path):
    x, bad = wave(4000, 3, 1, 2700, 96)
    p = settings(1, 3, 8)
    s = indexed(spark, x, np.flatnonzero(bad).tolist())
    model = initialize(s, p)
    expected = {tuple(r) for r in replay_online(s, model, p).windows.collect()}
    rest = s.filter(F.col("idx") >= p.init_rows).withColumn("idx", F.col("idx") - p.init_rows)
    source = str(tmp_path / "in")
    write_parts(spark, rest, source, [700, 13, 500])

    def run():
        writer = stream_online(stream_of(spark, rest, source), model, p, ["idx"], str(tmp_path / "run"), str(tmp_path / "out"))
        return finish(writer, str(tmp_path / "check"))

    run()
    late = rest.filter(F.col("idx") >= 1213)
    late.coalesce(1).write.parquet(f"{source}/part=3")
    query = run()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("w", "batch", "is_anomaly", "score_max", "n_over", "flagged", "version").collect()]
    assert len(got) == len(expected)
    exact = {(w, b, a, round(sc, 9), n, f, v) for w, b, a, sc, n, f, v in got}
    assert exact == {(w, b, a, round(sc, 9), n, f, v) for w, b, a, sc, n, f, v in expected}
    log_progress(spark, query, str(tmp_path / "log"), "stream")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_repeated_micro_batch_changes_nothing(spark, tmp_path):
    from tidewatch.streaming.windows import cut_windows

    def rows(a, b):
        return spark.range(a, b).select(F.col("id").alias("idx"), F.array(F.col("id").cast("double")).alias("x"), F.lit(False).alias("is_anomaly"))

    state = str(tmp_path / "state")
    first = {r.w for r in cut_windows(rows(0, 11), 0, 4, ["idx"], state, [], 1).collect()}
    once = {(r.w, r.xs[0][0]) for r in cut_windows(rows(11, 30), 1, 4, ["idx"], state, [], 1).collect()}
    again = {(r.w, r.xs[0][0]) for r in cut_windows(rows(11, 30), 1, 4, ["idx"], state, [], 1).collect()}
    assert first == {0, 1} and once == again == {(w, w * 4.0) for w in range(2, 7)}


def test_tasks_need_no_installed_copy(spark):
    """Functions sent to tasks carry the package code with them."""
    from pyspark import cloudpickle

    from tidewatch.models.lstm import _forward

    assert b"tidewatch.models.lstm\x94\x8c\x08_forward" not in cloudpickle.dumps(_forward)


def test_index_by_two_orders(spark):
    df = spark.range(50).select((F.col("id") % 5).alias("a"), F.col("id").alias("b"))
    got = with_index(df, [F.desc("a"), "b"]).orderBy("idx").collect()
    assert [(r.a, r.b) for r in got] == sorted(((r.a, r.b) for r in got), key=lambda p: (-p[0], p[1]))
