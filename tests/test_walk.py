"""Versions that follow each other after a few batches."""

import numpy as np
import pytest

from tests.test_jobs import CASES, by_hand, indexed, settings, wave
from tidewatch.plans import online, walk
from tidewatch.plans.initialize import initialize
from tidewatch.plans.online import replay_online
from tidewatch.sources.models import load_model, train_metrics


def jobs_of(spark, name, run):
    """What ``run`` returns, and the number of Spark jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def rows_of(replay):
    return [(r.w, r.batch, r.is_anomaly, r.version, r.flagged, r.n_over, round(r.score_max, 9)) for r in replay.windows.orderBy("w").collect()]


@pytest.mark.parametrize("leg", [None, 7])
@pytest.mark.parametrize("d, hard, capacity, anomalies, updates", CASES)
def test_legs_give_the_sequential_result(spark, monkeypatch, leg, d, hard, capacity, anomalies, updates):
    """Also if versions outlive a leg, or a leg ends after one update."""
    if leg:
        monkeypatch.setattr(online, "leg_batches", lambda params: leg)
    x, bad = wave(4000, 3, d, 2700, anomalies * 4)
    p = settings(d, hard, capacity).but(look_ahead=None)
    s = indexed(spark, x, np.flatnonzero(bad).tolist())
    _, expected, expert, version = by_hand(x, bad, p)
    replay = replay_online(s, initialize(s, p), p)
    got = replay.windows.orderBy("w").collect()
    assert replay.updates == version >= updates
    assert [(r.w, r.version, r.flagged) for r in got] == [(k, v, f) for k, v, _, f in expected]
    assert np.allclose([r.score_max for r in got], [s for _, _, s, _ in expected])
    assert [r.is_anomaly for r in got] == expert.tolist()


def test_many_versions_take_few_jobs(spark):
    x, bad = wave(6000, 3, 1, 2400, 400)
    p = settings(1, 1, 1).but(look_ahead=None)
    s = indexed(spark, x, np.flatnonzero(bad).tolist())
    model = initialize(s, p)
    replay, jobs = jobs_of(spark, "walk", lambda: replay_online(s, model, p))
    assert replay.updates >= 10 and jobs < 2 * replay.updates
    assert rows_of(replay) == rows_of(replay_online(s, model, p.but(look_ahead=8)))


def test_recurrent_versions_and_their_losses_are_the_same(spark, tmp_path):
    x, bad = wave(2400, 5, 2, 2000, 60)
    p = settings(2, 1, 4).but(kind="lstm", max_epochs=1, update_epochs=3, watch_updates=True)
    s = indexed(spark, x, np.flatnonzero(bad).tolist())
    model, found = initialize(s, p), {}
    for name, q in (("legs", p.but(look_ahead=None)), ("jobs", p)):
        root = str(tmp_path / name)
        replay = replay_online(s, model, q, root=root)
        assert load_model(spark, root, q).version == replay.updates >= 1
        losses = train_metrics(spark, root, q).orderBy("version", "epoch").collect()
        found[name] = rows_of(replay), [(r.version, r.epoch) for r in losses], np.array([r[2:] for r in losses], float)
    assert found["legs"][:2] == found["jobs"][:2]
    assert np.allclose(found["legs"][2], found["jobs"][2], rtol=1e-6) and not np.isnan(found["legs"][2]).any()


def test_a_leg_ends_after_some_updates(spark, monkeypatch):
    x, bad = wave(6000, 3, 1, 2400, 400)
    p = settings(1, 1, 1).but(look_ahead=None)
    s = indexed(spark, x, np.flatnonzero(bad).tolist())
    model = initialize(s, p)
    expected = rows_of(replay_online(s, model, p))
    monkeypatch.setattr(online, "LEG_UPDATES", 3)
    ends = walk._leg
    monkeypatch.setattr(walk, "_leg", lambda *args: ends(*args, most=3))
    assert rows_of(replay_online(s, model, p)) == expected
