"""Reconstruction models against NumPy."""

import numpy as np
import pytest

from tidewatch.models import lstm
from tidewatch.models.base import Model, reconstruct, reconstruction_errors, score
from tidewatch.models.lstm import Recurrent, _forward, _initial, _layout, _unpack, loss_and_gradient
from tidewatch.models.pca import Linear
from tidewatch.models.profile import Profile
from tidewatch.operators.errors import ErrorModel, mse
from tidewatch.plans.online import anomalous_batches
from tidewatch.plans.params import Params, params
from tidewatch.sources.models import load_model, save_model, train_metrics
from tests.test_operators import make_windows

RNG = np.random.default_rng(5)


def sig(z):
    return 1 / (1 + np.exp(-z))


def slow_forward(x, numbers, hidden):
    """One window, one gate at a time."""
    length, width = x.shape
    p = _unpack(numbers, hidden, width)

    def step(side, v, h, c):
        z = np.hstack([v, h]) @ p[f"{side}_kernel"] + p[f"{side}_bias"]
        w = p[f"{side}_peep"]
        i = sig(z[:hidden] + w[0] * c)
        f = sig(z[2 * hidden : 3 * hidden] + 1 + w[1] * c)
        new = f * c + i * np.tanh(z[hidden : 2 * hidden])
        return sig(z[3 * hidden :] + w[2] * new) * np.tanh(new), new

    h = c = np.zeros(hidden)
    for t in range(length):
        h, c = step("enc", x[t], h, c)
    out, fed = [], np.ones(width)
    for t in reversed(range(length)):
        h, c = step("dec", fed, h, c)
        out.append(h @ p["out_kernel"] + p["out_bias"])
        fed = x[t]
    return np.array(out[::-1])


def test_forward():
    x, numbers = RNG.normal(size=(3, 6, 2)), _initial(4, 2, 1)
    numbers = numbers + 0.1 * RNG.normal(size=numbers.shape)
    got = _forward(x, _unpack(numbers, 4, 2))
    assert np.allclose(got, [slow_forward(w, numbers, 4) for w in x])


def test_windows_beyond_a_slice():
    x, numbers = RNG.normal(size=(2 * lstm.SLICE + 3, 3, 2)), _initial(2, 2, 1)
    got, at = _forward(x, _unpack(numbers, 2, 2)), [0, lstm.SLICE - 1, lstm.SLICE, 2 * lstm.SLICE, len(x) - 1]
    assert np.allclose(got[at], [slow_forward(x[k], numbers, 2) for k in at])
    assert _forward(x[:0], _unpack(numbers, 2, 2)).shape == (0, 3, 2)


def test_a_refit_makes_its_tapes_once(monkeypatch):
    """One for each size of batch, and for the sets that are watched, whatever the number of epochs."""
    x, y = RNG.random((10, 4, 1)), RNG.random((5, 4, 1))
    made, real = [], lstm._Pair.__init__
    monkeypatch.setattr(lstm._Pair, "__init__", lambda self, places, h, length, d, n, learns: (made.append(n), real(self, places, h, length, d, n, learns))[1])
    fitted = Recurrent.initial(4, 1, 2).refit_arrays(x, 4, max_epochs=6, validation=x[-4:], anomalous=y)
    assert sorted(made) == [2, 4, 9] and len(fitted.history) == 6
    start = Recurrent.initial(4, 1, 2).refit_arrays(x, 4, max_epochs=1, validation=x[-4:], anomalous=y)
    for part, loss in ((x[-4:], start.history[0][2]), (y, start.history[0][3])):
        assert loss == pytest.approx(np.mean([(slow_forward(w, start.numbers, 2) - w) ** 2 for w in part]))


def test_gradient():
    x, numbers = RNG.normal(size=(3, 5, 2)), _initial(3, 2, 1)
    numbers = numbers + 0.1 * RNG.normal(size=numbers.shape)
    _, gradient = loss_and_gradient(x, numbers, 3)
    for k in range(len(numbers)):
        up, down = numbers.copy(), numbers.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (loss_and_gradient(x, up, 3)[0] - loss_and_gradient(x, down, 3)[0]) / 2e-5
        assert gradient[k] == pytest.approx(slope, abs=1e-7)


def test_initial_values():
    p = _unpack(_initial(15, 4, 0), 15, 4)
    assert sum(v.size for v in p.values()) == sum(int(np.prod(s)) for _, s in _layout(15, 4))
    assert np.all(p["out_bias"] == 0.1) and np.all(p["enc_bias"] == 0)
    assert np.abs(p["out_kernel"]).max() <= 2 and np.abs(p["enc_kernel"]).max() <= np.sqrt(6 / (19 + 60))


def test_one_shard_is_sequential_training(spark):
    x = RNG.random((22, 5, 2))
    fitted = Recurrent.fit(make_windows(spark, x), 3, per_batch=4, max_epochs=3, shards=1, seed=2)
    w, m, v = _initial(3, 2, 2), 0.0, 0.0
    order, steps, losses = np.arange(21, -1, -1), 0, []
    for _ in range(3):
        seen = []
        for at in range(0, 22, 4):
            loss, g = loss_and_gradient(x[order[at : at + 4]], w, 3)
            steps += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.001 * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8 / np.sqrt(1 - 0.999**steps))
            seen.append(loss)
        losses.append(np.mean(seen))
    assert np.allclose(fitted.numbers, w, atol=1e-9)
    assert [h[1] for h in fitted.history] == pytest.approx(losses)


def test_more_shards_still_learn(spark):
    x = RNG.random((96, 5, 1)) * 0.1 + np.linspace(0, 1, 5)[None, :, None]
    w = make_windows(spark, x)
    start = Recurrent.initial(5, 1, 4, 0)
    fitted = Recurrent.fit(w, 4, validation=w, per_batch=4, max_epochs=6, shards=3)
    assert fitted.validate(w) < start.validate(w)
    assert fitted.history[-1][2] == pytest.approx(fitted.validate(w))


def test_weights_do_not_depend_on_partitions(spark):
    w = make_windows(spark, RNG.random((40, 4, 2)))
    one, many = (Recurrent.fit(w.repartition(n), 3, per_batch=4, max_epochs=2, shards=3, seed=1) for n in (2, 8))
    assert np.allclose(one.numbers, many.numbers, atol=1e-9) and np.allclose(one.optimizer, many.optimizer, atol=1e-9)


def test_update_goes_on_with_the_optimizer_state(spark):
    x = RNG.random((12, 4, 1))
    w = make_windows(spark, x)
    fitted = Recurrent.fit(w, 2, per_batch=4, max_epochs=2, shards=1, seed=3)
    updated = fitted.refit(w, 4, max_epochs=2, shards=1)
    numbers, state, steps = _initial(2, 1, 3), [0.0, 0.0], 0
    for order in [np.arange(11, -1, -1)] * 2 + [np.arange(12)] * 2:
        for at in range(0, 12, 4):
            _, g = loss_and_gradient(x[order[at : at + 4]], numbers, 2)
            steps += 1
            state = [0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g * g]
            rate = 0.001 * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            numbers = numbers - rate * state[0] / (np.sqrt(state[1]) + 1e-8)
    assert np.allclose(updated.numbers, numbers, atol=1e-9)
    assert updated.optimizer[-1] == steps
    again = Recurrent.restore(4, 1, 2, fitted.parameters(), fitted.optimizer.tolist()).refit(w, 4, max_epochs=2, shards=1)
    assert np.allclose(again.numbers, numbers, atol=1e-9)


def test_watched_sets_give_losses_by_epoch_and_change_nothing(spark):
    rng = np.random.default_rng(6)
    x, y = rng.random((12, 4, 1)), rng.random((3, 4, 1)) * 3
    w, odd = make_windows(spark, x), make_windows(spark, y)
    batches = anomalous_batches(odd, 8)
    assert [r["w"] for r in batches.orderBy("rank").collect()] == [0, 1, 2, 0, 1, 2, 0, 1]
    assert anomalous_batches(odd.limit(0), 8) is None
    start = Recurrent.fit(w, 2, per_batch=4, max_epochs=1, shards=1, seed=3)
    plain = start.refit(w, 4, max_epochs=4, min_delta=10.0, patience=2)
    watched = start.refit(w, 4, max_epochs=4, min_delta=10.0, patience=2, validation=w.filter("w >= 8"), anomalous=batches)
    assert np.allclose(plain.numbers, watched.numbers, atol=1e-12)
    assert [h[1] for h in watched.history] == pytest.approx([h[1] for h in plain.history]) and plain.history[-1][2:] == (None, None)
    kernel = watched.kernel()
    repeated = np.concatenate([y, y, y[:2]])
    assert watched.history[-1][2] == pytest.approx(float(((kernel(x[8:]) - x[8:]) ** 2).mean()))
    assert watched.history[-1][3] == pytest.approx(float(((kernel(repeated) - repeated) ** 2).mean()))
    assert len({h[3] for h in watched.history}) == len(watched.history)


def test_early_stop_restores_best(spark):
    x = RNG.random((8, 4, 1))
    w = make_windows(spark, x)
    fitted = Recurrent.fit(w, 2, validation=w, per_batch=4, max_epochs=50, patience=1, min_delta=10.0, shards=1)
    assert len(fitted.history) == 2
    again = fitted.refit(w, 4, max_epochs=50, patience=2, min_delta=10.0, shards=1)
    assert len(again.history) == 3


def test_pca(spark):
    x = RNG.normal(size=(60, 4, 3)) @ RNG.normal(size=(3, 3))
    fitted = Linear.fit(make_windows(spark, x), 2)
    flat = x.reshape(60, -1)
    centred = flat - flat.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    expected = flat.mean(axis=0) + centred @ vt[:2].T @ vt[:2]
    got = reconstruct(make_windows(spark, x), fitted).orderBy("w").collect()
    assert np.allclose(np.array([r.xhat for r in got]).reshape(60, -1), expected)


@pytest.mark.parametrize("width", [2, 11])
def test_profile(spark, width):
    x = RNG.random((7, 4, width))
    w = make_windows(spark, x)
    fitted = Profile.fit(w)
    assert np.allclose(fitted.rows(), x.mean(axis=0))
    errs = reconstruction_errors(w, fitted).orderBy("w").collect()
    assert np.allclose([r.errs for r in errs], np.abs(x - x.mean(axis=0)))
    assert mse(reconstruct(w, fitted)).first().mse == pytest.approx(((x - x.mean(axis=0)) ** 2).mean())


@pytest.mark.parametrize("width", [2, 11])
@pytest.mark.parametrize("scaled", [True, False])
def test_score_in_one_pass(spark, width, scaled):
    x = RNG.random((7, 4, width))
    x[:, :, 0] = 0.5
    fitted = Profile.fit(make_windows(spark, x))
    a = RNG.normal(size=(width, width))
    model = Model(fitted, ErrorModel([0.1] * width, (a @ a.T).tolist()))
    got = score(make_windows(spark, x), model, scale_window=scaled, keep_errors=True).orderBy("w").collect()
    low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    z = np.where(high > low, (x - low) / np.where(high > low, high - low, 1), 0) if scaled else x
    errs = np.abs(z - np.array(fitted.rows()))
    c = errs - 0.1
    assert np.allclose([r.errs for r in got], errs)
    assert np.allclose([r.xs for r in got], z)
    assert np.allclose([r.scores for r in got], np.sqrt(np.einsum("nti,ij,ntj->nt", c, a @ a.T, c)))


def test_model_store(spark, tmp_path):
    settings = Params(4, 8, 2, 3, 100, 1, 2)
    w = make_windows(spark, RNG.random((20, 4, 3)))
    root = str(tmp_path)
    for version, rec in enumerate([Profile.fit(w), Linear.fit(w, 2), Recurrent.initial(4, 3, 2)]):
        model = Model(rec, ErrorModel([0.1] * 3, np.eye(3).tolist(), 0.5), version, ([0.0] * 3, [1.0] * 3), [(0, 0.5, None)])
        save_model(spark, model, root, settings)
        save_model(spark, model, root, settings)
        back = load_model(spark, root, settings)
        assert back.version == version and back.reconstructor.kind == rec.kind
        assert back.errors == model.errors and back.bounds == model.bounds
        x = RNG.random((2, 4, 3))
        assert np.allclose(back.reconstructor.kernel()(x), rec.kernel()(x))
    assert load_model(spark, root, settings, 1).reconstructor.kind == "pca"
    assert train_metrics(spark, root, settings).count() == 3
    save_model(spark, Model(rec, model.errors, 3, None, [(0, 0.5, None, None), (1, 0.25, 0.5, 2.0)]), root, settings)
    rows = train_metrics(spark, root, settings).filter("version = 3").orderBy("epoch").collect()
    assert [tuple(r) for r in rows] == [(3, 0, 0.5, None, None), (3, 1, 0.25, 0.5, 2.0)]


def test_params():
    assert params("http").but(kind="pca").length == 30
    with pytest.raises(ValueError, match="known are"):
        params("unknown")
