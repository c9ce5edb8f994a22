"""Reconstruction by a recurrent encoder-decoder, fitted as one Spark job per epoch.

The encoder reads a window step by step; the decoder starts from its final state and gives
the steps back from the last to the first, being fed ones first and then the true later
step.  Both cells have peephole connections; the loss is the mean squared error.

Fitting splits the batches over ``shards`` partitions.  In an epoch every shard walks
through its batches with Adam, starting from the common state, and Spark averages the
resulting states weighted by windows.  One shard is plain sequential training.  The number
of shards is a parameter: it never follows the data or the cluster, so neither do the weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.arrow import list_column, tensor
from tidewatch.models.base import flat, window_width
from tidewatch.operators.sampling import arrival_batches, reverse_batches

# fixed values: forget bias, output bias, and the usual Adam settings
FORGET_BIAS, OUTPUT_BIAS = 1.0, 0.1
RATE, BETA1, BETA2, EPSILON = 0.001, 0.9, 0.999, 1e-8
# windows that are reconstructed at a time, so that their steps stay in a core's cache
SLICE = 256
ONE = np.array(1.0)


def _layout(hidden: int, width: int) -> list[tuple[str, tuple[int, ...]]]:
    cell = [("kernel", (width + hidden, 4 * hidden)), ("bias", (4 * hidden,)), ("peep", (3, hidden))]
    return [(f"{side}_{name}", shape) for side in ("enc", "dec") for name, shape in cell] + [
        ("out_kernel", (hidden, width)),
        ("out_bias", (width,)),
    ]


def _unpack(numbers: np.ndarray, hidden: int, width: int) -> dict[str, np.ndarray]:
    views, at = {}, 0
    for name, shape in _layout(hidden, width):
        size = math.prod(shape)
        views[name] = numbers[at : at + size].reshape(shape)
        at += size
    return views


def _initial(hidden: int, width: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for name, shape in _layout(hidden, width):
        if name.endswith("_bias"):
            value = np.full(shape, OUTPUT_BIAS if name == "out_bias" else 0.0)
        elif name == "out_kernel":
            value = rng.standard_normal(shape)
            while (wide := np.abs(value) > 2).any():
                value[wide] = rng.standard_normal(int(wide.sum()))
        else:
            fan = hidden * 2 if name.endswith("_peep") else sum(shape)
            limit = math.sqrt(6 / fan)
            value = rng.uniform(-limit, limit, shape)
        parts.append(value.ravel())
    return np.concatenate(parts)


class _Places:
    """The matrices of a training step as one gather from the flat weights, and the gradient as one from their gradients.

    Gates lie in the order input, forget, candidate, output.  A sigmoid is a tanh of half the value, and outputs are
    kept doubled, so that a step needs few calls; the halves are factors of the matrices.  The peepholes of input and
    forget gate are two diagonals beside the weights of state, output, input and bias.
    """

    def __init__(self, hidden: int, width: int):
        size = hidden
        total = sum(math.prod(shape) for _, shape in _layout(size, width))
        at = _unpack(np.arange(total), size, width)
        gates = np.concatenate([np.arange(size), np.arange(2 * size, 3 * size), np.arange(size, 2 * size), np.arange(3 * size, 4 * size)])
        # columns as in the rows of a tape from the state on: state, (output gate), output, input, one
        state, out, fed, diagonal = slice(0, size), slice(2 * size, 3 * size), slice(3 * size, 3 * size + width), np.arange(size)
        last = [np.zeros((width, size + width + 1), d) for d in (int, float, float)]
        last[0][:, :size], last[1][:, :size] = at["out_kernel"].T, 0.5
        last[0][:, -1], last[1][:, -1] = at["out_bias"], 1.0
        parts, self.count, self.raw = [], [], []
        for side, ends in (("enc", 0), ("dec", width)):
            kernel = [np.zeros((4 * size, 3 * size + width + 1), d) for d in (int, float, float)]
            place, factor, plus = kernel
            half = np.full((4 * size, 1), 0.5)
            half[2 * size : 3 * size] = 1.0
            place[:, out], factor[:, out] = at[f"{side}_kernel"].T[gates][:, width:], 0.5 * half
            place[:, fed], factor[:, fed] = at[f"{side}_kernel"].T[gates][:, :width], half
            place[:, -1], factor[:, -1], plus[size : 2 * size, -1] = at[f"{side}_bias"][gates], half[:, 0], 0.5 * FORGET_BIAS
            for k in range(2):
                place[k * size + diagonal, diagonal], factor[k * size + diagonal, diagonal] = at[f"{side}_peep"][k], 0.5
            late = [np.zeros((2, size, 1), d) for d in (int, float, float)]
            late[0][1, :, 0], late[1][1], late[2][0] = at[f"{side}_peep"][2], 0.25, 0.5
            back = [np.zeros((2 * size, 6 * size + ends), d) for d in (int, float, float)]
            for b, k, end in zip(back, kernel, last, strict=True):
                b[:size, size : 5 * size], b[size:, size : 5 * size] = k[:, out].T, k[:, state].T
                if ends:
                    b[:size, 6 * size :] = end[:, :size].T
            back[1][size:] *= 0.5
            back[2][size:] *= 0.5
            back[2][size + diagonal, diagonal] = 0.5
            parts += [kernel, late, back]
        parts.append(last)
        self.shapes = [part[0].shape for part in parts]
        self.place, self.factor, self.plus = (np.concatenate([part[k].ravel() for part in parts]) for k in range(3))
        # raw gradients: of the kernel, and of the output gate's peephole, of each side; of the last product
        self.raw_shapes, seen = [], []
        for kernel, late, _ in (parts[:3], parts[3:6]):
            self.raw_shapes += [kernel[0].shape, (size,)]
            seen += [(kernel[0], kernel[1]), (late[0][1], np.full((size, 1), 0.5))]
        self.raw_shapes.append(last[0].shape)
        seen.append((last[0], last[1]))
        place, factor = (np.concatenate([s[k].ravel() for s in seen]) for k in range(2))
        used = np.flatnonzero(factor)
        self.source, self.weight = np.empty(total, int), np.empty(total)
        self.source[place[used]], self.weight[place[used]] = used, factor[used]


def _views(flat_numbers: np.ndarray, shapes) -> list[np.ndarray]:
    views, at = [], 0
    for shape in shapes:
        views.append(flat_numbers[at : at + math.prod(shape)].reshape(shape))
        at += math.prod(shape)
    return views


class _Cells:
    """All steps of one side over a batch of windows, and their gradient.

    Training batches are small, so calls cost more than numbers: the rows of ``tape`` are input, forget and candidate gate,
    state, output gate and output (doubled) before the step, input, and one; every view is made once.
    """

    def __init__(self, kernel, late, back, steps: int, size: int, width: int, n: int):
        self.kernel, self.late, self.back, self.size = kernel, late, back, size
        self.spread = np.empty((2, size, n))  # ``late`` for every window
        self.tape, self.tanh = np.zeros((steps + 1, 6 * size + width + 1, n)), np.empty((steps, 2, size, n))
        self.tape[:, -1] = 1.0
        self.fed = self.tape[:-1, 6 * size : -1]
        self.z, both = np.empty((4 * size, n)), np.empty((2 * size, n))
        self.parts, self.double = (both[:size], both[size:]), both
        self.steps = [
            (now[3 * size :], now[: 3 * size], now[: 2 * size], now[2 * size : 4 * size], new[3 * size : 5 * size].reshape(2, size, n),
             new[4 * size : 5 * size], tanh, tanh[0], tanh[1], new[5 * size : 6 * size])
            for now, new, tanh in zip(self.tape[:-1], self.tape[1:], self.tanh, strict=True)
        ]
        self.first, self.last = self.tape[0, 3 * size : 6 * size], self.tape[-1, 3 * size : 6 * size]

    def run(self) -> None:
        kernel, late, z, both, (i_j, f_c) = self.kernel, self.spread, self.z, self.double, self.parts
        late[:] = self.late
        gates, output = z[: 3 * self.size], z[3 * self.size :]
        for seen, made, two, with_two, state_o, o, tanh, of_state, of_o, h in self.steps:
            kernel.dot(seen, z)
            np.tanh(gates, out=made)
            two += ONE
            np.multiply(two, with_two, out=both)
            i_j += f_c
            np.multiply(late, i_j, out=state_o)
            o += output
            np.tanh(state_o, out=tanh)
            of_o += ONE
            np.multiply(of_state, of_o, out=h)

    def prepare(self, n: int) -> None:
        """Room for the gradient.  The rows of ``d`` are state before, input, forget, candidate, output gate, what the output adds to the state, and the output of the step before."""
        size, steps = self.size, len(self.steps)
        self.d = np.zeros((steps + 1, self.back.shape[1], n))
        self.inside, self.outer = np.empty((steps, 4, size, n)), np.empty((steps, 2, size, n))
        self.backwards = [
            (d[4 * size : 6 * size].reshape(2, size, n), d[5 * size : 6 * size], d[: 4 * size].reshape(4, size, n), d, outer, inside)
            for d, outer, inside in zip(self.d[:-1], self.outer, self.inside, strict=True)
        ][::-1]
        self.changed = np.empty((size, n))

    def gradient(self, carry: np.ndarray, raw: np.ndarray, raw_late: np.ndarray) -> None:
        """``carry`` is the gradient of the last output and state and becomes that of the first; those of the weights go to ``raw`` and ``raw_late``."""
        size, steps, back, changed = self.size, len(self.steps), self.back, self.changed
        now = self.tape[:-1].reshape(steps, -1)
        n = self.tape.shape[2]
        two, with_two = (now[:, k * size * n : (k + 2) * size * n].reshape(steps, 2, size, n) for k in (0, 2))
        j, (q, r), inside, outer = with_two[:, 0], self.tanh.swapaxes(0, 1), self.inside, self.outer
        np.multiply(q, r, out=outer[:, 0])
        outer[:, 0] *= 2.0 - r
        np.multiply(0.5 * r, 1.0 - q * q, out=outer[:, 1])
        outer[:, 1] += self.spread[1] * outer[:, 0]
        inside[:, 0] = two[:, 1]
        np.multiply(two * (2.0 - two), with_two, out=inside[:, 1:3])
        np.multiply(two[:, 0], 1.0 - j * j, out=inside[:, 3])
        dh, dc = carry[:size], carry[size:]
        for to_o, o_to_c, to_z, d, by_h, by_c in self.backwards:
            np.multiply(dh, by_h, out=to_o)
            np.add(dc, o_to_c, out=changed)
            np.multiply(changed, by_c, out=to_z)
            back.dot(d, carry)
        rows = self.d[:-1, size : 5 * size].transpose(1, 0, 2).reshape(4 * size, -1)
        seen = self.tape[:-1, 3 * size :].transpose(1, 0, 2).reshape(-1, steps * n)
        np.matmul(rows, seen.T, out=raw)
        np.einsum("tsn,tsn->s", self.d[:-1, 4 * size : 5 * size], self.tape[1:, 3 * size : 4 * size], out=raw_late)


class _Pair:
    """Encoder and decoder over batches of ``n`` windows; matrices, tapes and views are made once and used again."""

    def __init__(self, places: _Places, hidden: int, length: int, width: int, n: int, learns: bool):
        self.places, self.matrices, self.size = places, np.empty(len(places.place)), hidden
        *sides, self.last = _views(self.matrices, places.shapes)
        self.enc, self.dec = (_Cells(*sides[k : k + 3], length, hidden, width, n) for k in (0, 3))
        self.dec.fed[0] = 1.0
        self.outputs = self.dec.tape[1:, 5 * hidden :]
        if learns:
            self.enc.prepare(n)
            self.dec.prepare(n)
            self.flat_raw = np.empty(sum(math.prod(shape) for shape in places.raw_shapes))
            self.raw = _views(self.flat_raw, places.raw_shapes)
            self.carry = np.empty((2 * hidden, n))

    def load(self, numbers: np.ndarray) -> None:
        np.take(numbers, self.places.place, out=self.matrices, mode="clip")
        self.matrices *= self.places.factor
        self.matrices += self.places.plus

    def forward(self, steps: np.ndarray) -> np.ndarray:
        """Reconstruction of windows (step, feature, window), from the last step to the first, as the decoder gives it."""
        self.enc.fed[:], self.dec.fed[1:] = steps, steps[:0:-1]
        self.enc.run()
        self.dec.first[:] = self.enc.last
        self.dec.run()
        return np.matmul(self.last, self.outputs)

    def loss_and_gradient(self, x: np.ndarray, numbers: np.ndarray) -> tuple[float, np.ndarray]:
        steps = x.transpose(1, 2, 0)
        self.load(numbers)
        diff = self.forward(steps)
        diff -= steps[::-1]
        dout, (enc, enc_late, dec, dec_late, last), width = self.dec.d[1:, 6 * self.size :], self.raw, x.shape[2]
        np.multiply(diff, 2 / diff.size, out=dout)
        np.matmul(self.dec.back, self.dec.d[-1], out=self.carry)
        self.dec.gradient(self.carry, dec, dec_late)
        self.enc.gradient(self.carry, enc, enc_late)
        rows = dout.transpose(1, 0, 2).reshape(width, -1)
        np.matmul(rows, self.outputs.transpose(1, 0, 2).reshape(-1, rows.shape[1]).T, out=last)
        return float((diff * diff).mean()), self.flat_raw[self.places.source] * self.places.weight


class _Pairs:
    """A ``_Pair`` for each size of batch."""

    def __init__(self, hidden: int, length: int, width: int, learns: bool = False):
        self.shape, self.learns, self.places, self.made = (hidden, length, width), learns, _Places(hidden, width), {}

    def __call__(self, n: int) -> _Pair:
        if n not in self.made:
            self.made[n] = _Pair(self.places, *self.shape, n, self.learns)
        return self.made[n]


def _reconstruct(x: np.ndarray, numbers: np.ndarray, pairs: _Pairs) -> np.ndarray:
    """Reconstruction of windows, ``SLICE`` of them at a time."""
    out = np.empty_like(x)
    for at in range(0, len(x), SLICE):
        part = x[at : at + SLICE]
        pair = pairs(len(part))
        if at == 0 or len(part) < SLICE:
            pair.load(numbers)
        out[at : at + SLICE] = pair.forward(part.transpose(1, 2, 0))[::-1].transpose(2, 0, 1)
    return out


def _forward(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    return _reconstruct(x, np.concatenate([v.ravel() for v in p.values()]), _Pairs(p["out_kernel"].shape[0], *x.shape[1:]))


def loss_and_gradient(x: np.ndarray, numbers: np.ndarray, hidden: int) -> tuple[float, np.ndarray]:
    """Mean squared reconstruction error of a batch and its gradient."""
    return _Pairs(hidden, *x.shape[1:], learns=True)(len(x)).loss_and_gradient(x, numbers)


def _whole_batches(arrow_batches, length: int, width: int):
    """Regroup Arrow batches of (batch, xs) into the training batches they were sorted by."""
    ids, rest = np.empty(0, np.int64), np.empty((0, length, width))
    for ab in arrow_batches:
        ids = np.concatenate([ids, ab.column(0).to_numpy()])
        rest = np.concatenate([rest, tensor(ab.column(1), length, width)])
        cuts = np.flatnonzero(np.diff(ids)) + 1
        start = 0
        for cut in cuts:
            yield rest[start:cut]
            start = cut
        ids, rest = ids[start:], rest[start:]
    if len(rest):
        yield rest


def _steps(batches, state: np.ndarray, pairs: _Pairs) -> tuple[int, np.ndarray]:
    """Adam over the batches, one after the other: windows seen, and the state after them (weights, moments, steps, mean and last loss)."""
    size = (len(state) - 3) // 3
    w, m, v = (state[k * size : (k + 1) * size].copy() for k in range(3))
    steps, seen, total, count, last = state[-3], 0, 0.0, 0, 0.0
    for x in batches:
        last, g = pairs(len(x)).loss_and_gradient(x, w)
        steps += 1
        m += (1 - BETA1) * (g - m)
        v += (1 - BETA2) * (g * g - v)
        w -= RATE * math.sqrt(1 - BETA2**steps) / (1 - BETA1**steps) * m / (np.sqrt(v) + EPSILON)
        seen, total, count = seen + len(x), total + last, count + 1
    return seen, np.concatenate([w, m, v, [steps, total / max(count, 1), last]])


def _epoch(train: DataFrame, state: np.ndarray, hidden: int, length: int, width: int) -> np.ndarray:
    """One pass of all shards over their batches; returns the averaged state."""

    def run(arrow_batches):
        seen, result = _steps(_whole_batches(arrow_batches, length, width), state, _Pairs(hidden, length, width, learns=True))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), list_column(result[None])], names=["n", "state"])

    averaged = (
        train.select("batch", "xs")
        .mapInArrow(run, "n double, state array<double>")
        .select("n", F.posexplode("state").alias("k", "value"))
        .groupBy("k")
        .agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("value"))
        .toArrow()
    )
    result = np.empty(len(state))
    result[averaged["k"].to_numpy()] = averaged["value"].to_numpy()
    return result


@dataclass(frozen=True)
class Recurrent:
    length: int
    width: int
    hidden: int
    numbers: np.ndarray
    history: tuple[tuple[int, float, float | None, float | None], ...] = ()  # epoch, loss, those of normal and of anomalous windows kept out
    optimizer: np.ndarray | None = None  # Adam's two moments and its step count; None: not trained yet
    kind: str = "lstm"

    @classmethod
    def initial(cls, length: int, width: int, hidden: int, seed: int = 0) -> "Recurrent":
        return cls(length, width, hidden, _initial(hidden, width, seed))

    @classmethod
    def fit(
        cls, windows: DataFrame, hidden: int, validation: DataFrame | None = None, per_batch: int = 8,
        max_epochs: int = 6, patience: int = 20, min_delta: float = 1e-4, shards: int = 8, seed: int = 0,
        shape: tuple[int, int] | None = None, **_,
    ) -> "Recurrent":
        """Fit on normal windows, taken in batches from the last one backwards."""
        start = cls.initial(*(shape or window_width(windows)), hidden, seed)
        batches = reverse_batches(windows.select("w", "xs"), per_batch, full_only=False)
        return start._train(batches, max_epochs, patience, min_delta, shards, validation, by_validation=validation is not None)

    def refit(
        self, buffer: DataFrame, per_batch: int, max_epochs: int = 300, patience: int = 10, min_delta: float = 0.005,
        shards: int = 1, stop_metric: str = "last_batch", validation: DataFrame | None = None, anomalous: DataFrame | None = None, **_,
    ) -> "Recurrent":
        """Continue from the present weights and optimizer state on buffered windows in arrival order.

        With ``anomalous`` windows, every epoch's history has the losses of ``validation`` and of these; they don't
        decide when to stop.
        """
        batches = arrival_batches(buffer.select("w", "xs"), per_batch, full_only=False)
        return self._train(
            batches, max_epochs, patience, min_delta, shards,
            validation if stop_metric == "val_mean" or anomalous is not None else None, anomalous,
            by_validation=stop_metric == "val_mean" and validation is not None, last_batch=stop_metric == "last_batch",
        )

    def _train(self, batches, max_epochs, patience, min_delta, shards, validation=None, anomalous=None, by_validation=False, last_batch=False):
        """Epochs until ``patience`` of them in a row brought no drop above ``min_delta``.

        ``by_validation``, the loss of the validation set is watched, and the weights of its best epoch are restored after an early stop.
        """
        train = (
            batches.repartitionById(shards, (F.col("batch") % shards).cast("int"))
            .sortWithinPartitions("batch", "pos")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        sets = [d.select(F.lit(role).alias("role"), "xs") for role, d in (("normal", validation), ("anomalous", anomalous)) if d is not None]
        apart = reduce(DataFrame.unionByName, sets).persist(StorageLevel.MEMORY_AND_DISK) if sets else None
        try:
            return self._until_idle(
                lambda state: _epoch(train, state, self.hidden, self.length, self.width),
                None if apart is None else lambda model: model.losses(apart),
                max_epochs, patience, min_delta, by_validation, last_batch,
            )
        finally:
            train.unpersist()
            if apart is not None:
                apart.unpersist()

    def refit_arrays(
        self, train: np.ndarray, per_batch: int, max_epochs: int = 300, patience: int = 10, min_delta: float = 0.005,
        stop_metric: str = "last_batch", validation: np.ndarray | None = None, anomalous: np.ndarray | None = None, **_,
    ) -> "Recurrent":
        """``refit`` by one shard, inside a task, on buffered windows (n, length, width) in arrival order."""
        batches = [train[i : i + per_batch] for i in range(0, len(train), per_batch)]
        sets = {"normal": validation if stop_metric == "val_mean" or anomalous is not None else None, "anomalous": anomalous}
        sets = {role: x for role, x in sets.items() if x is not None and len(x)}
        pairs = _Pairs(self.hidden, self.length, self.width, learns=True)
        apart, ends = np.concatenate([train[:0], *sets.values()]), np.cumsum([len(x) for x in sets.values()])

        def losses(model):
            squared = ((_reconstruct(apart, model.numbers, pairs) - apart) ** 2).mean(axis=(1, 2))
            return {role: float(part.mean()) for role, part in zip(sets, np.split(squared, ends), strict=False)}

        return self._until_idle(
            lambda state: _steps(batches, state, pairs)[1], losses if sets else None,
            max_epochs, patience, min_delta, stop_metric == "val_mean" and validation is not None, stop_metric == "last_batch",
        )

    def _until_idle(self, epoch_of, losses_of, max_epochs, patience, min_delta, by_validation, last_batch) -> "Recurrent":
        size = len(self.numbers)
        moments = np.zeros(2 * size + 1) if self.optimizer is None else self.optimizer
        state = np.concatenate([self.numbers, moments, np.zeros(2)])
        history, best, best_loss, previous, idle = [], self.numbers, math.inf, math.inf, 0
        for epoch in range(max_epochs):
            state = epoch_of(state)
            weights = state[:size].copy()
            losses = {} if losses_of is None else losses_of(Recurrent(self.length, self.width, self.hidden, weights))
            checked = losses.get("normal")
            history.append((epoch, float(state[-2]), checked, losses.get("anomalous")))
            watched = checked if by_validation and checked is not None else float(state[-1] if last_batch else state[-2])
            if watched < best_loss:
                best, best_loss = weights, watched
            idle = 0 if epoch > 0 and previous - watched > min_delta else idle + 1
            previous = watched
            if epoch > 0 and idle > patience:
                if by_validation:
                    weights = best
                break
        return Recurrent(self.length, self.width, self.hidden, weights, tuple(history), state[size:-2].copy())

    def validate(self, windows: DataFrame) -> float | None:
        """Mean squared error over all windows, without changing the weights; None without windows."""
        return self.losses(windows.select(F.lit("all").alias("role"), "xs")).get("all")

    def losses(self, windows: DataFrame) -> dict[str, float]:
        """Mean squared error of the windows of every ``role``, in one pass; roles without windows are left out."""
        kernel, length, width = self.kernel(), self.length, self.width

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x = tensor(batch.column(1), length, width)
                    squared = ((kernel(x) - x) ** 2).mean(axis=(1, 2))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squared, pa.float64())], names=["role", "loss"])

        rows = windows.select("role", "xs").mapInArrow(run, "role string, loss double")
        return {r["role"]: r["loss"] for r in rows.groupBy("role").agg(F.avg("loss").alias("loss")).collect()}

    def expression(self) -> None:
        return None

    def kernel(self):
        numbers, hidden, length, width = flat(self.numbers), self.hidden, self.length, self.width
        return lambda x: _reconstruct(x, numbers, _Pairs(hidden, length, width))

    def parameters(self) -> list[float]:
        return flat(self.numbers).tolist()

    @classmethod
    def restore(
        cls, length: int, width: int, hidden: int, numbers: list[float], optimizer: list[float] | None = None
    ) -> "Recurrent":
        return cls(length, width, hidden, flat(numbers), optimizer=None if optimizer is None else flat(optimizer))
