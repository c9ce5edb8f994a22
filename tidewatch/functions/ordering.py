"""Exact order-based results over data of any size: running totals and order statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scratch import save

_POSITION_MASK = (1 << 33) - 1
# A rank's last FEW_ROWS rows are sorted on the driver; percentiles are exact to a share of 1 / ACCURACY.
FEW_ROWS, ACCURACY = 4096, 10_000


def sorted_table(
    df: DataFrame, keys: Sequence[Column | str], name: str, keep: Sequence[str] | None = None
) -> DataFrame:
    """Globally sorted copy of ``df`` with ``_pid`` (range partition) and ``_pos`` (row in it).

    ``keep`` names the columns to store; the others only serve the sort.  Ties in the key are
    broken by a hash of the whole row, so the order does not depend on what is stored.

    The row hash and the arrival number end the sort key, so equal keys and even exact
    copies spread over partitions instead of piling up in one.  The number of partitions is
    that of shuffles, less what adaptive execution merges.  The sort is written out: range
    bounds come from a sample, and the numbers must not change between reads.
    """
    columns = df.columns if keep is None else list(keep)
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    hashed = [f.name for f in df.schema if not _has_map(f.dataType)]
    tie = F.xxhash64(*hashed) if hashed else F.lit(0)
    tagged = df.withColumns({"_tie": tie, "_arrival": F.monotonically_increasing_id()})
    order = [*keys, F.col("_tie"), F.col("_arrival")]
    ranged = (
        tagged.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            *columns,
            F.spark_partition_id().alias("_pid"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)).alias("_pos"),
        )
    )
    return save(ranged, name)


def _has_map(kind: T.DataType) -> bool:
    """Maps have no hash."""
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def running_totals(
    df: DataFrame, keys: Sequence[Column | str], sums: dict[str, str], overall: dict[str, str] | None = None
) -> DataFrame:
    """Add inclusive running sums ``{new_column: column}`` in the order of ``keys``.

    ``overall`` names optional columns with the grand total of a running sum.

    Each range partition is summed on its own; the totals of the earlier partitions (one
    row per partition) are added by a broadcast join.
    """
    table = sorted_table(df, keys, "running")
    totals = table.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = totals.select(
        "_pid",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(name) for name, n in (overall or {}).items()],
    )
    local = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return table.join(F.broadcast(offsets), "_pid").select(
        *df.columns,
        *[(F.sum(c).over(local) + F.col(f"_o_{n}")).alias(n) for n, c in sums.items()],
        *(overall or {}),
    )


def order_statistics(
    df: DataFrame, value: str, pool: str, ranks_of: Callable[[object, int], Iterable[int]], few: int = FEW_ROWS
) -> tuple[dict[tuple[object, int], float], dict[object, tuple[int, float, float]]]:
    """Exact k-th smallest values (0-based) of several pools, without sorting or collecting them.

    ``ranks_of(pool, n)`` names the ranks wanted of a pool of ``n`` values.  Returns the values
    by (pool, rank), and count, smallest and largest value of every pool.

    While more than ``few`` rows are open for a rank, a sketch of their ranks names two values
    close to it on either side, and one scan counts the rows below, at, between and above them.  The
    rank is one of the two, or between them, where at most a few in ``ACCURACY`` of the rows are
    left, however the values are spread.  The last rows of every rank are brought to the driver.
    """
    limits = {
        r["_p"]: (r["n"], r["lo"], r["hi"])
        for r in df.groupBy(F.col(pool).alias("_p"))
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
        .collect()
    }
    found: dict[tuple[object, int], float] = {}
    todo: dict[tuple[object, int], tuple[float, float, int, int]] = {}  # bounds, rank between them, rows between them
    for p, (n, lo, hi) in limits.items():
        if p is None and n:
            raise ValueError(f"{n} values belong to no pool")
        if n and not math.isfinite(hi - lo):
            raise ValueError(f"pool {p!r} has values that are not finite")
        for rank in ranks_of(p, n):
            if not 0 <= rank < n:
                raise ValueError(f"pool {p!r} has no value of rank {rank}")
            todo[p, rank] = (lo, hi, rank, n)
    v = F.col(value)
    while True:
        for key in [k for k, (lo, hi, *_) in todo.items() if lo == hi]:
            found[key] = todo.pop(key)[0]
        wide = {k: s for k, s in todo.items() if s[3] > few}
        if not wide:
            break
        inside = {k: (F.col(pool) == F.lit(k[0])) & v.between(s[0], s[1]) for k, s in wide.items()}
        marks = []
        for i, (key, (_, _, rank, n)) in enumerate(wide.items()):
            near = [min(max(rank / n + side * 2 / ACCURACY, 0.0), 1.0) for side in (-1, 1)]
            marks.append(F.percentile_approx(F.when(inside[key], v), near, ACCURACY).alias(f"m{i}"))
        sketched = df.agg(*marks).first()
        counts = []
        for i, key in enumerate(wide):
            a, b = sketched[f"m{i}"]
            parts = {"below": v < a, "at_a": v == a, "between": (v > a) & (v < b), "at_b": (v == b) & F.lit(a != b), "above": v > b}
            for name, part in parts.items():
                held = F.when(inside[key] & part, v)
                counts += [F.count(held).alias(f"{name}{i}"), F.min(held).alias(f"{name}{i}_lo"), F.max(held).alias(f"{name}{i}_hi")]
        row = df.agg(*counts).first()
        for i, (key, (_, _, rank, n)) in enumerate(wide.items()):
            for name in ("below", "at_a", "between", "at_b", "above"):
                size = row[f"{name}{i}"]
                if rank < size:
                    todo[key] = (row[f"{name}{i}_lo"], row[f"{name}{i}_hi"], rank, size)
                    break
                rank -= size
            lo, hi, _, size = todo[key]
            if size == n and lo != hi:
                raise ValueError(f"rank {key[1]} of pool {key[0]!r} can't be narrowed")
    if todo:
        keys = list(todo)
        inside = [(F.col(pool) == F.lit(k[0])) & v.between(todo[k][0], todo[k][1]) for k in keys]
        marked = F.array_compact(F.array(*[F.when(x, F.lit(i)) for i, x in enumerate(inside)]))
        open_: list[list[float]] = [[] for _ in keys]  # ``few`` values at most per rank
        for r in df.select(v.alias("_v"), F.explode(marked).alias("_i")).collect():
            open_[r["_i"]].append(r["_v"])
        for key, values in zip(keys, open_, strict=True):
            found[key] = sorted(values)[todo[key][2]]
    return found, limits


def medians(df: DataFrame, value: str, pool: str) -> dict[object, float]:
    """Exact interpolated median of every pool."""
    stats, limits = order_statistics(df, value, pool, lambda _, n: {(n - 1) // 2, n // 2} if n else ())
    return {p: (stats[p, (n - 1) // 2] + stats[p, n // 2]) / 2 for p, (n, _, _) in limits.items() if n}
