"""Near-duplicate vectors by an exact metric range join over pivots (operator 7)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scratch import save
from tidewatch.llm.components import smallest_member
from tidewatch.llm.text import connect

COSINE = 0.98
#: Pivots per label at most, and vectors per pivot that fewer are taken for.
PIVOTS, PER_PIVOT = 64, 2000
#: Home vectors of a cell compared in one task at a time; fuller cells are cut.
HOME = 4096
#: Labels that get pivots of their own; the vectors of others share one cell per label.
MOST_LABELS = 10_000
#: Added to the radius, for rounding of distances; every pair found is checked by its cosine.
SLACK = 1e-7


def _usable(vector: str) -> F.Column:
    """Neither null nor zero, and all components finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest component first, so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _dealt(pivots: dict[tuple[str, int], np.ndarray], radius: float):
    """Every vector with the cells it belongs to: its home, and those within reach of the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            label, width, code = (batch.column(names.index(c)).to_pylist() for c in ("label", "width", "code"))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(label, width, strict=True)):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                points = _unit(_matrix(batch.column(names.index("vector")).take(pa.array(rows))))
                centres = pivots.get(key)
                if centres is None:
                    yield _rows(key, [code[i] for i in rows], points, np.arange(len(rows)), np.zeros(len(rows), int), np.ones(len(rows), bool), np.zeros(len(rows)))
                    continue
                along = points @ centres.T
                home = along.argmax(axis=1)
                distance = np.sqrt(np.maximum(2 - 2 * along, 0))
                nearest = distance[np.arange(len(rows)), home]
                # By the triangle inequality a vector within the radius of one whose home is another pivot is at
                # most twice the radius further from that pivot than from its own; and it lies within the
                # radius of the plane between the two pivots, which is the sharper bound.
                apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[home]
                gap = along[np.arange(len(rows)), home][:, None] - along
                reached = (distance - nearest[:, None] <= 2 * radius) & (gap <= radius * apart + SLACK)
                reached[np.arange(len(rows)), home] = True
                i, cell = np.nonzero(reached)
                yield _rows(key, [code[rows[n]] for n in i.tolist()], points[i], i, cell, home[i] == cell, distance[i, cell])

    return run


def _rows(key, code, points, row, cell, is_home, distance) -> pa.RecordBatch:
    n = len(code)
    flat = pa.array(np.ascontiguousarray(points).ravel())
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * points.shape[1]), flat)
    columns = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int32()), pa.array(cell, pa.int32())]
    columns += [pa.array(code, pa.int64()), pa.array(is_home), pa.array(distance, pa.float64()), vectors]
    return pa.RecordBatch.from_arrays(columns, names=["label", "width", "cell", "code", "is_home", "distance", "unit"])


_CELL = "label string, width int, cell int, code long, is_home boolean, distance double, unit array<double>"


def _joined(radius: float, cosine: float):
    """Joins a part of a cell's home vectors with all vectors of the cell; rows come sorted, home rows of the part first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: _Part | None = None
        for batch in batches:
            names = batch.schema.names
            keys = list(zip(*(batch.column(names.index(c)).to_pylist() for c in ("label", "width", "cell", "part")), strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if part is None or part.key != keys[a]:
                    if part is not None:
                        yield from part.finish()
                    part = _Part(keys[a], radius, cosine)
                held = batch.slice(a, b - a)
                mine = held.column(names.index("in_part")).to_numpy(zero_copy_only=False).astype(bool)
                code, size = (held.column(names.index(c)).to_numpy() for c in ("code", "size"))
                distance = held.column(names.index("distance")).to_numpy()
                part.take(mine, code, size, distance, _matrix(held.column(names.index("unit"))))
        if part is not None:
            yield from part.finish()

    return run


class _Part:
    """Home vectors of a part of a cell, held while the cell's vectors pass by."""

    def __init__(self, key: tuple, radius: float, cosine: float):
        self.key, self.radius, self.cosine = key, radius, cosine
        self.held: list[tuple[np.ndarray, ...]] = []
        self.home: tuple[np.ndarray, ...] | None = None
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def take(self, mine, code, size, distance, points) -> None:
        if mine.any():
            self.held.append((code[mine], size[mine], distance[mine], points[mine]))
        if not mine.all():
            self._settle()
            other = ~mine
            self._compare(code[other], size[other], distance[other], points[other])

    def _settle(self) -> None:
        if self.home is None and self.held:
            code, size, distance, points = (np.concatenate(x) for x in zip(*self.held, strict=True))
            order = np.argsort(distance, kind="stable")
            self.home = (code[order], size[order], distance[order], points[order])
            self.links = np.zeros(len(code), np.int64)
            self.label = np.arange(len(code))
            self._compare(*self.home, own=True)

    def _compare(self, code, size, distance, points, own: bool = False) -> None:
        if self.home is None:
            return
        home_code, _, home_distance, home_points = self.home
        order = np.argsort(distance, kind="stable")
        step = max(1, (1 << 21) // len(home_code))
        for lo in range(0, len(code), step):
            rows = order[lo : lo + step]
            # A pair within the radius differs by no more than that in its distances to the pivot.
            a = np.searchsorted(home_distance, distance[rows[0]] - self.radius - SLACK)
            b = np.searchsorted(home_distance, distance[rows[-1]] + self.radius + SLACK, "right")
            near = home_points[a:b] @ points[rows].T >= self.cosine
            i, j = np.nonzero(near)
            i += a
            other = code[rows[j]]
            linked = home_code[i] != other
            i, j, other = i[linked], j[linked], other[linked]
            np.add.at(self.links, i, size[rows[j]])
            if own:
                self.label = connect(self.label, i, rows[j])
                continue
            # One edge from each vector that passes by to a home vector, and home vectors it joins are one class.
            first = np.full(len(rows), -1)
            first[j[::-1]] = i[::-1]
            self.label = connect(self.label, i, first[j])
            seen = np.flatnonzero(first >= 0)
            self.edges.append((home_code[first[seen]], code[rows[seen]]))

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        if self.home is None:
            return
        code, size, _, _ = self.home
        inner = np.flatnonzero(self.label != np.arange(len(code)))
        edges = [*self.edges, (code[self.label[inner]], code[inner])]
        a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
        columns = [np.concatenate([code, a]), np.concatenate([np.full(len(code), -1), b]), np.concatenate([self.links, np.zeros(len(a), np.int64)])]
        is_edge = np.concatenate([np.zeros(len(code), bool), np.ones(len(a), bool)])
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(is_edge)], names=["code", "other", "links", "is_edge"])


def vector_groups(
    rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE
) -> DataFrame:
    """``id_column``, ``n_links``, ``component_id``, ``kept`` for every row.

    Rows link if their labels are equal and not null, their vectors have the same width, and their cosine in
    double precision is ``cosine`` or more.  Vectors that are null, empty, or zero, or hold null or non-finite
    components, link with nothing.  ``component_id`` is the smallest id reachable, the own included.

    Equal vectors of a label are one point with a size.  Points on the unit sphere go to the nearest pivot (a
    sample of at most ``PIVOTS`` per label, the smallest hashes) and to every other whose cell the
    radius reaches; cells join on their own.  The home points of a full cell are cut into parts, each of which
    meets the whole cell.  A cell gives one edge per point and no pairs.  Rows with a null id get
    the smallest id of their component, null if it has none, and ``kept`` false.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    held = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label"))
    held = held.withColumn("good", _usable("vector") & F.col("label").isNotNull())
    # -0.0 and 0.0 are the same component.
    held = held.withColumn("vector", F.when(F.col("good"), F.transform("vector", lambda x: x + F.lit(0.0))))
    held = save(held.withColumn("hash", F.xxhash64("label", "vector")), "vectors")
    good = held.filter("good")
    points = good.groupBy("label", "hash", "vector").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    # A dense number in place of label and vector; written, so that it stays the same.
    points = save(points.withColumn("code", F.monotonically_increasing_id()).withColumn("width", F.size("vector")), "points")

    counts = points.groupBy("label", "width").agg(F.count(F.lit(1)).alias("n"))
    many = counts.filter(F.col("n") > PER_PIVOT // 4).orderBy(F.desc("n"), "label", "width").limit(MOST_LABELS)
    budget = many.withColumn("pivots", F.least(F.lit(PIVOTS), F.ceil(F.col("n") / PER_PIVOT).cast("int") + 1))
    budget = {(r["label"], r["width"]): r["pivots"] for r in budget.collect()}
    pivots = _draw(points, budget) if budget else {}
    dealt = points.select("label", "width", "code", "vector").mapInArrow(_dealt(pivots, radius), _CELL)
    dealt = save(dealt, "cells")
    sizes = points.select("code", "size")
    homes = dealt.filter("is_home").groupBy("label", "width", "cell").agg(F.count(F.lit(1)).alias("homes"))
    full = homes.withColumn("parts", F.ceil(F.col("homes") / HOME).cast("int"))
    full = save(full.select("label", "width", "cell", "parts"), "cell_parts")
    dealt = dealt.join(sizes, "code").join(full, ["label", "width", "cell"])
    own = F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("in_part", F.col("is_home") & (F.col("part") == own))
    key = ["label", "width", "cell", "part"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, F.desc("in_part"), "distance")
    found = dealt.select(*key, "in_part", "code", "size", "distance", "unit")
    found = save(found.mapInArrow(_joined(radius, cosine), "code long, other long, links long, is_edge boolean"), "links")

    edges = found.filter("is_edge").select(F.col("code").alias("a"), F.col("other").alias("b"))
    members = points.select(F.col("code").alias("node"), "first")
    grouped = smallest_member(members, edges).select(F.col("node").alias("code"), F.col("first").alias("component"))
    links = found.filter("NOT is_edge").select("code", "links")
    known = points.join(links, "code").join(grouped, "code")
    known = save(known.select("label", "hash", "vector", (F.col("links") + F.col("size") - 1).alias("n_links"), "component"), "known")
    joined = held.join(known, ["label", "hash", "vector"], "left")
    component = F.when(F.col("good"), F.col("component")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _draw(points: DataFrame, budget: dict[tuple[str, int], int]) -> dict[tuple[str, int], np.ndarray]:
    """Pivots of each label and width: the points with the smallest hashes."""

    def smallest(batches):
        held: dict[tuple[str, int], list[tuple[int, list[float]]]] = {}
        for batch in batches:
            for label, width, h, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, width) in budget:
                    best = held.setdefault((label, width), [])
                    best.append((h, vector))
                    if len(best) > 4 * PIVOTS:
                        best.sort()
                        del best[PIVOTS:]
        rows = [(k[0], k[1], h, v) for k, best in held.items() for h, v in sorted(best)[:PIVOTS]]
        if rows:
            label, width, h, vector = zip(*rows, strict=True)
            columns = [pa.array(label, pa.string()), pa.array(width, pa.int32()), pa.array(h, pa.int64()), pa.array(vector, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "width", "hash", "vector"])

    drawn = points.select("label", "width", "hash", "vector").mapInArrow(smallest, "label string, width int, hash long, vector array<double>")
    best = drawn.groupBy("label", "width").agg(F.slice(F.sort_array(F.collect_list(F.struct("hash", "vector"))), 1, PIVOTS).alias("best"))
    out = {}
    for r in best.collect():  # MOST_LABELS * PIVOTS points at most
        n = budget[r["label"], r["width"]]
        out[r["label"], r["width"]] = _unit(np.array([x["vector"] for x in r["best"][:n]]))
    return out
