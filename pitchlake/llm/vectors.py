"""Operator 2: near-duplicate vectors by an epsilon grid order join.

Vectors of unit length are rotated onto principal axes and laid on a grid of cells as
wide as the largest distance of a link. They are sorted by cell, lexicographically, and
the sequence is cut into intervals, whose bounding boxes make a small table. Only
intervals whose boxes are no farther apart than a link can be are brought together, each
vector once for each such pair; there sequences are halved and joined recursively, and
halves whose boxes are too far apart are skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, stored, tuned
from .components import Forest, components

COSINE = 0.98
#: Vectors that the axes are fitted on, at most; the axes only steer the search, any rotation finds the same links.
MAX_SAMPLE = 20_000
#: Vectors of an interval; leading axes of the grid order; leading axes with bounding boxes; vectors compared at once.
INTERVAL, ORDER, AXES, LEAF = 4096, 6, 10, 128


def _axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes, those of largest variance first."""
    centred = sample - sample.mean(0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1].copy()


def _unit(packed: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Join:
    """Joins sequences of a pair of intervals."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, eps: float, cosine: float):
        self.x, self.y, self.weight, self.eps, self.cosine = x, y, weight, eps, cosine
        self.total = np.zeros(len(x))
        self.forest = Forest(len(x))

    def ordered(self, rows: np.ndarray) -> np.ndarray:
        """The rows in epsilon grid order."""
        cells = np.floor(self.y[rows] / self.eps)
        return rows[np.lexsort(cells.T[::-1])] if len(rows) else rows

    def apart(self, a: np.ndarray, b: np.ndarray) -> bool:
        ya, yb = self.y[a], self.y[b]
        gap = np.maximum(0, np.maximum(ya.min(0) - yb.max(0), yb.min(0) - ya.max(0)))
        return float(gap @ gap) > self.eps**2

    def cross(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a) or not len(b) or self.apart(a, b):
            return
        if len(a) <= LEAF and len(b) <= LEAF:
            near = self.x[a] @ self.x[b].T >= self.cosine
            if near.any():
                self.total[a] += near @ self.weight[b]
                self.total[b] += near.T @ self.weight[a]
                i, j = np.nonzero(near)
                self.forest.join(a[i], b[j])
        elif len(a) >= len(b):
            self.cross(a[: len(a) // 2], b)
            self.cross(a[len(a) // 2 :], b)
        else:
            self.cross(a, b[: len(b) // 2])
            self.cross(a, b[len(b) // 2 :])

    def own(self, a: np.ndarray) -> None:
        if len(a) <= LEAF:
            near = np.triu(self.x[a] @ self.x[a].T >= self.cosine, 1)
            if near.any():
                self.total[a] += (near | near.T) @ self.weight[a]
                i, j = np.nonzero(near)
                self.forest.join(a[i], a[j])
            return
        half = len(a) // 2
        self.own(a[:half])
        self.own(a[half:])
        self.cross(a[:half], a[half:])


def _projected(packed: list[bytes], axes: dict[int, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and their coordinates on at most so many leading axes."""
    x = _unit(packed)
    d = x.shape[1]
    return x, x @ axes[d][:, :most] if d in axes else x[:, :most]


def _intervals(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """The classes in grid order, cut into intervals: block, label, size, id, n, packed; and one row
    for each interval with lo, hi (its box) and cells (the leading two coordinates of its cells).
    """
    kind, label = (classes.schema[c].dataType.simpleString() for c in ("id", "label"))

    @frugal
    def gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vectors = b.column(2).to_pylist()
            size = np.array([len(v) for v in vectors])
            packed = [np.array(v, np.float64).tobytes() for v in vectors]
            cell: list = [None] * len(packed)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                cells = np.floor(_projected([packed[i] for i in at], axes, ORDER)[1] / eps).astype(int)
                for i, c in zip(at.tolist(), cells.tolist(), strict=True):
                    cell[i] = c
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(size), pa.array(cell, pa.list_(pa.int32())), b.column(0), b.column(3), pa.array(packed, pa.binary())], ["label", "size", "cell", "id", "n", "packed"])

    grid = classes.select("id", "label", "vector", "n").mapInArrow(gridded, f"label {label}, size long, cell array<int>, id {kind}, n long, packed binary")
    place = ("label", "size", "cell", "id")
    placed = grid.repartitionByRange(*place).sortWithinPartitions(*place)

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "label", "size", "id", "n", "packed", "lo", "hi", "cells"]
        reals, cells = pa.list_(pa.float64()), pa.list_(pa.struct([("c0", pa.int64()), ("c1", pa.int64())]))
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def out(part: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal number
            packed = part.column("packed").to_pylist()
            y = _projected(packed, axes, AXES)[1]
            lead = np.unique(np.floor(np.pad(y, ((0, 0), (0, 2)))[:, :2] / eps).astype(int), axis=0)
            none, k = (lambda t, n: pa.nulls(n, t)), len(part)
            first = part.slice(0, 1).combine_chunks()
            for rows in part.combine_chunks().to_batches(1000):
                m = rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([number] * m), *(rows.column(c) for c in ("label", "size", "id", "n", "packed")), none(reals, m), none(reals, m), none(cells, m)], names)
            own = [first.column(c).chunk(0) for c in ("label", "size")]
            box = [pa.array([y.min(0).tolist()], reals), pa.array([y.max(0).tolist()], reals), pa.array([[{"c0": i, "c1": j} for i, j in lead.tolist()]], cells)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *own, none(part.schema.field("id").type, 1), pa.array([k]), none(pa.binary(), 1), *box], names)
            number += 1

        def runs(t: pa.Table, last: bool) -> Iterator[tuple[pa.Table, bool]]:
            """Whole intervals of t; the rest, if it may go on, comes with False."""
            label_no = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            size = t.column("size").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(label_no) != 0) | (np.diff(size) != 0)) + 1).tolist(), len(t)]
            for a, e in zip(edges[:-1], edges[1:], strict=True):
                while a < e:
                    stop = min(e, a + INTERVAL)
                    yield t.slice(a, stop - a), last or stop < len(t) or stop - a == INTERVAL
                    a = stop

        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= INTERVAL:
                left = None
                for part, whole in runs(pa.Table.from_batches(held), False):
                    if whole:
                        yield from out(part)
                    else:
                        left = part
                held, rows = (left.to_batches(), len(left)) if left is not None else ([], 0)
        if rows:
            for part, _ in runs(pa.Table.from_batches(held), True):
                yield from out(part)

    ddl = f"block long, label {label}, size long, id {kind}, n long, packed binary, lo array<double>, hi array<double>, cells array<struct<c0:long,c1:long>>"
    return stored(placed.mapInArrow(cut, ddl), "intervals")


def _near_intervals(intervals: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: intervals whose boxes are within eps, found by equal or neighbouring leading cells."""
    boxes = intervals.where("packed is null").select("block", "label", "size", "lo", "hi", F.explode("cells").alias("c"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = boxes.select("label", "size", F.col("c.c0").alias("c0"), F.col("c.c1").alias("c1"), F.col("block").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = boxes.withColumn("s", F.explode(steps)).select("label", "size", (F.col("c.c0") + F.col("s.i")).alias("c0"), (F.col("c.c1") + F.col("s.j")).alias("c1"), F.col("block").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi")).distinct()
    less = lambda x, y: x - y
    gaps = F.zip_with(F.zip_with("alo", "bhi", less), F.zip_with("blo", "ahi", less), lambda x, y: F.greatest(F.lit(0.0), x, y))
    near = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g) <= eps * eps
    return a.join(b, ["label", "size", "c0", "c1"]).where("a <= b").where(near).select("a", "b").distinct()


def _joined(intervals: DataFrame, axes: dict[int, np.ndarray], eps: float, cosine: float) -> DataFrame:
    """(a, null, w): w vectors link with class a; (a, b, null): links that span the classes of two intervals."""
    pairs = stored(_near_intervals(intervals, eps), "interval-pairs")
    # an interval is joined with itself in the pair (a, a); a vector goes once to each of its interval's pairs
    sides = pairs.select(F.col("a").alias("block"), "a", "b").unionByName(pairs.where("a < b").select(F.col("b").alias("block"), "a", "b"))
    vectors = intervals.where("packed is not null").select("block", "id", "n", "packed")
    rows = vectors.join(sides, "block").select("a", "b", "block", "id", "n", "packed").repartition("a", "b").sortWithinPartitions("a", "b")
    kind = intervals.schema["id"].dataType.simpleString()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[tuple]) -> pa.RecordBatch:
            x, y = _projected([r[5] for r in held], axes, AXES)
            j = Join(x, y, np.array([r[4] for r in held], float), eps, cosine)
            block = np.array([r[2] for r in held])
            low, high = j.ordered(np.flatnonzero(block == held[0][0])), j.ordered(np.flatnonzero(block == held[0][1]))
            if held[0][0] == held[0][1]:
                j.own(low)
            else:
                j.cross(low, high)
            ids = [r[3] for r in held]
            some = np.flatnonzero(j.total)
            links = [(ids[a], ids[b]) for p, q in j.forest.links for a, b in zip(p.tolist(), q.tolist(), strict=True)]
            a = [ids[i] for i in some] + [x for x, _ in links]
            b = [None] * len(some) + [x for _, x in links]
            w = [int(j.total[i]) for i in some] + [None] * len(links)
            return pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, id_type), pa.array(w, pa.int64())], ["a", "b", "w"])

        held: list[tuple] = []
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(3).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    return rows.mapInArrow(run, f"a {kind}, b {kind}, w long")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per distinct id: id, n_links long, component_id, kept boolean.

    Vectors of one label (not null) and length link if their cosine in double precision
    is at least cosine; null, empty and zero vectors and those with null or non-finite
    parts link with nothing. component_id is the smallest id that links reach. Equal
    vectors of a label are one class: its members link with each other and alike with
    others, without being expanded into pairs. Rows that repeat an id count once (the
    smallest label and vector), null ids are left out, extra columns are ignored whatever
    their names; vectors may be of any length, an empty table gives no rows, and ids may
    be of any type with an order.
    """
    tuned(rows.sparkSession)
    eps = math.sqrt(2 - 2 * cosine) + 1e-9
    once = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))).alias("s")).select("id", "s.*")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = once.where(F.col("label").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
    classes = stored(good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")
    member = stored(once.select("id").join(good.join(classes.select("label", "vector", F.col("id").alias("rep"), "n"), ["label", "vector"]).select("id", "rep", "n"), "id", "left"), "members")
    axes: dict[int, np.ndarray] = {}
    sample = classes.select("vector").orderBy(F.xxhash64("id")).limit(MAX_SAMPLE).toArrow().column(0).to_pylist()
    for d in {len(v) for v in sample}:
        own = [np.array(v, np.float64).tobytes() for v in sample if len(v) == d]
        if len(own) > 1:
            axes[d] = _axes(_unit(own))
    del sample
    found = stored(_joined(_intervals(classes, axes, eps), axes, eps, cosine), "vector-links")
    totals = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    reached = components(found.where("b is not null").select("a", "b"), "vectors").select(F.col("id").alias("rep"), "component")
    out = member.join(totals, "rep", "left").join(reached, "rep", "left")
    return out.select(
        F.col("id").alias(id_col),
        (F.coalesce("w", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component", "rep", "id")).alias("kept"),
    )
