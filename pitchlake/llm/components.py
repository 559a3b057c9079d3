"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: So many edges at most are joined by one task's union-find, which takes some 50 MB.
ONE_TASK = 500_000


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Edges go from the larger a to the smaller b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


class Forest:
    """Union-find over positions with vectorised unions; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.up[i], self.up[j]
            new = a != b
            if not new.any():
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            high, at = np.unique(np.maximum(a, b), return_index=True)
            self.up[high] = np.minimum(a, b)[at]
            self.links.append((i[at], j[at]))
            while True:
                top = self.up[self.up]
                if (top == self.up).all():
                    break
                self.up = top


def _in_one_task(e: DataFrame) -> DataFrame:
    kind = e.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1))
            ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            forest = Forest(len(ids))
            forest.join(place[: len(a)], place[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[forest.up])], ["id", "component"])

    return e.select("a", "b").coalesce(1).mapInArrow(run, f"id {kind}, component {kind}")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """id, component (smallest id reachable) of every id that has an edge (a, b) to another.

    Up to ONE_TASK edges go to a union-find in one task. More take rounds: each writes its edges to the shared folder, so lineage stays short and lost executors cost
    one round, until one changes nothing. Minima are aggregated before the shuffle and
    hot ids meet only their minimum, one row each. Both ways give the same components.
    Ids are of any type with an order; null ends, loops and repeated edges are ignored,
    an empty table gives no rows.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")
    before = e.agg(F.count("*").alias("n"), mark).first()
    if before["n"] == 0:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    if before["n"] <= ONE_TASK:
        return _in_one_task(e)
    while True:
        new = stored(_small_star(_large_star(e)), label)
        after = new.agg(F.count("*").alias("n"), mark).first()
        forget(e)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
