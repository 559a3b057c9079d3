import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.llm import vectors


def corpus(seed, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=dim)
            for _ in range(rng.integers(1, 9)):
                v = base + rng.normal(size=dim) * rng.choice([0.0, 0.03, 0.08]) * np.linalg.norm(base) / dim**0.5 * 2
                rows.append((len(rows), (v * rng.choice([1, 3.0])).tolist(), label))
    for odd in (None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1e300] * dim, [1e-300] * dim, [1.0] * (dim + 1), [2.0] * (dim + 1)):
        rows.append((len(rows), odd, 0))
    return rows


def brute(rows, cosine=0.98):
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    comp, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}
    unit = {}
    for i, v, _ in rows:
        if ok(v):
            x = np.array(v) / max(map(abs, v))
            unit[i] = x / np.linalg.norm(x)
    for a, va, la in rows:
        for b, vb, lb in rows:
            if a < b and la == lb and la is not None and a in unit and b in unit and len(va) == len(vb) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if c == hi else c for k, c in comp.items()}
    return sorted((i, links[i], comp[i], comp[i] == i) for i in comp)


@pytest.mark.parametrize("chunk", [4096, 5])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "INTERVAL", chunk)
    monkeypatch.setattr(vectors, "LEAF", min(chunk, 16))
    rows = corpus(chunk)
    df = spark.createDataFrame([(*r, "x", 2) for r in [*rows, rows[0]]], "vec_id long, embedding array<double>, label int, rep string, n int")
    assert sorted(map(tuple, vectors.near_duplicates(df).collect())) == brute(rows)


def test_one_hot_cell_and_string_ids(spark, monkeypatch):
    """A dense cluster takes several intervals, every one of its links is counted."""
    monkeypatch.setattr(vectors, "INTERVAL", 64)
    monkeypatch.setattr(vectors, "LEAF", 16)
    rng = np.random.default_rng(9)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * (0.02 if i % 3 else 0.3)).tolist(), 1) for i in range(400)] + [(i, rng.normal(size=8).tolist(), 1) for i in range(400, 600)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    assert sorted(map(tuple, vectors.near_duplicates(df).collect())) == want
    names = df.withColumn("vec_id", F.format_string("v%05d", "vec_id"))
    assert sorted((int(r.vec_id[1:]), r.n_links, int(r.component_id[1:]), r.kept) for r in vectors.near_duplicates(names).collect()) == want


def test_distant_intervals_are_not_brought_together(spark, monkeypatch):
    monkeypatch.setattr(vectors, "INTERVAL", 50)
    rng = np.random.default_rng(2)
    centres = [c / np.linalg.norm(c) for c in rng.normal(size=(20, 6))]
    rows = [(i, (centres[i % 20] + rng.normal(size=6) * 0.01).tolist(), 1, 1) for i in range(1000)]
    classes = spark.createDataFrame(rows, "id long, vector array<double>, label int, n long")
    eps = math.sqrt(2 - 2 * 0.98)
    axes = {6: vectors._axes(np.array([r[1] for r in rows]))}
    cut = vectors._intervals(classes, axes, eps)
    n = cut.where("packed is null").count()
    assert 20 <= n <= 40 and cut.where("packed is not null").count() == 1000
    assert vectors._near_intervals(cut, eps).count() < n * (n + 1) / 4


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
