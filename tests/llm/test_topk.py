"""Voronoi join against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiloom.llm import voronoi


def brute(rows, k, scale=64.0):
    held = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in held), default=0)
    held = [(i, v + [0] * (width - len(v))) for i, v in held]
    out = []
    for at, (i, q) in enumerate(held):
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for other, (j, v) in enumerate(held) if other != at)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, k=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    return sorted(tuple(r) for r in voronoi.top_k(df, F.col("vec_id") % 20 == 0, k=k, **options).collect())


def test_clusters_ties_and_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8)) * 3
    rows = [(i, [float(x) for x in np.float32(centres[i % 5] + rng.normal(size=8) * 0.1)], 0) for i in range(300)]
    rows += [(i, [1.0] * 8, 0) for i in range(300, 420)]  # one very common vector
    assert found(spark, rows, pivots=12, block=16) == brute([r[:2] for r in rows], 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (20, [0.5, float("nan")], 1), (1, None, 1), (None, [1.0, 1.0], 1), (2, [None, 1.0], 1), (3, [3.0], 1), (4, [float("inf"), 0.0], 1), (5, [-1.0, -2.0], 1), (40, [], 1), (3, [3.0], 1)]
    assert found(spark, rows) == brute([r[:2] for r in rows], 5)
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []


def test_large_components_stay_exact():
    a = np.array([[2.0**30, 3.0, 1.0]])
    assert voronoi.products(a, a)[0, 0] == 2**60 + 10


def test_bounds_hold():
    rng = np.random.default_rng(2)
    data, pivots, query = np.floor(rng.normal(size=(200, 6)) * 20), np.floor(rng.normal(size=(7, 6)) * 20), np.floor(rng.normal(size=(9, 6)) * 20)
    cell = ((data[:, None] - pivots) ** 2).sum(2).argmin(1)
    gap = np.sqrt(((data - pivots[cell]) ** 2).sum(1))
    radius = np.array([gap[cell == c].max(initial=-np.inf) for c in range(7)])
    nearest = np.array([np.sort(np.r_[gap[cell == c], [np.inf] * 4])[:4] for c in range(7)])
    sure, open_cells = voronoi.reach(query, pivots, radius, nearest, 3)
    score = query @ data.T
    for n in range(len(query)):
        best = np.argsort(-score[n])[:3]
        assert score[n, best].min() >= sure[n]
        assert open_cells[n, cell[best]].all()


@pytest.mark.parametrize("pivots", [1, 3])
def test_few_pivots(spark, pivots):
    rows = [(i, [float(i % 7), float(i % 3)], 0) for i in range(60)]
    assert found(spark, rows, pivots=pivots) == brute([r[:2] for r in rows], 5)
