"""Integer k-means against plain Python."""

import hashlib
import math
import random

from equiloom.llm import centroids


def brute(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centers = [v for _, v in named[:k]]

    def near(v):
        return min((sum((x - c) ** 2 for x, c in zip(v, center, strict=True)), n) for n, center in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centers)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    whole = sum(d for *_, d in out)
    return [(i, n, d, sum(x for _, m, x in out if m == n), whole, hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest()) for i, n, d in out]


def rows_of(found):
    return sorted(map(tuple, found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(n, [rng.uniform(-2, 2) for _ in range(3)]) for n in range(200)]
    rows += [(7, [0.5, 0.5, 0.5])] * 150 + [(None, [1.0, 2.0, 3.0]), (500, None), (501, [1.0, None, 0.0]), (502, [math.nan, 0.0, 0.0]), (503, [math.inf, 0.0, 0.0]), (504, [1.0]), (505, [])]
    table = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string, distance double").repartition(5)
    for k, rounds in ((4, 6), (1, 1), (9, 0)):
        found = centroids.cluster_report(table, k=k, rounds=rounds, dims=3, scale=10, seed=8)
        assert rows_of(found) == sorted(brute(rows, k, rounds, 3, 10, 8), key=str)


def test_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    same = [(1, [1.0, 1.0])] * 5 + [(1, [3.0, 1.0])]
    found = centroids.cluster_report(spark.createDataFrame(same, schema), k=8, rounds=3, dims=2)
    assert rows_of(found) == sorted(brute(same, 8, 3, 2, 1024, 3), key=str)
    for rows in ([], [(1, None)], [(2, [1.0])]):
        assert centroids.cluster_report(spark.createDataFrame(rows, schema), dims=2).collect() == []


def test_ties_go_to_the_smaller_number(spark):
    vectors = spark.createDataFrame([(1, [0]), (2, [4])], "vec_id long, v array<long>")
    near = {r["vec_id"]: tuple(r["near"]) for r in vectors.select("vec_id", centroids.nearest(vectors["v"], [[2], [-2], [2]]).alias("near")).collect()}
    assert near == {1: (4, 0), 2: (4, 0)}
