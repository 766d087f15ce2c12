"""K-means on integer vectors in DataFrame expressions, exact and the same on every run.

Centroids are literal arrays in the plan: ``zip_with`` and ``aggregate`` add up a vector's squared distance to each, and the least
of the (distance, number) structs chooses its cluster, ties by the smaller number. A round is one scan and one small aggregate: sums
of each component by cluster are taken on every task before the shuffle, so a vector or cluster most rows share is no burden, and
the driver gets ``k`` rows of sums, whatever the table holds.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from equiloom.llm.common import stored


def integer_vectors(table: DataFrame, dims: int, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, v): vectors of exactly ``dims`` components, none null or non-finite, each component x as floor(scale * x); other columns go."""
    value = F.col(vector).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = table.select(F.col(key).alias(key), value.alias("v"), (F.coalesce(F.size(value) == dims, F.lit(False)) & F.coalesce(finite, F.lit(False))).alias("usable"))
    return usable.where("usable").select(key, F.transform("v", lambda x: F.floor(F.lit(scale) * x)).alias("v"))


def _literal(numbers: list[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, numbers))})").cast("array<long>")


def squared_distance(vector: Column, centroid: list[int]) -> Column:
    """Of an array of longs to a literal one: the sum of (x - c)^2 as x (x - 2c), with that of c^2 to start from."""
    steps = F.zip_with(vector, _literal([2 * c for c in centroid]), lambda x, double: x * (x - double))
    return F.aggregate(steps, F.lit(sum(c * c for c in centroid)).cast("long"), lambda total, step: total + step)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid, ties by the smaller number."""
    return F.array_min(F.array(*(
        F.struct(squared_distance(vector, c).alias("distance"), F.lit(n).cast("int").alias("cluster")) for n, c in enumerate(centroids)
    )))


def first_centroids(vectors: DataFrame, k: int, seed: int = 3, key: str = "vec_id") -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:key``, in that order; ties go by components, a null key is taken as empty."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [row["v"] for row in vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after a round: the exact floor of each component's mean; empty clusters stay where they are."""
    chosen = vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
    parts = chosen.select("cluster", *(F.col("v")[i].alias(f"c{i}") for i in range(dims)))
    sums = parts.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(f"c{i}").alias(f"c{i}") for i in range(dims)))
    found = {row["cluster"]: [row[f"c{i}"] // row["n"] for i in range(dims)] for row in sums.collect()}
    return [found.get(n, c) for n, c in enumerate(centroids)]


def clusters(table: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(key, cluster, distance) of every usable vector of ``table``, and the final centroids.

    Rows whose vector is null, of another length, or holds null or non-finite components take no part. Repeated rows count as often as
    they stand there, equal vectors in the first ``k`` make equal centroids of which the later stay empty, fewer vectors than ``k`` make fewer centroids,
    and without usable vectors the result is empty. Extra columns are not read, whatever their names. Arithmetic is in 64 bits;
    components so large that a squared distance does not fit raise Spark's overflow error under ANSI mode, its default.
    """
    vectors = stored(integer_vectors(table, dims, scale, key, vector), "vectors")
    centroids = first_centroids(vectors, k, seed, key)
    if not centroids:
        return vectors.select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids, dims)
    chosen = vectors.select(key, nearest(F.col("v"), centroids).alias("near"))
    return chosen.select(key, "near.cluster", "near.distance"), centroids


def cluster_report(table: DataFrame, **options) -> DataFrame:
    """The rows of ``clusters`` with cluster_inertia, inertia and centroid_sha256 (of the components, joined by commas); options as there."""
    found, centroids = clusters(table, **options)
    found = stored(found, "clusters")
    # One row per cluster.
    inertia = {row["cluster"]: row["total"] for row in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    own = [inertia.get(n, 0) for n in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    return found.select(
        "*", F.element_at(_literal(own or [0]), at).alias("cluster_inertia"), F.lit(sum(own)).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, names or [""])), at).alias("centroid_sha256"),
    )
