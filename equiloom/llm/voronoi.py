"""Exact top-k inner products by a Voronoi join.

Pivots, a bounded hash-ordered sample of different vectors, divide the data into cells. Of each cell a summary is kept: its rows, its radius, and
its ``k + 1`` smallest distances to the pivot. For a query q and a vector v at distance d from pivot p, |<q,v> - <q,p>| <= |q| d. So the
summaries give each query a score that ``k`` other vectors reach, and each cell a score it cannot exceed; the query goes to those cells only that can reach
that far. A cell is cut into blocks of rows, and its queries into blocks too, so no task holds more than a block of either, however many rows are
alike. Each pair of blocks is solved by one matrix product, and the best k of each query are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from equiloom.llm.common import stored

PIVOTS = 128
BLOCK = 2048
EXACT = 2.0**52


def whole_vectors(vectors: DataFrame, scale: float, vec_id: str, vector: str) -> DataFrame:
    """(row, vec_id, v): floor(scale * x) of each component as a double; rows with a null id, vector or component, or one that isn't finite, are left out."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.transform(doubles, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def matrix(arrays, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one counts as filled up with zeros."""
    out = np.zeros((len(arrays), width))
    for n, a in enumerate(arrays):
        out[n, :len(a)] = a
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while no sum can pass 2^52, else in 64-bit integers."""
    top = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def reach(query: np.ndarray, pivots: np.ndarray, radius: np.ndarray, nearest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the score that k others reach at least, and which cells can hold a score as high. ``nearest``: [cells, k + 1] distances, inf where there are fewer."""
    at_pivot = query @ pivots.T
    norm = np.sqrt((query**2).sum(axis=1))[:, None]
    slack = 1e-9 * (np.abs(at_pivot) + norm * np.where(np.isfinite(radius), radius, 0)) + 1e-6
    least = at_pivot[:, :, None] - np.where(np.isfinite(nearest), norm[:, :, None] * np.where(np.isfinite(nearest), nearest, 0), np.inf) - slack[:, :, None]
    least = least.reshape(len(query), -1)
    # One of the k + 1 may be the query itself.
    sure = np.partition(least, -(k + 1), axis=1)[:, -(k + 1)] if least.shape[1] > k else np.full(len(query), -np.inf)
    return sure, at_pivot + norm * radius + slack >= sure[:, None]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (of vec_id) the k highest integer inner products with all other rows, ties to the smaller id.

    Vectors that are null or hold a null or non-finite component, and rows without an id, take no part. Repeated rows are rows of their own;
    only a query's own row is left out. Of vectors of unequal length the shorter counts as filled up with zeros. With fewer than k others all are given.
    """
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, scale, vec_id, vector), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    centres = matrix([r["v"] for r in rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()], width)
    sent = spark.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                v = matrix(part.column("v").to_numpy(zero_copy_only=False), p.shape[1])
                cell = (np.sum(p * p, axis=1) - 2 * (v @ p.T)).argmin(axis=1)
                gap = np.sqrt(((v - p[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(gap)], names=["row", "vec_id", "v", "cell", "gap"])

    placed = stored(rows.mapInArrow(nearest, "row long, vec_id long, v array<double>, cell int, gap double"), "cells")
    summary = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("gap").alias("radius")).collect()
    order = Window.partitionBy("cell").orderBy("gap", "row")
    close = placed.select("cell", "gap", "row").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("cell", "n", "gap").collect()
    radius, gaps, blocks = np.full(len(centres), -np.inf), np.full((len(centres), k + 1), np.inf), {}
    for r in summary:
        radius[r["cell"]], blocks[r["cell"]] = r["radius"], -(-r["rows"] // block)
    for r in close:
        gaps[r["cell"], r["n"] - 1] = r["gap"]
    sums = spark.sparkContext.broadcast((radius, gaps))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, near = sums.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                v = matrix(part.column("v").to_numpy(zero_copy_only=False), sent.value.shape[1])
                sure, open_cells = reach(v, sent.value, far, near, k)
                which, cell = np.nonzero(open_cells & np.isfinite(far))
                chosen = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(cell.astype(np.int32)), pa.array(sure[which])], names=["row", "vec_id", "v", "cell", "sure"])

    routed = placed.where(is_query).select("row", "vec_id", "v").mapInArrow(route, "row long, vec_id long, v array<double>, cell int, sure double")
    routed = stored(routed.withColumn("place", F.monotonically_increasing_id()), "routed")
    asked = {r["cell"]: -(-r["count"] // block) for r in routed.groupBy("cell").count().collect()}
    # One row a cell that is asked.
    plan = spark.createDataFrame([(c, blocks[c], n) for c, n in asked.items()], "cell int, row_blocks int, query_blocks int")
    data = placed.join(F.broadcast(plan), "cell").withColumn("row_block", F.pmod(F.xxhash64("row"), "row_blocks").cast("int"))
    data = data.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).select("cell", "row_block", "query_block", "row", "vec_id", "v")
    asks = routed.join(F.broadcast(plan), "cell").withColumn("query_block", F.pmod(F.xxhash64("place"), "query_blocks").cast("int"))
    asks = asks.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))).select("cell", "row_block", "query_block", "row", "vec_id", "v", "sure")
    unit = ["cell", "row_block", "query_block"]

    def solve(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return pd.DataFrame({"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}).astype("int64")
        held = held.sort_values(["vec_id", "row"])
        found = products(matrix(queries["v"].to_numpy(), width), matrix(held["v"].to_numpy(), width))
        own = queries["row"].to_numpy()[:, None] == held["row"].to_numpy()
        keep = (found >= queries["sure"].to_numpy()[:, None]) & ~own
        if held.shape[0] > k + 1:
            ranked = np.where(keep, found, np.iinfo(np.int64).min)
            keep &= found >= np.partition(ranked, -k, axis=1)[:, -k, None]
        a, b = np.nonzero(keep)
        score = found[a, b]
        order = np.lexsort((b, -score, a))
        a, b, score = a[order], b[order], score[order]
        head = np.searchsorted(a, a)
        best = np.arange(len(a)) - head < k
        a, b, score = a[best], b[best], score[best]
        return pd.DataFrame({"query_row": queries["row"].to_numpy()[a], "query_id": queries["vec_id"].to_numpy()[a], "row": held["row"].to_numpy()[b], "vec_id": held["vec_id"].to_numpy()[b], "score": score})

    pairs = asks.groupBy(*unit).cogroup(data.groupBy(*unit)).applyInPandas(solve, "query_row long, query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
