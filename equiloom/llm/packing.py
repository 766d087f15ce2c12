"""Length buckets that minimise padding, and token-budget batches inside each bucket.

Every sequence of a bucket is padded to the bucket's boundary, its longest length. Dynamic programming over the histogram
of all lengths finds the boundaries with the least padding in all. The histogram has a bin for each length up to 2,048 and
1,024 bins for each doubling beyond, some 55,000 at most, whatever the data; a boundary is the longest length that is in a bin.
Rows are then numbered inside their bucket by a distributed sort, and each run of ``budget // boundary`` rows is a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from equiloom.functions.ranking import numbered
from equiloom.llm.common import stored

FINE = 10


@dataclass(frozen=True)
class Bucket:
    boundary: int
    rows: int
    padding: int


def word_count(text: str = "text") -> Column:
    """Words between ASCII white space, and one for the end of the document."""
    return (F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


def boundaries(bins: list[tuple[int, int, int]], buckets: int) -> list[Bucket]:
    """Least total padding for (longest, rows, total length) bins in ascending order, in at most ``buckets`` buckets.

    Fewer buckets do if more save nothing; of equal ways the one with the earlier cuts is taken.
    """
    n = len(bins)
    rows, total = [0], [0]
    for _, count, length in bins:
        rows.append(rows[-1] + count)
        total.append(total[-1] + length)

    def padding(i: int, j: int) -> int:
        """Of bins i to j - 1 in one bucket."""
        return bins[j - 1][0] * (rows[j] - rows[i]) - (total[j] - total[i])

    best, cuts = [0] + [padding(0, j) for j in range(1, n + 1)], [[0] * (n + 1)]
    for k in range(1, min(buckets, n)):
        # padding(i, j) is linear in the boundary of j for each i: the lower envelope of lines gives the best i.
        hull: list[tuple[int, int, int]] = []
        at, now, cut = 0, [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if j > k:
                i = j - 1
                line = (-rows[i], best[i] + total[i], i)
                while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                now[j], cut[j] = best[j], cuts[-1][j]
                continue
            at, x = min(at, len(hull) - 1), bins[j - 1][0]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            now[j], cut[j] = hull[at][0] * x + hull[at][1] + x * rows[j] - total[j], hull[at][2]
        if n and now[n] >= best[n]:
            break
        best = now
        cuts.append(cut)
    out, j = [], n
    for k in range(len(cuts) - 1, -1, -1):
        i = cuts[k][j] if k else 0
        if j > i:
            out.append(Bucket(bins[j - 1][0], rows[j] - rows[i], padding(i, j)))
        j = i
    return out[::-1]


def length_bins(lengths: DataFrame) -> list[tuple[int, int, int]]:
    step = F.greatest(F.floor(F.log2(F.greatest("n_tokens", F.lit(1)).cast("double"))) - FINE, F.lit(0)).cast("int")
    width = F.pow(F.lit(2.0), step).cast("long")
    bins = lengths.groupBy((F.ceil(F.col("n_tokens") / width) * width).alias("bin")).agg(F.max("n_tokens").alias("top"), F.count("*").alias("rows"), F.sum("n_tokens").alias("total"))
    return [(r["top"], r["rows"], r["total"]) for r in sorted(bins.collect(), key=lambda r: r["top"])]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 65_536, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, bucket, boundary, batch, slot, padding) for every row.

    Batches are numbered from 0 in each bucket and filled in order of doc_id (nulls first), then length. A document longer
    than the budget is whole, in a batch of its own. A null text has length 1, its end. Equal ids and repeated rows all
    get slots of their own. An empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), (word_count() if length is None else F.coalesce(length, F.lit(1))).cast("long").alias("n_tokens"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "lengths")
    chosen = boundaries(length_bins(rows), buckets)
    # At most ``buckets`` values, so they are literals of the plan.
    bucket = F.lit(None).cast("int")
    limit, start, before = F.lit(None).cast("long"), F.lit(None).cast("long"), sum(b.rows for b in chosen)
    for n, b in reversed(list(enumerate(chosen))):
        before -= b.rows
        fits = F.col("n_tokens") <= b.boundary
        bucket, limit, start = F.when(fits, F.lit(n)).otherwise(bucket), F.when(fits, F.lit(b.boundary)).otherwise(limit), F.when(fits, F.lit(before)).otherwise(start)
    placed = numbered(rows.withColumn("bucket", bucket), [F.col("bucket"), F.col("doc_id"), F.col("n_tokens"), F.col("row")], "row_no")
    capacity = F.greatest(F.floor(F.lit(budget) / F.col("boundary")), F.lit(1)).cast("long")
    inside = F.col("row_no") - 1 - F.col("start")
    return (
        placed.withColumn("boundary", limit.cast("long")).withColumn("start", start.cast("long"))
        .withColumn("batch", F.floor(inside / capacity).cast("long")).withColumn("slot", (inside % capacity).cast("int"))
        .select("doc_id", "n_tokens", "bucket", "boundary", "batch", "slot", (F.col("boundary") - F.col("n_tokens")).alias("padding"))
    )
