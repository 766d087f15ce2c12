"""Ranks and quantiles over a whole table without a single-task window.

Rows are range-partitioned on the sort key, numbered inside their partition and shifted by
the rows before it. The numbered rows are written to the shared folder, so an executor lost
later cannot renumber them. The sampled ranges use every sort column, so tied scores are
split by the tie-breaker and no task gets all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from equiloom.session import checkpointed

PARTITION_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Adds 1..n in the given order."""
    placed = checkpointed(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", PARTITION_BITS)
    # One row per partition: the only unpartitioned window here has as many rows as tasks.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.col("_at") - F.shiftleft(F.col("_part"), PARTITION_BITS)
    return (
        placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + inside + 1)
        .select(*df.columns, name)
    )


def with_percentile(df: DataFrame, rank: str, name: str = "percentile") -> DataFrame:
    """100 for the first rank, falling evenly."""
    total = df.agg(F.count("*")).scalar()
    return df.withColumn(name, 100 - (F.col(rank) - 1) / total * 100)


def levels(df: DataFrame, column: str, order: Column) -> DataFrame:
    """(column, n, before) for each different value: its rows, and the rows ahead of it in the given order.

    Rows are counted by value on every task before the shuffle; then only different values are sorted, so a value that
    most rows share is one row here. Running counts are taken inside range partitions and shifted by the partitions before.
    """
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    placed = checkpointed(counted.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.sum("n").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("n").over(ahead), F.lit(0))
    return placed.withColumn("_inside", inside).join(F.broadcast(starts), "_part").select(column, "n", (F.col("_inside") + F.col("_start")).alias("before"))


def tied_rank(df: DataFrame, score: str, tie: str, name: str, method: str = "min") -> DataFrame:
    """Competition (``min``) or ``dense`` rank, best score first; missing scores rank last."""
    order = F.col(score).desc_nulls_last()
    if method == "dense":
        ranked = numbered(df.groupBy(score).agg(F.count("*").alias("_n")), [order], name)
    else:
        ranked = levels(df, score, order).withColumn(name, F.col("before") + 1)
    ranked = ranked.select(F.col(score).alias("_score"), name)
    return (
        df.join(ranked, F.col(score).eqNullSafe(F.col("_score")), "left").drop("_score")
    )


def exact_quantiles(df: DataFrame, column: str, quantiles: dict[str, float]) -> DataFrame:
    """One row of linearly interpolated quantiles of a whole column."""
    placed = levels(df.select(column).where(F.col(column).isNotNull()), column, F.col(column).asc())
    span = placed.agg(F.sum("n") - 1).scalar()
    found = []
    for name, share in quantiles.items():
        at = F.lit(share) * span

        def value(row: Column) -> Column:
            return F.max(F.when((F.col("before") <= row) & (row < F.col("before") + F.col("n")), F.col(column)))

        low, high = value(F.floor(at)), value(F.ceil(at))
        found.append((low + (high - low) * (F.first(at) - F.floor(F.first(at)))).alias(name))
    return placed.agg(*found)
