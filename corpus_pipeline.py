"""The corpus pipeline: toxic texts go, one of each group of near copies stays, benchmark leaks go, secrets are blanked, lengths are packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
Rows with null ids pass, and equal ids are no duplicates unless their texts are. Null, empty and wordless texts are copies of each
other: one row of them stays, and it passes the other stages. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from equiloom.llm import decontaminate, nearcopies, packing, secrets, toxicity
from equiloom.llm.common import fold, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts the classifier scores 0.5 or more; it learns from labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    net = toxicity.train(*toxicity.training_sample(docs, labels, fold(F.col("doc_id")) != 0))
    name = "score__"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, toxicity.score(net, spark)("text")).where(F.col(name) < 0.5).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts with a five-word Jaccard similarity of 0.8 or more the row with the smallest id, nulls last."""
    return nearcopies.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that hold ten words in a row of a benchmark item, or a whole shorter item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret replaced by its kind."""
    return secrets.redacted(docs)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document that is left."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", blank_secrets),
    ("packing", pack_lengths),
]

#: A trained network and a program over all lengths: tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
