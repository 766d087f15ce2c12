"""Small helpers; tables are written to the shared folder by the session's own."""

from __future__ import annotations

import sys
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from equiloom.session import scratch as new_folder, stored

__all__ = ["fold", "new_folder", "partitions", "stored", "table", "worker_memory"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is taken as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_memory(key: str) -> dict:
    """A dictionary for ``key`` that lives as long as the worker process, so a later task finds what an earlier one has put there."""
    kept = sys.modules.setdefault("equiloom_worker_memory", ModuleType("equiloom_worker_memory"))
    return kept.__dict__.setdefault(key, {})
