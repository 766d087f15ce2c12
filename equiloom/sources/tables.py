"""Table scans, listing files and Parquet sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from equiloom import schemas


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Parquet scan with a declared schema, so planning never opens a footer to infer one."""
    reader = spark.read
    if name in schemas.SOURCE_TABLES:
        reader = reader.schema(schemas.SOURCE_TABLES[name])
    return reader.parquet(f"{directory}/{name}.parquet")


def read_listing_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LISTING).option("header", True).csv(path)


def for_sink(df: DataFrame, decimals: Mapping[str, T.DecimalType]) -> DataFrame:
    """Rounds and casts the named doubles to the sink's decimal types."""
    return df.withColumns({
        name: F.round(F.col(name), kind.scale).cast(kind) for name, kind in decimals.items()
    })


def replace_table(df: DataFrame, path: str, partition: str | None = None) -> DataFrame:
    return _write(df, path, "overwrite", partition)


def append_table(df: DataFrame, path: str, partition: str | None = None) -> DataFrame:
    return _write(df, path, "append", partition)


def _write(df: DataFrame, path: str, mode: str, partition: str | None) -> DataFrame:
    if partition:
        # Rebalancing gathers each partition value into few files and splits a hot one.
        df.hint("rebalance", partition).write.mode(mode).partitionBy(partition).parquet(path)
    else:
        df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
