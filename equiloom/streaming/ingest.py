"""Incremental price load as a stream: new files in, merged keyed table out.

A run drains what has arrived. Its batches are only kept, and merged with the table once at the end, so the result
depends on the rows alone, not on how files are cut into batches or in which order they come. The merge also
removes repeats: a key has one row, and a row that is read twice changes nothing. It reads and writes only the months
that have new rows.

Feeds without a table of their own lose their repeats in the stream: ``deduplicated`` remembers keys as long as the watermark
says that a repeat can still come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from equiloom.operators.filters import valid_bars
from equiloom.session import found, is_file, remove
from equiloom.sources.maintenance import merge_latest

#: Column of a merged table's folders.
MONTH = "month__"


def price_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Rows of the files at ``path``, a table's folder or its only file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if is_file(spark, path):  # a file source watches folders
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path)


class MergedTable:
    """A keyed Parquet table in one folder a month, of which a merge writes those months anew that have new rows.

    A merge first writes the months' whole new content aside and then puts it in place of the old, so it may be broken off and done again
    at any point: what lies aside whole is put in place first, and the batches kept go only after that.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str], day: str = "trade_date"):
        self.spark, self.root, self.schema, self.keys, self.day = spark, root, schema, keys, day
        self.whole = StructType([*schema.fields, StructField(MONTH, StringType())])
        if found(spark, f"{root}/aside/_SUCCESS"):
            self._put_in_place()

    def _read(self) -> DataFrame:
        if not found(self.spark, f"{self.root}/table/{MONTH}=*"):
            return self.spark.createDataFrame([], self.whole)
        return self.spark.read.schema(self.whole).parquet(f"{self.root}/table")

    def rows(self) -> DataFrame:
        return self._read().select(*self.schema.names)

    def keep(self, batch: DataFrame, number: int) -> None:
        """A batch that is run again after a failure replaces itself."""
        valid_bars(batch).select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/kept/batch={number}")

    def merge(self) -> DataFrame:
        """The table with all kept batches; of a key's rows the new replace the old, and of several new the largest counts."""
        kept = f"{self.root}/kept"
        if not found(self.spark, f"{kept}/batch=*/_SUCCESS"):
            return self.rows()
        month = F.coalesce(F.date_format(self.day, "yyyy-MM"), F.lit("none"))
        fresh = self.spark.read.schema(self.schema).parquet(kept).select(*self.schema.names, month.alias(MONTH))
        # One value a month of the calendar.
        touched = [row[MONTH] for row in fresh.select(MONTH).distinct().collect()]
        old = self._read().where(F.col(MONTH).isin(touched))
        merged = merge_latest(old, fresh, [*self.keys, MONTH], [n for n in self.schema.names if n not in self.keys])
        merged.hint("rebalance", MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(f"{self.root}/aside")
        self._put_in_place()
        return self.rows()

    def _put_in_place(self) -> None:
        aside = self.spark.read.schema(self.whole).parquet(f"{self.root}/aside")
        aside.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(f"{self.root}/table")
        remove(self.spark, f"{self.root}/kept")
        remove(self.spark, f"{self.root}/aside")


def run_ingest(stream: DataFrame, table: MergedTable, checkpoint: str) -> DataFrame:
    """Drains what is there, then merges; schedule it to keep the table up to date."""
    query: StreamingQuery = (
        stream.writeStream.foreachBatch(table.keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return table.merge()


def newest_day(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.max("trade_date").alias("last_date"), F.count("*").alias("bars"))


def deduplicated(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """The first arrival of each key; rows later than ``delay`` behind the newest are dropped, and with them the need to remember.

    State holds the keys of the last two ``delay`` of event time, whatever the stream's length.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def run_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drains what is there into a Parquet folder, each row once, also over restarts; returns the ended query."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
