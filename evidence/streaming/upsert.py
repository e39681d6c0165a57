"""Incremental upserts from a stream of landed Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .table import VersionedTable


def incremental_upsert(spark: SparkSession, landed: str, schema: T.StructType, target: str, key: list[str], order: str, checkpoint: str, files: int = 1000, buckets: int = 64) -> StreamingQuery:
    """A query that merges each micro-batch of landed files into the `VersionedTable` at `target`, until all are read.

    The stream's checkpoint remembers which files are done; a batch that is run again after a failure
    is known by its number and changes nothing.
    """

    def merge(rows: DataFrame, number: int) -> None:
        VersionedTable(rows.sparkSession, target, schema, key, order, buckets).merge(rows, number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landed)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, schema: T.StructType, key: list[str], order: str) -> DataFrame:
    """The table as of its latest version; empty before the first."""
    return VersionedTable(spark, target, schema, key, order).read()
