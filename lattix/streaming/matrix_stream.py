"""Structured Streaming over coordinate entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def entry_stream(spark: SparkSession, path: str) -> DataFrame:
    """Entries ``(i, j, v)`` of Parquet files as they arrive."""
    return spark.readStream.schema("i bigint, j bigint, v double").parquet(path)


def accumulate(entries: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A query that keeps the sum of each position in the memory table ``name``; zeros stay as structure."""
    sums = entries.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return sums.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
