"""Structured Streaming over the same aggregates: partial results that arrive as files are merged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from orrery.plans.merge import Agg, merge


def merged_stream(spark: SparkSession, folder: str, schema: str, keys: list[str], aggs: list[Agg]) -> DataFrame:
    """Merged groups of partial rows that are written to a folder as Parquet, slice by slice."""
    return merge(spark.readStream.schema(schema).parquet(folder), keys, aggs)


def to_memory(df: DataFrame, name: str) -> StreamingQuery:
    return df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
