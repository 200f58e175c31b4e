"""Where slices run: placement policies as DataFrames of (slice, node)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _slices(spark: SparkSession, slices: int, nodes: list) -> DataFrame:
    if slices < 1 or not nodes:
        raise ValueError("slices and nodes are needed")
    return spark.range(slices).select(F.col("id").cast("int").alias("slice"))


def _named(df: DataFrame, index: Column, nodes: list[str]) -> DataFrame:
    return df.select("slice", F.element_at(F.array(*map(F.lit, nodes)), index.cast("int") + 1).alias("node"))


def _draw(seed: int, n: int) -> Column:
    """A pseudo-random node: a linear congruential step of the slice's number, without its low bits."""
    return F.expr(f"((CAST(slice AS BIGINT) * 2 + {seed} + 1) * 1103515245 + 12345) % 2147483648 div 65536 % {n}")


def _lighter(a: Column, b: Column, loads: list[float]) -> Column:
    load = lambda i: F.element_at(F.array(*map(F.lit, map(float, loads))), i.cast("int") + 1)
    return F.when(load(b) < load(a), b).otherwise(a)


def single(spark: SparkSession, slices: int, nodes: list[str]) -> DataFrame:
    """All on the first node."""
    return _named(_slices(spark, slices, nodes), F.lit(0), nodes)


def round_robin(spark: SparkSession, slices: int, nodes: list[str], last: int = 0) -> DataFrame:
    """The node after the last one used; ``last`` is kept by the caller across queries."""
    return _named(_slices(spark, slices, nodes), F.pmod(F.col("slice") + last + 1, F.lit(len(nodes))), nodes)


def random(spark: SparkSession, slices: int, nodes: list[str], seed: int = 0) -> DataFrame:
    return _named(_slices(spark, slices, nodes), _draw(seed, len(nodes)), nodes)


def load_balancing(spark: SparkSession, slices: int, nodes: list[str], loads: list[float], seed: int = 0) -> DataFrame:
    """Of two nodes drawn at random, the one with less load."""
    return _named(_slices(spark, slices, nodes), _lighter(_draw(seed, len(nodes)), _draw(seed + 1, len(nodes)), loads), nodes)


def sticky(spark: SparkSession, slices: int, nodes: list[str]) -> DataFrame:
    """The same node for a slice each time, so that its caches serve again."""
    return _named(_slices(spark, slices, nodes), F.pmod(F.col("slice"), F.lit(len(nodes))), nodes)


def sticky_load_balancing(spark: SparkSession, slices: int, nodes: list[str], loads: list[float]) -> DataFrame:
    """Of a slice's own node and the next one, the one with less load."""
    n = F.lit(len(nodes))
    return _named(_slices(spark, slices, nodes), _lighter(F.pmod(F.col("slice"), n), F.pmod(F.col("slice") + 1, n), loads), nodes)


def reschedule(schedule: DataFrame, slice_no: int, nodes: list[str]) -> DataFrame:
    """The slice on the node after its own; a lone node keeps it."""
    at = F.array_position(F.array(*map(F.lit, nodes)), F.col("node")).cast("int")
    after = F.element_at(F.array(*map(F.lit, nodes)), F.pmod(at, F.lit(len(nodes))) + 1)
    return schedule.withColumn("node", F.when(F.col("slice") == slice_no, after).otherwise(F.col("node")))


def per_node(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy("node").agg(F.count("*").alias("slices"))
