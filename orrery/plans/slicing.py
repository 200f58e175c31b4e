"""Key-range slices of a fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.catalog import FactTable


def clamp(fact: FactTable, n: int) -> int:
    """Never more slices than the range has steps, and at least one."""
    if n < 1:
        raise ValueError("at least one slice is needed")
    return min(n, max(1, fact.high - fact.low))


def bounds(fact: FactTable, n: int) -> list[tuple[int, int, int]]:
    """(slice, low, high): the first slice holds its low end, all hold their high end."""
    n = clamp(fact, n)
    stride = (fact.high - fact.low) // n
    return [(i, fact.low + i * stride, fact.high if i == n - 1 else fact.low + (i + 1) * stride) for i in range(n)]


def slice_of(key: Column, fact: FactTable, n: int) -> Column:
    """The slice of a key.  Keys outside the range go to the end slices and nulls to the first, so no row is lost."""
    n = clamp(fact, n)
    stride = max(1, (fact.high - fact.low) // n)
    return F.coalesce(F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((key.cast("long") - F.lit(fact.low + 1)) / F.lit(stride)).cast("int"))), F.lit(0))


def predicate(fact: FactTable, i: int, n: int) -> str:
    """The slice as SQL on the fact's key, which the scan's row groups are pruned by."""
    n = clamp(fact, n)
    _, low, high = bounds(fact, n)[i]
    parts = ([] if i == 0 else [f"{fact.key} > {low}"]) + ([] if i == n - 1 else [f"{fact.key} <= {high}"])
    text = " AND ".join(parts) or "TRUE"
    return f"({text} OR {fact.key} IS NULL)" if i == 0 and n > 1 else text


def sliced(df: DataFrame, fact: FactTable, n: int, name: str = "slice") -> DataFrame:
    return df.withColumn(name, slice_of(F.col(fact.key), fact, n))


def slice_frames(df: DataFrame, fact: FactTable, n: int) -> list[DataFrame]:
    """A DataFrame for each slice, for inspection and separate execution."""
    return [df.filter(predicate(fact, i, n)) for i in range(clamp(fact, n))]


def profile(spark: SparkSession, df: DataFrame, fact: FactTable, n: int) -> DataFrame:
    """(slice, low, high, rows) of every slice, empty ones too."""
    ends = spark.createDataFrame(bounds(fact, n), "slice int, low long, high long")
    counts = sliced(df.select(fact.key), fact, n).groupBy("slice").agg(F.count("*").alias("rows"))
    return ends.join(counts, "slice", "left").select("slice", "low", "high", F.coalesce("rows", F.lit(0)).alias("rows"))
