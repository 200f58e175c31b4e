"""Descriptive statistics of a column of doubles, per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def describe(df: DataFrame, column: str, *by: str) -> DataFrame:
    """min, max, mean, median, count and sum; nulls are ignored.  Groups of raw values merge by union before this."""
    c = F.col(column).cast("double")
    return df.groupBy(*by).agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.count(c).alias("count"), F.sum(c).alias("sum"))
