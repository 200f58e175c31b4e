"""Interval and as-of joins as equi-joins, so that they shuffle by key and not by all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interval_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points with ``low <= at < high``, by cells of ``width``; rows of nulls match nothing.

    A range is copied to the cells that it touches, a point is in one; ``width`` near the usual
    range's length keeps both few.
    """
    cell = F.floor(F.col(at) / width)
    spread = ranges.filter(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return points.withColumn("_cell", cell).join(spread, "_cell").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def as_of_join(left: DataFrame, right: DataFrame, on: str, by: list[str], value: str) -> DataFrame:
    """Each left row with the value of the last right row of the same keys that isn't later; null if there is none.

    Both sides are sorted together by one window over the keys.  Right rows of one time
    should agree on a value: the largest counts.
    """
    once = right.groupBy(*by, on).agg(F.max(value).alias(value))
    rows = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    other = once.select(*(F.col(c) if c in (*by, on) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.unionByName(other).withColumn(value, F.last("_value", ignorenulls=True).over(w)).filter("_side = 1").drop("_side", "_value")
