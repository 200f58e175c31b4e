"""Block-access heat from I/O traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.sources.shared import hadoop_path

BLOCK = 4096
TRACE = "timestamp double, inode long, filename string, mode string, offset long, size long"


def read_traces(spark: SparkSession, *paths: str, prefix: str = "") -> DataFrame:
    """Traces (tab-separated, no header) of many files, with the query that each file's name says."""
    name = F.upper(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(\.[^.]*)+$", ""))
    df = spark.read.option("sep", "\t").schema(TRACE).csv(list(paths))
    return df.withColumn("query", name).withColumn("filename", F.when(F.startswith("filename", F.lit(prefix)), F.substring("filename", len(prefix) + 1, 1 << 30)).otherwise(F.col("filename")) if prefix else F.col("filename"))


def running_sum(df: DataFrame, value: str, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """The sum of the rows before."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def absolute_offsets(traces: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mapped reads at their place in all files laid end to end, in blocks.

    ``sizes`` (filename, filesize) lists the database's files: as many as files, not rows.
    """
    starts = running_sum(sizes, "filesize", ["filename"], "start").select("filename", F.col("start").alias("file_start"))
    reads = traces.filter(F.col("mode") == "mmapread").select("query", "filename", "offset", "size")
    return reads.join(starts, "filename").select("query", "filename", (F.col("file_start") / BLOCK + F.col("offset")).alias("block"), "size")


def rescale(block: Column, total: Column, cells: int) -> Column:
    """A block's cell, half cells to the even one."""
    return F.bround(block / total * F.lit(cells - 1)).cast("long")


def heat(accesses: DataFrame, block: str = "block", query: str = "query") -> DataFrame:
    """How many queries touch each block, and its band."""
    n = F.count_distinct(F.col(query))
    counts = accesses.groupBy(block).agg(n.alias("heat"))
    return counts.withColumn("band", F.when(F.col("heat") > 7, "red").when(F.col("heat") >= 6, "orange").when(F.col("heat") >= 2, "yellow").otherwise("none"))


def of_queries(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(F.substring("query", 1, 3).isin(*names))


def kept(spark: SparkSession, path: str, derive: Callable[[], DataFrame]) -> DataFrame:
    """An intermediate result that is derived and written once; later calls read it."""
    done, fs = hadoop_path(spark, f"{path.rstrip('/')}/_SUCCESS")
    if not fs.exists(done):
        derive().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
