"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.sources.shared import hadoop_path, shared_folder


#: Bytes after which a batch for a Python worker ends, unless the session says otherwise; Spark's 64 MB take up to three times that of a task in buffers that grow by doubling.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def on_workers(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, and get rows in small batches."""
    if not spark._jsparkSession.conf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    root, known = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that no column has, whatever its letters' case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def integral(df: DataFrame, key: str) -> Column:
    """An integer column as a long; another type is an error rather than a key that is lost."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"the key {key} must be an integer column, not {df.schema[key].dataType.simpleString()}")
    return F.col(key).cast("long")


def gathered(df: DataFrame) -> DataFrame:
    """``df`` by fewer tasks, one after the other's partitions: four for each core, or an eighth of the shuffle partitions where that is more.

    Without native code Hadoop starts a process three times for each local file that a task
    writes, which until it has its own image counts as a second executor.  Not for functions that
    name their rows by a task's number.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


class Table:
    """A written table: ``frame()`` reads it again, ``drop()`` deletes it.

    Files that are not dropped go when the driver's JVM ends.  Row groups are small, so that
    tasks that write or read large files hold little of them.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(self.path)
        jpath, fs = hadoop_path(self.spark, self.path)
        fs.deleteOnExit(jpath)

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jpath, fs = hadoop_path(self.spark, self.path)
        fs.delete(jpath, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: lineage ends there."""
    return Table(df, name).frame()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referenced, rather than at some later collection."""
    spark.sparkContext._jvm.System.gc()


#: Most bits of the filter below (16 MB), enough for about eight million wanted keys; with more it lets more rows through, and all in the end.
FILTER_BITS = 1 << 27


def _marked(rows: DataFrame, key: str, wanted: DataFrame, how: str) -> tuple[DataFrame, str]:
    """Rows joined with a broadcast bit table of bounded size, a bit per hash of ``wanted``'s first column, and the name of a column that says whether a row's bit is set.

    The table has about 16 bits for each wanted key, up to ``FILTER_BITS``.
    """
    name = wanted.columns[0]
    at, word, mask, hit = fresh(rows.columns, "at", "word", "mask", "hit")
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    hashed = wanted.filter(F.col(name).isNotNull()).select(place(name).alias(at))
    table = hashed.groupBy(F.shiftright(at, 6).alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} & 63 as int)))").alias(mask))
    joined = rows.withColumn(at, place(key)).join(F.broadcast(table), F.shiftright(at, 6) == F.col(word), how)
    return joined.withColumn(hit, F.col(key).isNotNull() & (F.expr(f"coalesce(shiftright({mask}, cast({at} & 63 as int)) & 1L, 0L)") == 1)), hit


def near(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among the wanted ones, and few others; the columns of ``rows``."""
    marked, hit = _marked(rows, key, wanted, "inner")
    return marked.filter(hit).select(*rows.columns)


def split(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`near` and the rest of the rows, whose keys aren't wanted."""
    marked, hit = _marked(rows, key, wanted, "left")
    return marked.filter(hit).select(*rows.columns), marked.filter(~F.col(hit)).select(*rows.columns)


def only(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is in ``wanted``'s only column; the columns of ``rows``.

    Most other rows are dropped where they are read; the exact join gets what is left.
    """
    (name,) = fresh(rows.columns, "wanted")
    exact = wanted.select(F.col(wanted.columns[0]).cast("long").alias(name)).distinct()
    # no semi-join: the optimizer would move it before the filter
    return near(rows, key, wanted).join(exact, F.col(key).cast("long") == F.col(name)).select(*rows.columns)
