"""Tables: Parquet views, fact tables and how they are found."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
import zipfile
from dataclasses import dataclass
from hashlib import sha256

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SHARD_ROWS = 1_000_000


@dataclass(frozen=True)
class FactTable:
    """The one table that is sliced: by ranges of an integral key."""

    name: str
    key: str
    low: int
    high: int
    rows: int | None = None
    schema: str | None = None

    def shards(self, shard_rows: int = SHARD_ROWS) -> int:
        """Slices of about ``shard_rows`` rows; one for a smaller table."""
        if shard_rows < 1:
            raise ValueError("a slice has at least one row")
        return 1 if self.rows is None or shard_rows > self.rows else self.rows // shard_rows


def register(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> None:
    """Each Parquet table of the folder as a temporary view."""
    for t in tables:
        spark.read.parquet(f"{folder.rstrip('/')}/{t}.parquet").createOrReplaceTempView(t)


def parse_fact_table(text: str) -> FactTable:
    """``table.column[min:max]``."""
    m = re.fullmatch(r"\s*(?:(\w+)\.)?(\w+)\.(\w+)\s*\[\s*(-?\d+)\s*:\s*(-?\d+)\s*\]\s*", text)
    if not m:
        raise ValueError(f"not of the form table.column[min:max]: {text!r}")
    low, high = int(m[4]), int(m[5])
    if low > high:
        raise ValueError("the range is empty")
    return FactTable(m[2].lower(), m[3].lower(), low, high, None, m[1].lower() if m[1] else None)


def integral_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]


def candidates(spark: SparkSession, tables: list[str], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """(table, key, rows, low, high, spread): one row per candidate key, from one aggregate per table.

    Parquet has no primary keys: ``keys`` declares candidates by table, else all
    integral columns are looked at.
    """
    found = None
    for t in tables:
        df = spark.table(t)
        columns = (keys or {}).get(t, integral_columns(df) if keys is None else [])
        if not columns:
            continue
        ends = [F.struct(F.lit(c).alias("key"), F.min(c).cast("long").alias("low"), F.max(c).cast("long").alias("high")) for c in columns]
        one = df.agg(F.count("*").alias("rows"), F.array(*ends).alias("ends")).select(F.lit(t).alias("table"), "rows", F.explode("ends").alias("end")).select("table", "end.key", "rows", "end.low", "end.high", (F.col("end.high") - F.col("end.low")).alias("spread"))
        found = one if found is None else found.union(one)
    if found is None:
        raise ValueError("no table has a candidate key")
    return found


def discover(spark: SparkSession, tables: list[str] | None = None, keys: dict[str, list[str]] | None = None) -> FactTable:
    """The largest table, by its key of the widest range; ties go to the first name."""
    tables = tables or sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)
    best = candidates(spark, tables, keys).filter("spread is not null").orderBy(F.desc("rows"), F.desc("spread"), "table", "key").first()
    if best is None:
        raise ValueError("no table has a candidate key")
    return FactTable(best["table"], best["key"], best.low, best.high, best.rows)


def read_jdbc(spark: SparkSession, url: str, table: str, fact: FactTable | None = None, slices: int = 1, **properties: str) -> DataFrame:
    """A live database's table, in as many key ranges as there are slices."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if fact is not None and slices > 1:
        reader = reader.option("partitionColumn", fact.key).option("lowerBound", fact.low).option("upperBound", fact.high).option("numPartitions", slices)
    return reader.load()


#: Archives by the table that they hold; they go when the process ends.
_archives: dict[str, tuple[tempfile.TemporaryDirectory, str]] = {}


def archived(spark: SparkSession, df: DataFrame, table: str) -> str:
    """The address of a read-only database that holds ``df``, a table of integers, and that the driver and all executors can open.

    An embedded database lives in the one process that opened it. This one is made by the driver and
    goes to the executors as an archive on their class path, so they need no folder or server in common.
    """
    folder = tempfile.TemporaryDirectory(prefix="orrery-db-", ignore_cleanup_errors=True)
    at, name = os.path.realpath(folder.name), f"d{uuid.uuid4().hex}"
    columns = ", ".join(f'"{c}" {kind}' for c, kind in df.dtypes)
    seen = sha256(f"{table} {columns}\n".encode())
    with open(f"{at}/rows.csv", "w") as f:
        for r in df.toLocalIterator():
            print(*("" if x is None else x for x in r), sep=",", file=f)
            seen.update(f"{tuple(r)}\n".encode())
    if (key := seen.hexdigest()) not in _archives:
        _archive(spark, at, name, table, columns)
        _archives[key] = folder, name
    folder, name = _archives[key]
    spark.sql(f"ADD JAR '{os.path.realpath(folder.name)}/{name}.jar'")  # also makes this thread see it
    return f"jdbc:derby:classpath:{name}"


def _archive(spark: SparkSession, at: str, name: str, table: str, columns: str) -> None:
    """The rows of ``rows.csv`` as a database, in an archive that isn't compressed, as pages are read by their place."""
    jvm, url = spark.sparkContext._jvm, f"jdbc:derby:directory:{at}/{name}"
    jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)
    connection = jvm.java.sql.DriverManager.getConnection(f"{url};create=true")
    try:
        statement = connection.createStatement()
        statement.execute(f"CREATE TABLE {table} ({columns})")
        statement.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table.upper()}', '{at}/rows.csv', NULL, NULL, 'UTF-8', 0)")
    finally:
        connection.close()
        try:
            jvm.java.sql.DriverManager.getConnection(f"{url};shutdown=true")
        except Py4JJavaError as e:  # how it says that it ended
            if e.java_exception.getSQLState() != "08006":
                raise
    with zipfile.ZipFile(f"{at}/{name}.jar", "w") as z:
        for top, _, names in os.walk(f"{at}/{name}"):
            for x in names:
                z.write(os.path.join(top, x), os.path.relpath(os.path.join(top, x), at))
    shutil.rmtree(f"{at}/{name}")
    os.remove(f"{at}/rows.csv")


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    """An in-memory source."""
    return spark.createDataFrame(data, schema)
