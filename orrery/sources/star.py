"""Star-schema and web-log tables, derived from the base tables once and stored.

The fact tables are clustered by date.  From ``BY_DATE_ROWS`` rows on, ``lineorder`` is
partitioned by its date key, so that a filter on the date dimension prunes it
(dynamic partition pruning); below that, a file per date would be too small.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.shared import fingerprint, hadoop_path, shared_folder

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
BY_DATE_ROWS = 100_000_000


def _key(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd").cast("int")


def _money(column: str, kind: str = "decimal(12,2)") -> Column:
    return F.col(column).cast(kind)


def lineorder(spark: SparkSession) -> DataFrame:
    orders = spark.table("orders").select("o_orderkey", F.col("o_custkey").alias("lo_custkey"), _key(F.col("o_orderdate")).alias("lo_orderdate"))
    costs = spark.table("part").select("p_partkey", (_money("p_retailprice") * F.lit("0.6").cast("decimal(2,1)")).alias("lo_supplycost"))
    kept = F.lit(1).cast("decimal(4,2)") - _money("l_discount", "decimal(4,2)")
    rows = spark.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(costs, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("lo_orderkey"),
        F.col("l_linenumber").alias("lo_linenumber"),
        "lo_custkey",
        F.col("l_partkey").alias("lo_partkey"),
        F.col("l_suppkey").alias("lo_suppkey"),
        F.col("l_quantity").alias("lo_quantity"),
        _money("l_extendedprice").alias("lo_extendedprice"),
        F.round(F.col("l_discount") * 100).cast("int").alias("lo_discount"),
        (_money("l_extendedprice") * kept).alias("lo_revenue"),
        "lo_supplycost",
        "lo_orderdate",
    )


def dwdate(spark: SparkSession) -> DataFrame:
    days = spark.table("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(
        _key(F.col("day")).alias("d_datekey"),
        F.year("day").alias("d_year"),
        F.date_format("day", "yyyyMM").cast("int").alias("d_yearmonthnum"),
        F.date_format("day", "MMMyyyy").alias("d_yearmonth"),
        F.weekofyear("day").alias("d_weeknuminyear"),
    )


def _somewhere(spark: SparkSession, table: str, x: str) -> DataFrame:
    """A customer or supplier with its city, nation and region."""
    places = spark.table("nation").join(spark.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = table[0] + "_" + {"customer": "custkey", "supplier": "suppkey"}[table]
    city = F.concat_ws("#", "n_name", (F.col(key) % 10).cast("string"))
    return spark.table(table).join(places, F.col(f"{x}_nationkey") == F.col("n_nationkey")).select(key, F.col("n_name").alias(f"{x}_nation"), F.col("r_name").alias(f"{x}_region"), city.alias(f"{x}_city"))


def s_part(spark: SparkSession) -> DataFrame:
    brand = F.split("p_brand", "#")[1].cast("int") - 1
    maker = F.concat(F.lit("MFGR#"), (F.floor(brand / 5) + 1).cast("string"))
    category = F.concat(maker, (brand % 5 + 1).cast("string"))
    return spark.table("part").select("p_partkey", maker.alias("p_mfgr"), category.alias("p_category"), F.concat(category, F.format_string("%02d", "p_size")).alias("p_brand1"))


def rankings(spark: SparkSession) -> DataFrame:
    return spark.table("part").select(F.col("p_partkey").alias("pageURL"), F.col("p_size").alias("pageRank"))


def uservisits(spark: SparkSession) -> DataFrame:
    visits = spark.table("lineitem").join(spark.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(spark.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return visits.select(F.col("c_name").alias("sourceIP"), F.col("l_partkey").alias("destURL"), _money("l_extendedprice").alias("adRevenue"), F.to_date("l_shipdate").alias("visitDate"))


#: Tables by name: how they are derived, and the column that they are clustered by.
STAR = {
    "lineorder": (lineorder, "lo_orderdate"),
    "dwdate": (dwdate, "d_datekey"),
    "s_customer": (lambda s: _somewhere(s, "customer", "c"), None),
    "s_supplier": (lambda s: _somewhere(s, "supplier", "s"), None),
    "s_part": (s_part, None),
    "rankings": (rankings, None),
    "uservisits": (uservisits, "visitDate"),
}

#: Stored tables of this process by (application, files).
_stored: dict[tuple, dict[str, str]] = {}


def store(df: DataFrame, path: str, cluster: str | None, by_date: bool = False) -> None:
    if cluster and by_date:
        df.repartition(cluster).write.mode("overwrite").partitionBy(cluster).parquet(path)
    elif cluster:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df.repartitionByRange(n, cluster).sortWithinPartitions(cluster).write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def register_star(spark: SparkSession, folder: str, by_date_rows: int = BY_DATE_ROWS) -> None:
    """The star tables of a folder, whose base tables are registered, as views; written where that wasn't done yet."""
    folder = folder.rstrip("/")
    files = fingerprint(spark, [f"{folder}/{t}.parquet" for t in BASE])
    at = (spark.sparkContext.applicationId, files, by_date_rows)
    if at not in _stored:
        name = hashlib.sha256(repr((spark.sparkContext.applicationId, files)).encode()).hexdigest()[:16]
        root = f"{shared_folder(spark).rstrip('/')}/star-{name}-{by_date_rows}"
        jpath, fs = hadoop_path(spark, root)
        fs.deleteOnExit(jpath)
        found = {}
        by_date = spark.table("lineitem").count() >= by_date_rows
        for table, (derive, cluster) in STAR.items():
            found[table] = f"{root}/{table}"
            store(derive(spark), found[table], cluster, by_date and table == "lineorder")
        _stored[at] = found
    for table, path in _stored[at].items():
        spark.read.parquet(path).createOrReplaceTempView(table)
