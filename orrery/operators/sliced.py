"""Queries through the slice, placement, discovery and wire layers, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.heat import heat, running_sum
from orrery.functions.stats import describe
from orrery.operators.querysets import SSB
from orrery.plans import policies
from orrery.plans.merge import Agg, aggregate, combine
from orrery.plans.slicing import profile, sliced
from orrery.sources.catalog import FactTable, discover
from orrery.sources.views import inlined
from orrery.sources.wire import from_wire, to_wire

SLICES = 97
NODES = ["n0", "n1", "n2", "n3", "n4"]
LOADS = [0.5, 0.1, 0.9, 0.3, 0.2]
PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"


def fact(spark: SparkSession) -> FactTable:
    low, high, rows = spark.table("lineitem").agg(F.min("l_orderkey"), F.max("l_orderkey"), F.count("*")).first()
    return FactTable("lineitem", "l_orderkey", low or 0, high or 0, rows)


def _aggregate(keys: list[str], aggs: list[Agg]):
    return lambda spark: aggregate(spark.table("lineitem"), fact(spark), SLICES, keys, aggs)


def _double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def sliced_ssb_q01(spark: SparkSession) -> DataFrame:
    """The first star query: the fact's slices against the whole date dimension."""
    f = fact(spark)
    star = spark.table("lineorder").join(spark.table("dwdate"), F.col("lo_orderdate") == F.col("d_datekey")).filter("d_year = 1996 AND lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25")
    return _double(aggregate(star, FactTable("lineorder", "lo_orderkey", f.low, f.high, f.rows), SLICES, [], [Agg("sum", "lo_extendedprice * lo_discount", "revenue")]), "revenue")


def sliced_ssb_q04(spark: SparkSession) -> DataFrame:
    f = fact(spark)
    star = spark.table("lineorder").join(spark.table("dwdate"), F.col("lo_orderdate") == F.col("d_datekey")).join(spark.table("s_part"), F.col("lo_partkey") == F.col("p_partkey")).join(spark.table("s_supplier"), F.col("lo_suppkey") == F.col("s_suppkey")).filter("p_category = 'MFGR#12' AND s_region = 'AMERICA'")
    return _double(aggregate(star, FactTable("lineorder", "lo_orderkey", f.low, f.high, f.rows), SLICES, ["d_year", "p_brand1"], [Agg("sum", "lo_revenue", "revenue")]), "revenue")


def sliced_concat(spark: SparkSession) -> DataFrame:
    """All slices of one scan, in one bag."""
    return sliced(spark.table("lineitem").filter("l_quantity > 45"), fact(spark), 10).select("l_orderkey", "l_linenumber", "l_partkey")


def sliced_topk(spark: SparkSession) -> DataFrame:
    """Order and limit over all slices together."""
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return combine([sliced(spark.table("lineitem"), fact(spark), 10).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")], order=order, limit=20, offset=3)


def slice_profile(spark: SparkSession) -> DataFrame:
    return profile(spark, spark.table("lineitem"), fact(spark), SLICES)


def slice_column(spark: SparkSession) -> DataFrame:
    return sliced(spark.table("lineitem"), fact(spark), 10).groupBy("slice").agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


def fact_discovery(spark: SparkSession) -> DataFrame:
    f = discover(spark, ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"])
    return spark.createDataFrame([(f.name, f.key, f.low, f.high, f.rows)], "name string, key string, low long, high long, n_rows long")


def wire_round_trip(spark: SparkSession) -> DataFrame:
    return from_wire(spark, to_wire(spark.table("nation").orderBy("n_nationkey")))


def bound_parameters(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = ? AND c_mktsegment = ?", args=[3, "BUILDING"])


#: name: (Spark query, SQL)
QUERIES = {
    "sliced_sum": (lambda s: _double(_aggregate([], [Agg("sum", PRICE, "v")])(s), "v"), f"SELECT CAST(SUM({PRICE}) AS DOUBLE) AS v FROM lineitem"),
    "sliced_count": (_aggregate(["l_returnflag"], [Agg("count", "*", "n"), Agg("count", "nullif(l_linenumber, 1)", "m")]), "SELECT l_returnflag, COUNT(*) AS n, COUNT(nullif(l_linenumber, 1)) AS m FROM lineitem GROUP BY l_returnflag"),
    "sliced_minmax": (_aggregate(["l_linestatus"], [Agg("min", "l_shipdate", "a"), Agg("max", "l_returnflag", "b")]), "SELECT l_linestatus, MIN(l_shipdate) AS a, MAX(l_returnflag) AS b FROM lineitem GROUP BY l_linestatus"),
    "sliced_avg": (_aggregate(["l_returnflag"], [Agg("avg", "l_linenumber", "a"), Agg("avg", "nullif(l_partkey, 5)", "b")]), "SELECT l_returnflag, AVG(l_linenumber) AS a, AVG(nullif(l_partkey, 5)) AS b FROM lineitem GROUP BY l_returnflag"),
    "sliced_group": (_aggregate(["l_returnflag", "l_linestatus"], [Agg("sum", "l_linenumber", "s"), Agg("count_distinct", "l_suppkey", "d"), Agg("count", "*", "n")]), "SELECT l_returnflag, l_linestatus, CAST(SUM(l_linenumber) AS BIGINT) AS s, COUNT(DISTINCT l_suppkey) AS d, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "sliced_first_last": (_aggregate(["l_linestatus"], [Agg("first", "l_partkey", "a", "struct(l_shipdate, l_orderkey, l_partkey)"), Agg("last", "l_partkey", "b", "struct(l_shipdate, l_orderkey, l_partkey)")]), "SELECT l_linestatus, arg_min(l_partkey, row(l_shipdate, l_orderkey, l_partkey)) AS a, arg_max(l_partkey, row(l_shipdate, l_orderkey, l_partkey)) AS b FROM lineitem GROUP BY l_linestatus"),
    "sliced_ssb_q01": (sliced_ssb_q01, inlined(SSB["ssb_q01"])),
    "sliced_ssb_q04": (sliced_ssb_q04, inlined(SSB["ssb_q04"])),
    "sliced_concat": (sliced_concat, "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 45"),
    "sliced_topk": (sliced_topk, "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20 OFFSET 3"),
    "slice_profile": (
        slice_profile,
        f"""WITH e AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem), c AS (SELECT lo, hi, greatest(1, least({SLICES}, hi - lo)) AS n FROM e),
 b AS (SELECT CAST(i AS INT) AS slice, lo, lo + i * ((hi - lo) // n) AS low, CASE WHEN i = n - 1 THEN hi ELSE lo + (i + 1) * ((hi - lo) // n) END AS high FROM c, range({SLICES}) t(i) WHERE i < n)
SELECT slice, low, high, COUNT(l_orderkey) AS rows FROM b LEFT JOIN lineitem ON l_orderkey <= high AND (l_orderkey > low OR (slice = 0 AND l_orderkey >= low)) GROUP BY slice, low, high""",
    ),
    "slice_column": (
        slice_column,
        """WITH e AS (SELECT min(l_orderkey) AS lo, greatest(1, (max(l_orderkey) - min(l_orderkey)) // 10) AS stride FROM lineitem)
SELECT CAST(least(9, greatest(0, l_orderkey - lo - 1) // stride) AS INT) AS slice, MIN(l_orderkey) AS low, MAX(l_orderkey) AS high FROM lineitem, e GROUP BY 1""",
    ),
    "fact_discovery": (fact_discovery, "SELECT 'lineitem' AS name, 'l_orderkey' AS key, min(l_orderkey) AS low, max(l_orderkey) AS high, count(*) AS n_rows FROM lineitem"),
    "wire_round_trip": (wire_round_trip, "SELECT * FROM nation"),
    "bound_parameters": (bound_parameters, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'"),
    "sched_single": (lambda s: policies.single(s, 100, NODES), "SELECT CAST(i AS INT) AS slice, 'n0' AS node FROM range(100) t(i)"),
    "sched_roundrobin": (lambda s: policies.round_robin(s, 100, NODES), "SELECT CAST(i AS INT) AS slice, 'n' || ((i + 1) % 5) AS node FROM range(100) t(i)"),
    "sched_sticky": (lambda s: policies.sticky(s, 100, NODES), "SELECT CAST(i AS INT) AS slice, 'n' || (i % 5) AS node FROM range(100) t(i)"),
    "sched_sticky_lb": (
        lambda s: policies.sticky_load_balancing(s, 100, NODES, LOADS),
        "SELECT CAST(i AS INT) AS slice, 'n' || (CASE WHEN l[(i + 1) % 5 + 1] < l[i % 5 + 1] THEN (i + 1) % 5 ELSE i % 5 END) AS node FROM range(100) t(i), (SELECT [0.5, 0.1, 0.9, 0.3, 0.2] AS l) x",
    ),
    "sched_random": (lambda s: policies.random(s, 100, NODES), "SELECT CAST(i AS INT) AS slice, 'n' || (((i * 2 + 1) * 1103515245 + 12345) % 2147483648 // 65536 % 5) AS node FROM range(100) t(i)"),
    "sched_lb": (
        lambda s: policies.load_balancing(s, 100, NODES, LOADS),
        """WITH d AS (SELECT i, ((i * 2 + 1) * 1103515245 + 12345) % 2147483648 // 65536 % 5 AS a, ((i * 2 + 2) * 1103515245 + 12345) % 2147483648 // 65536 % 5 AS b, [0.5, 0.1, 0.9, 0.3, 0.2] AS l FROM range(100) t(i))
SELECT CAST(i AS INT) AS slice, 'n' || (CASE WHEN l[b + 1] < l[a + 1] THEN b ELSE a END) AS node FROM d""",
    ),
    "sched_reschedule": (lambda s: policies.reschedule(policies.sticky(s, 100, NODES), 4, NODES), "SELECT CAST(i AS INT) AS slice, 'n' || (CASE WHEN i = 4 THEN 0 ELSE i % 5 END) AS node FROM range(100) t(i)"),
    "latency_stats": (lambda s: describe(s.table("lineitem"), "l_quantity", "l_returnflag"), "SELECT l_returnflag, MIN(l_quantity) AS min, MAX(l_quantity) AS max, AVG(l_quantity) AS mean, median(l_quantity) AS median, COUNT(l_quantity) AS count, SUM(l_quantity) AS sum FROM lineitem GROUP BY l_returnflag"),
    "running_sum": (lambda s: running_sum(s.table("part").select("p_brand", "p_partkey", "p_size"), "p_size", ["p_partkey"], "start", ["p_brand"]), "SELECT p_brand, p_partkey, p_size, CAST(coalesce(SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM part"),
    "heat_count": (
        lambda s: heat(s.table("lineitem").select((F.col("l_orderkey") % 500).alias("block"), (F.col("l_suppkey") % 9).alias("query"))),
        "SELECT l_orderkey % 500 AS block, COUNT(DISTINCT l_suppkey % 9) AS heat, CASE WHEN COUNT(DISTINCT l_suppkey % 9) > 7 THEN 'red' WHEN COUNT(DISTINCT l_suppkey % 9) >= 6 THEN 'orange' WHEN COUNT(DISTINCT l_suppkey % 9) >= 2 THEN 'yellow' ELSE 'none' END AS band FROM lineitem GROUP BY 1",
    ),
}
