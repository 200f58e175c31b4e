"""Queries through the engine, its client and servers, and the remaining operators, with SQL that says the same."""

from __future__ import annotations

import io
import json
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import bench
from orrery.client import Connection, RemoteConnection, ResultSet
from orrery.cluster import Membership, gather
from orrery.functions.heat import absolute_offsets, heat, kept, of_queries, read_traces, rescale
from orrery.operators.querysets import SSB
from orrery.operators.sliced import fact
from orrery.plans.intervals import as_of_join, interval_join
from orrery.plans.merge import concat, pass_through
from orrery.plans.query_info import NotAQuery, inspect
from orrery.plans.slicing import bounds, slice_frames
from orrery.runtime import SCENARIOS, Engine, QueryTimeout, run_with_timeout
from orrery.server import monitor_server, query_server
from orrery.sources.catalog import FactTable, archived, parse_fact_table, read_jdbc, rows
from orrery.sources.shared import shared_folder
from orrery.sources.views import inlined
from orrery.sources.wire import console, ddl, json_lines, read_tsv, write_tsv

NODES = ["n0", "n1", "n2", "n3"]


def _text(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")


def _engine(spark: SparkSession, scenario: str = "sticky", table: str = "lineorder", key: str = "lo_orderkey") -> Engine:
    """An engine over the tables that are registered, with a fact of 97 slices."""
    f = fact(spark)
    return Engine(spark, nodes=NODES, scenario=scenario, fact=FactTable(table, key, f.low, f.high, f.rows), slices=97)


def _scenario(name: str, query: str):
    return lambda spark: _engine(spark, name).sql(SSB[query])


def scenario_placements(spark: SparkSession) -> DataFrame:
    """Sub-queries on each node, by scenario, of the fourth star query."""
    found = []
    for name in SCENARIOS:
        found.append(_engine(spark, name).placement(SSB["ssb_q04"]).agg(F.count("*").alias("slices"), F.count_distinct("node").alias("nodes")).select(F.lit(name).alias("scenario"), "slices", (F.col("nodes") > 1).alias("spread")))
    return concat(found)


def partial_groups(spark: SparkSession) -> DataFrame:
    """The partial results of a sliced query: a row per slice and group."""
    e = _engine(spark, "full", "lineitem", "l_orderkey")
    return e.sliced("SELECT l_returnflag, COUNT(*) AS n, AVG(l_linenumber) AS a FROM lineitem GROUP BY l_returnflag").partial.groupBy("_key_0").agg(F.count("*").alias("slices"), F.sum("_rows").alias("n")).withColumnRenamed("_key_0", "l_returnflag")


def jdbc_scan(spark: SparkSession) -> DataFrame:
    """A database's table in key ranges, which executors read; the database is a read-only one that each of them opens, of a table of fixed size."""
    nation = spark.table("nation").select("n_nationkey", "n_regionkey")
    low, high = nation.agg(F.min("n_nationkey"), F.max("n_nationkey")).first()
    url = archived(spark, nation, "n")
    return read_jdbc(spark, url, "n", FactTable("n", "n_nationkey", low or 0, high or 1), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")


def bench_csv(spark: SparkSession) -> DataFrame:
    """Records of two queries that ran three times in two threads."""
    path = os.path.join(tempfile.mkdtemp(prefix="orrery-bench-"), "runs.csv")
    bench.run({"a": lambda: spark.table("region"), "b": lambda: spark.table("nation")}, threads=2, runs=3, path=path, name="two")
    with open(path) as f:
        lines = [x.strip().split(",") for x in f][1:]
    return spark.createDataFrame([(x[0], x[1], float(x[2])) for x in lines], "queryset string, query string, time double").groupBy("queryset", "query").agg(F.count("*").alias("n"), F.min(F.col("time") > 0).alias("timed"))


def query_log(spark: SparkSession) -> DataFrame:
    e = Engine(spark, nodes=NODES)
    for i in range(12):
        e.execute(f"SELECT r_name FROM region WHERE r_regionkey < {i % 6}")
    return e.log.frame(spark).groupBy("sql").agg(F.max("rows").alias("n"))


def monitoring_json(spark: SparkSession) -> DataFrame:
    e = Engine(spark, nodes=NODES)
    e.execute("SELECT * FROM region")
    found = json.loads(e.monitoring())
    return spark.createDataFrame([(found["numNodes"], ",".join(found["nodes"]), found["queries"][0]["sql"], found["queries"][0]["rows"])], "n long, nodes string, sql string, rows long")


def monitor_page(spark: SparkSession) -> DataFrame:
    """What the monitor's endpoints answer."""
    from urllib.request import urlopen

    server = monitor_server(Engine(spark, nodes=NODES))
    at = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        with urlopen(f"{at}/callback") as x, urlopen(at) as page:
            return spark.createDataFrame([(json.load(x)["numNodes"], "callback" in page.read().decode())], "n long, page boolean")
    finally:
        server.shutdown()
        server.server_close()


def remote_query(spark: SparkSession) -> DataFrame:
    """A query through the socket: PING, EXEC, typed rows."""
    server = query_server(Engine(spark, nodes=NODES))
    try:
        with RemoteConnection(f"orrery://127.0.0.1:{server.server_address[1]}") as c:
            assert c.is_valid()
            return spark.createDataFrame(c.execute_query("SELECT n_nationkey, n_name, n_regionkey FROM nation").rows, "n_nationkey int, n_name string, n_regionkey int")
    finally:
        server.shutdown()
        server.server_close()


def client_statement(spark: SparkSession) -> DataFrame:
    """Typed parameters through a prepared statement."""
    st = Connection(Engine(spark, nodes=NODES)).prepare("SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_nationkey = ? AND c_mktsegment <> ? AND c_acctbal > ? GROUP BY c_mktsegment")
    return spark.createDataFrame(st.set_int(1, 3).set_string(2, "BUILDING").set_double(3, -100.5).execute_query().rows, "c_mktsegment string, n long")


def result_cursor(spark: SparkSession) -> DataFrame:
    """Rows that cursor moves end at: first, last, two back from there, the third."""
    st = Connection(Engine(spark, nodes=NODES)).statement()
    r: ResultSet = st.execute_query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey")
    found = []
    for move in (r.first, r.last, lambda: r.relative(-2), lambda: r.absolute(3)):
        move()
        found.append((len(found), r.get_int(1), r.get_string("R_NAME")))
    return spark.createDataFrame(found, "step int, k int, name string")


def cli_lines(spark: SparkSession) -> DataFrame:
    from contextlib import redirect_stdout

    from orrery.cli import show

    out = io.StringIO()
    with redirect_stdout(out):
        show(Engine(spark, nodes=NODES), ["SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey; SELECT ';' AS c"])
    return _text(spark, out.getvalue().splitlines())


def statements_accepted(spark: SparkSession) -> DataFrame:
    found = []
    for text in ("SELECT 1", "WITH t AS (SELECT 1 AS a) SELECT a FROM t", "DELETE FROM nation", "UPDATE nation SET n_name = 'x'", "INSERT INTO nation VALUES (1)", "DROP TABLE nation", "TRUNCATE TABLE nation", "CREATE TABLE x (a INT)"):
        try:
            inspect(spark, text)
            found.append((text, True))
        except NotAQuery:
            found.append((text, False))
    return spark.createDataFrame(found, "text string, accepted boolean")


def query_roles(spark: SparkSession) -> DataFrame:
    """Tables, keys and flags that a text shows."""
    found = []
    for name in ("ssb_q01", "ssb_q07", "ssb_q13"):
        info = inspect(spark, SSB[name])
        found.append((name, ",".join(info.tables), len(info.group_keys), info.needs_sorting, info.needs_limiting))
    return spark.createDataFrame(found, "query string, tables string, keys int, sorts boolean, limits boolean")


def gathered(spark: SparkSession) -> DataFrame:
    """Slices run by a pool; one that hangs at its first attempt is run again and the second's result counts."""
    frames = slice_frames(spark.table("lineitem"), fact(spark), 8)

    def task(i: int):
        def run(attempt: int) -> int:
            if i == 7 and not attempt:
                time.sleep(20)
                return -1
            return frames[i].count()

        return run

    counts, again = gather([task(i) for i in range(len(frames))], 4)
    return spark.createDataFrame([(sum(counts), 7 in again or len(frames) < 8)], "n long, again boolean")


def timeouts(spark: SparkSession) -> DataFrame:
    def slow():
        return spark.range(4, numPartitions=2).mapInPandas(lambda it: (time.sleep(30) or x for x in it), "id long").count()

    found = []
    for name, action, seconds in (("slow", slow, 1.0), ("fast", lambda: spark.table("region").count(), 60.0)):
        try:
            run_with_timeout(spark, action, seconds)
            found.append((name, False))
        except QueryTimeout:
            found.append((name, True))
    return spark.createDataFrame(found, "name string, stopped boolean")


def membership(spark: SparkSession) -> DataFrame:
    """Members after beats at 0, 3 and 6 s with a patience of 5 s, one that left, and the session's executors."""
    now = [0.0]
    m = Membership(5.0, lambda: now[0])
    for at, node, load in ((0.0, "a", 0.5), (0.0, "d", 0.1), (3.0, "b", 0.2), (6.0, "c", 0.9)):
        now[0] = at
        m.beat(node, load)
    m.leave("d")
    found = list(m.alive().items()) + [("executors", float(len(Membership().refresh(spark)) > 0))]
    return spark.createDataFrame(found, "node string, load double")


def shard_counts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s, FactTable("t", "k", 0, 1, n).shards(s)) for n, s in ((10, 100), (100, 100), (250, 100), (6_000_000, 1_000_000))], "n long, shard long, shards long")


def fact_stated(spark: SparkSession) -> DataFrame:
    f = parse_fact_table("star.LineItem.l_orderkey[0:600000000]")
    return spark.createDataFrame([(f.name, f.key, i, low, high) for i, low, high in bounds(f, 1000)], "name string, key string, slice int, low long, high long")


def memory_rows(spark: SparkSession) -> DataFrame:
    return rows(spark, [(1, "a", None), (2, None, 2.5), (3, "c\t\"", -1.0)], "k int, s string, v double")


def tsv_files(spark: SparkSession) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/tsv-{uuid.uuid4().hex}"
    write_tsv(spark.table("nation"), path)
    return read_tsv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


def traces(spark: SparkSession) -> DataFrame:
    """Traces of three queries over two files, made from the fact table: written as their text and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/traces-{uuid.uuid4().hex}"
    names = F.when(F.col("l_linenumber") % 2 == 0, "/db/a.tail").otherwise("/db/b.tail")
    mode = F.when(F.col("l_quantity") > 25, "mmapread").otherwise("read")
    for i, q in enumerate(("q03", "q05", "q07")):
        some = spark.table("lineitem").filter(F.col("l_suppkey") % 3 == i)
        some.select(F.lit(1.5), F.lit(7), names, mode, F.col("l_orderkey") % 100, F.lit(4096)).write.option("sep", "\t").csv(f"{folder}/{q}")
    found = [read_traces(spark, f"{folder}/{q}", prefix="/db/").withColumn("query", F.lit(q.upper())) for q in ("q03", "q05", "q07")]
    return concat(found)


SIZES = [("a.tail", 409_600), ("b.tail", 819_200)]
TRACED = """t AS (SELECT 'Q0' || (l_suppkey % 3 * 2 + 3) AS query, CASE WHEN l_linenumber % 2 = 0 THEN 'a.tail' ELSE 'b.tail' END AS filename, l_orderkey % 100 AS off, l_quantity FROM lineitem),
 r AS (SELECT query, (CASE filename WHEN 'a.tail' THEN 0 ELSE 100 END) + off AS block FROM t WHERE l_quantity > 25)"""


def _blocks(spark: SparkSession) -> DataFrame:
    return absolute_offsets(traces(spark), spark.createDataFrame(SIZES, "filename string, filesize long"))


def trace_blocks(spark: SparkSession) -> DataFrame:
    return _blocks(spark).groupBy("query", "block").agg(F.count("*").alias("n"))


def trace_cells(spark: SparkSession) -> DataFrame:
    """Distinct cells of a line of 21 per query."""
    return of_queries(_blocks(spark), ["Q03", "Q07"]).select("query", rescale(F.col("block"), F.lit(300.0), 21).alias("cell")).distinct()


def trace_heat(spark: SparkSession) -> DataFrame:
    """Heat over a kept intermediate result, which is read from its second use on."""
    path = f"{shared_folder(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    kept(spark, path, lambda: _blocks(spark).select("query", "block"))
    return heat(kept(spark, path, lambda: 1 / 0))


def approximate(spark: SparkSession) -> DataFrame:
    """Approximate counts of distinct values within five times their stated error, by group."""
    found = spark.table("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"), F.approx_count_distinct("l_partkey", 0.02).alias("about"))
    return found.select("l_returnflag", "n", (F.abs(F.col("about") - F.col("n")) <= F.col("n") * 0.1 + 1).alias("near"))


#: Queries that read no star table, so that none is made for them.
BASE_ONLY = {"jdbc_scan"}

#: name: (Spark query, SQL)
SERVICES = {
    **{f"scenario_{s}_{q[4:]}": (_scenario(s, q), inlined(SSB[q])) for s, q in (("baseline", "ssb_q01"), ("rewriteround", "ssb_q01"), ("rewriterandom", "ssb_q05"), ("rewriteload", "ssb_q08"), ("full", "ssb_q11"), ("sticky", "ssb_q13"))},
    "scenario_placements": (
        scenario_placements,
        "SELECT * FROM (VALUES ('baseline', 1::BIGINT, FALSE), ('loadbalance', 1, FALSE), ('rewriteround', 97, TRUE), ('rewriterandom', 97, TRUE), ('rewriteload', 97, TRUE), ('full', 97, TRUE), ('sticky', 97, TRUE)) t(scenario, slices, spread)",
    ),
    "scenario_avg": (
        lambda s: _engine(s, "sticky", "lineitem", "l_orderkey").sql("SELECT l_returnflag, AVG(l_linenumber) AS a, COUNT(*) + 1 AS n, MIN(l_quantity) AS lo FROM lineitem WHERE l_quantity > 5 GROUP BY l_returnflag ORDER BY n DESC, l_returnflag LIMIT 2 OFFSET 1"),
        "SELECT l_returnflag, AVG(l_linenumber) AS a, COUNT(*) + 1 AS n, MIN(l_quantity) AS lo FROM lineitem WHERE l_quantity > 5 GROUP BY l_returnflag ORDER BY n DESC, l_returnflag LIMIT 2 OFFSET 1",
    ),
    "partial_groups": (
        partial_groups,
        "WITH e AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, greatest(1, least(97, max(l_orderkey) - min(l_orderkey))) AS n FROM lineitem) SELECT l_returnflag, COUNT(DISTINCT least(n - 1, greatest(0, l_orderkey - lo - 1) // greatest(1, (hi - lo) // n))) AS slices, COUNT(*) AS n FROM lineitem, e GROUP BY l_returnflag",
    ),
    "jdbc_scan": (jdbc_scan, "SELECT n_nationkey, n_regionkey FROM nation"),
    "fact_stated": (fact_stated, "SELECT 'lineitem' AS name, 'l_orderkey' AS key, CAST(i AS INT) AS slice, i * 600000 AS low, (i + 1) * 600000 AS high FROM range(1000) t(i)"),
    "memory_rows": (memory_rows, "SELECT * FROM (VALUES (1, 'a', NULL::DOUBLE), (2, NULL, 2.5), (3, 'c' || chr(9) || '\"', -1.0)) t(k, s, v)"),
    "tsv_files": (tsv_files, "SELECT * FROM nation"),
    "console_lines": (
        lambda s: _text(s, console(s.table("region").orderBy("r_regionkey"), 2).splitlines()),
        "SELECT CAST(0 AS BIGINT) AS line, 'r_regionkey' || chr(9) || 'r_name' AS text UNION ALL SELECT 1, 'INTEGER' || chr(9) || 'VARCHAR' UNION ALL SELECT 2 + r_regionkey, r_regionkey || chr(9) || r_name FROM region WHERE r_regionkey < 2 UNION ALL SELECT 4, '... more than 2 rows'",
    ),
    "ddl_text": (lambda s: _text(s, [ddl("nation", s.table("nation"))]), "SELECT CAST(0 AS BIGINT) AS line, 'CREATE TABLE nation (n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER)' AS text"),
    "json_rows": (lambda s: json_lines(s.table("region")), "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region"),
    "bench_csv": (bench_csv, "SELECT 'two' AS queryset, q AS query, CAST(6 AS BIGINT) AS n, TRUE AS timed FROM (VALUES ('a'), ('b')) t(q)"),
    "monitoring_json": (monitoring_json, "SELECT CAST(4 AS BIGINT) AS n, 'n0,n1,n2,n3' AS nodes, 'SELECT * FROM region' AS sql, COUNT(*) AS rows FROM region"),
    "monitor_page": (monitor_page, "SELECT CAST(4 AS BIGINT) AS n, TRUE AS page"),
    "query_log": (query_log, "SELECT 'SELECT r_name FROM region WHERE r_regionkey < ' || i AS sql, (SELECT COUNT(*) FROM region WHERE r_regionkey < i) AS n FROM range(6) t(i)"),
    "remote_query": (remote_query, "SELECT * FROM nation"),
    "client_statement": (client_statement, "SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_nationkey = 3 AND c_mktsegment <> 'BUILDING' AND c_acctbal > -100.5 GROUP BY c_mktsegment"),
    "result_cursor": (result_cursor, "SELECT CAST(s AS INT) AS step, r_regionkey AS k, r_name AS name FROM (VALUES (0, 0), (1, 4), (2, 2), (3, 2)) t(s, k) JOIN region ON r_regionkey = k"),
    "cli_lines": (
        cli_lines,
        "SELECT CAST(0 AS BIGINT) AS line, 'r_regionkey' || chr(9) || 'r_name' AS text UNION ALL SELECT 1, 'INTEGER' || chr(9) || 'VARCHAR' UNION ALL SELECT 2 + r_regionkey, r_regionkey || chr(9) || '\"' || r_name || '\"' FROM region UNION ALL SELECT 2 + (SELECT COUNT(*) FROM region), 'c' UNION ALL SELECT 3 + (SELECT COUNT(*) FROM region), 'VARCHAR' UNION ALL SELECT 4 + (SELECT COUNT(*) FROM region), '\";\"'",
    ),
    "statements_accepted": (
        statements_accepted,
        "SELECT * FROM (VALUES ('SELECT 1', TRUE), ('WITH t AS (SELECT 1 AS a) SELECT a FROM t', TRUE), ('DELETE FROM nation', FALSE), ('UPDATE nation SET n_name = ''x''', FALSE), ('INSERT INTO nation VALUES (1)', FALSE), ('DROP TABLE nation', FALSE), ('TRUNCATE TABLE nation', FALSE), ('CREATE TABLE x (a INT)', FALSE)) t(text, accepted)",
    ),
    "query_roles": (
        query_roles,
        "SELECT * FROM (VALUES ('ssb_q01', 'dwdate,lineorder', 0, FALSE, FALSE), ('ssb_q07', 'dwdate,lineorder,s_customer,s_supplier', 3, TRUE, FALSE), ('ssb_q13', 'dwdate,lineorder,s_customer,s_part,s_supplier', 3, TRUE, FALSE)) t(query, tables, keys, sorts, limits)",
    ),
    "gathered": (gathered, "SELECT COUNT(*) AS n, TRUE AS again FROM lineitem"),
    "timeouts": (timeouts, "SELECT * FROM (VALUES ('slow', TRUE), ('fast', FALSE)) t(name, stopped)"),
    "membership": (membership, "SELECT * FROM (VALUES ('b', 0.2::DOUBLE), ('c', 0.9), ('executors', 1.0)) t(node, load)"),
    "shard_counts": (shard_counts, "SELECT n, shard, CASE WHEN shard > n THEN 1 ELSE n // shard END AS shards FROM (VALUES (10::BIGINT, 100::BIGINT), (100, 100), (250, 100), (6000000, 1000000)) t(n, shard)"),
    "pass_through": (lambda s: pass_through([s.table("region")]), "SELECT * FROM region"),
    "concat_parts": (lambda s: concat(slice_frames(s.table("orders").select("o_orderkey", "o_custkey"), FactTable("orders", "o_orderkey", 0, 1000), 3)), "SELECT o_orderkey, o_custkey FROM orders"),
    "limit_unordered": (lambda s: s.sql("SELECT COUNT(*) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 7) t"), "SELECT COUNT(*) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 7) t"),
    "agg_sorted": (lambda s: s.sql("SELECT l_suppkey, MAX(l_returnflag) AS a, MIN(l_linestatus) AS b FROM lineitem GROUP BY l_suppkey"), "SELECT l_suppkey, MAX(l_returnflag) AS a, MIN(l_linestatus) AS b FROM lineitem GROUP BY l_suppkey"),
    "agg_approximate": (approximate, "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS n, TRUE AS near FROM lineitem GROUP BY l_returnflag"),
    "agg_percentile": (
        lambda s: s.sql("SELECT l_returnflag, percentile(l_quantity, 0.1) AS low, percentile(l_extendedprice, 0.75) AS high FROM lineitem GROUP BY l_returnflag"),
        "SELECT l_returnflag, quantile_cont(l_quantity, 0.1) AS low, quantile_cont(l_extendedprice, 0.75) AS high FROM lineitem GROUP BY l_returnflag",
    ),
    "join_interval": (
        lambda s: interval_join(s.table("lineitem").select("l_partkey"), s.sql("SELECT p_partkey, p_partkey + p_size AS p_end FROM part WHERE p_size > 40"), "l_partkey", "p_partkey", "p_end", 50).groupBy("p_partkey").agg(F.count("*").alias("n")),
        "SELECT p_partkey, COUNT(*) AS n FROM part JOIN lineitem ON l_partkey >= p_partkey AND l_partkey < p_partkey + p_size WHERE p_size > 40 GROUP BY p_partkey",
    ),
    "join_as_of": (
        lambda s: as_of_join(s.sql("SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'"), s.sql("SELECT user_id, ts, event_id AS click FROM events WHERE event_type = 'click'"), "ts", ["user_id"], "click").select("event_id", "click"),
        "SELECT e.event_id, c.click FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS click FROM events WHERE event_type = 'click' GROUP BY user_id, ts) c ON e.user_id = c.user_id AND e.ts >= c.ts",
    ),
    "trace_blocks": (trace_blocks, f"WITH {TRACED} SELECT query, CAST(block AS DOUBLE) AS block, COUNT(*) AS n FROM r GROUP BY query, block"),
    "trace_cells": (trace_cells, f"WITH {TRACED} SELECT DISTINCT query, CAST(round_even(block / 300.0 * 20, 0) AS BIGINT) AS cell FROM r WHERE query IN ('Q03', 'Q07')"),
    "trace_heat": (trace_heat, f"WITH {TRACED} SELECT CAST(block AS DOUBLE) AS block, COUNT(DISTINCT query) AS heat, CASE WHEN COUNT(DISTINCT query) >= 2 THEN 'yellow' ELSE 'none' END AS band FROM r GROUP BY block"),
}
