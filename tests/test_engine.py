"""Classification of queries, client, wire text, discovery, runtime, streaming, bench."""

import datetime
import io
import json
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orrery import bench, cli
from orrery.client import ResultSet, connect
from orrery.functions.heat import absolute_offsets, heat, of_queries, read_traces, rescale
from orrery.functions.stats import describe
from orrery.plans import policies
from orrery.plans.merge import Agg
from orrery.plans.query_info import NotAQuery, inspect
from orrery.runtime import SCENARIOS, Engine, LogEntry, QueryLog, QueryTimeout, place, run_with_timeout, speculation
from orrery.sources.catalog import candidates, discover, parse_fact_table, rows
from orrery.sources.wire import console, ddl, from_wire, json_lines, parse_wire, read_tsv, to_wire, write_tsv
from orrery.streaming import merged_stream, to_memory

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "tail,limits,sorts",
    [("ORDER BY b LIMIT 10 OFFSET 10", True, True), ("LIMIT 10 OFFSET 10", True, False), ("ORDER BY b LIMIT 10", True, True), ("ORDER BY b OFFSET 10", True, True), ("OFFSET 10", True, False), ("LIMIT 10", True, False), ("ORDER BY b", False, True), ("", False, False)],
)
def test_classification(spark, tail, limits, sorts):
    info = inspect(spark, f"SELECT a FROM foo {tail}")
    assert (info.needs_limiting, info.needs_sorting, info.tables) == (limits, sorts, ["foo"])


def test_roles_and_tables(spark):
    info = inspect(spark, "SELECT sum(a) AS s, b FROM x.Foo f, bar JOIN (SELECT * FROM Baz) z ON f.i = z.i GROUP BY b;")
    assert info.tables == ["bar", "baz", "foo"] and info.group_keys == ["b"] and info.aggregates[0].startswith("sum(")
    assert inspect(spark, "SELECT DISTINCT a FROM t").distinct
    for bad in ("DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE t (a INT)", "DELETE FROM t", "UPDATE t SET a = 1", "TRUNCATE TABLE t"):
        with pytest.raises(NotAQuery):
            inspect(spark, bad)


def test_fact_tables(spark):
    f = parse_fact_table("db.LineItem.l_orderkey[0:60000]")
    assert (f.schema, f.name, f.key, f.low, f.high) == ("db", "lineitem", "l_orderkey", 0, 60000)
    for bad in ("lineitem", "a.b[1]", "a.b[5:1]"):
        with pytest.raises(ValueError):
            parse_fact_table(bad)
    Engine(spark, D)
    found = discover(spark, ["lineitem", "orders", "region"])
    assert (found.name, found.key, found.rows) == ("lineitem", "l_orderkey", spark.table("lineitem").count())
    assert discover(spark, ["lineitem"], {"lineitem": ["l_suppkey"]}).key == "l_suppkey"
    assert candidates(spark, ["region"]).count() == 1
    with pytest.raises(ValueError):
        candidates(spark, ["region"], {})


def test_wire(spark, tmp_path):
    lines = ["l_orderkey\tl_extendedprice\tl_returnflag", "INTEGER\tDECIMAL(10,2)\tVARCHAR(100)", '42\t42.20\t"asdf"', '21\t21.10\t"fd\\ts\\"a"', "NULL\tNULL\tNULL"]
    names, kinds, got = parse_wire(lines)
    assert got == [(42, Decimal("42.20"), "asdf"), (21, Decimal("21.10"), 'fd\ts"a'), (None, None, None)] and kinds[2] == "VARCHAR(100)"
    df = from_wire(spark, lines)
    again = list(to_wire(df))
    assert again[0] == lines[0] and again[2:] == lines[2:]
    assert ddl("t", df) == "CREATE TABLE t (l_orderkey INTEGER, l_extendedprice DECIMAL(10,2), l_returnflag VARCHAR)"
    assert console(df).splitlines()[-1] == "NULL\tNULL\tNULL"
    full = rows(spark, [(datetime.date(2020, 1, 2), True, 1.5, datetime.datetime(2020, 1, 2, 3, 4, 5))], "d date, b boolean, f double, t timestamp_ntz")
    assert from_wire(spark, to_wire(full)).collect() == full.collect()
    write_tsv(df, f"{tmp_path}/x")
    assert sorted(map(tuple, read_tsv(spark, f"{tmp_path}/x", "l_orderkey int, l_extendedprice decimal(10,2), l_returnflag string").collect()), key=str) == sorted(got, key=str)
    assert json.loads(json_lines(df).first().json)["l_orderkey"] == 42


def test_client(spark):
    with connect(spark, D) as c:
        assert c.is_valid()
        st = c.prepare("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = ? AND n_name <> ? ORDER BY n_nationkey").set_int(1, 2).set_string(2, "NATION_7")
        r = st.execute_query()
        assert r.names == ["n_nationkey", "n_name"] and r.types == ["INTEGER", "VARCHAR"] and len(r) == 4
        assert not r.previous() and r.next() and r.get_int(1) == r.get_long("N_NATIONKEY") and r.get_string(2).startswith("NATION_")
        assert r.last() and not r.next() and r.previous() and r.absolute(-1) and r.relative(-2) and r.at == 2
        with pytest.raises(IndexError):
            r.get(3)
        with pytest.raises(KeyError):
            r.find_column("z")
        r.before_first()
        with pytest.raises(IndexError):
            r.get(1)
        assert st.set_null(1).execute_query().rows == []
        with pytest.raises(NotAQuery):
            c.statement().execute("DROP TABLE nation")
        with pytest.raises(ValueError):
            c.prepare("SELECT ?").set_int(2, 1).execute_query()
        assert json.loads(c.engine.monitoring())["numNodes"] == 1
    with pytest.raises(RuntimeError):
        c.statement()


def test_getters():
    r = ResultSet(["d", "t", "n", "u", "b"], ["VARCHAR"] * 5, [("2020-01-02", "03:04:05", None, "http://h/p", True)])
    r.first()
    assert r.get_date(1) == datetime.date(2020, 1, 2) and r.get_time(2) == datetime.time(3, 4, 5) and r.get_int(3) is None and r.was_null
    assert r.get_url(4).netloc == "h" and r.get_boolean(5) is True and r.get_timestamp(1) == datetime.datetime(2020, 1, 2)


def test_runtime(spark):
    log = QueryLog(3)
    for i in range(5):
        log.add(LogEntry(str(i), "q", 0.0, 0.1, i))
    assert [r.id for r in log.frame(spark).collect()] == ["2", "3", "4"]
    nodes = ["a", "b", "c"]
    assert {s: place(spark, v, 6, nodes).count() for s, v in SCENARIOS.items()} == {"baseline": 1, "loadbalance": 1, "rewriteround": 6, "rewriterandom": 6, "rewriteload": 6, "full": 6, "sticky": 6}
    assert speculation()["spark.speculation.quantile"] == "0.75"
    with pytest.raises(QueryTimeout):
        run_with_timeout(spark, lambda: spark.range(10, numPartitions=2).mapInPandas(lambda it: (time.sleep(20) or x for x in it), "id long").count(), 1.5)
    assert run_with_timeout(spark, lambda: 5, 10) == 5
    with pytest.raises(ValueError):
        policies.sticky(spark, 0, nodes)
    assert [r.node for r in policies.round_robin(spark, 4, nodes, last=1).orderBy("slice").collect()] == ["c", "a", "b", "c"]
    assert policies.reschedule(policies.single(spark, 2, ["a"]), 1, ["a"]).filter("node = 'a'").count() == 2
    assert policies.per_node(policies.sticky(spark, 100, [f"n{i}" for i in range(10)])).filter("slices = 10").count() == 10


def test_cli(spark, tmp_path):
    (tmp_path / "q.sql").write_text("SELECT r_name FROM region WHERE r_regionkey = 1; SELECT ';' AS c;")
    out = io.StringIO()
    assert cli.main(["-d", D, "-q", "SELECT 1 AS one", str(tmp_path / "q.sql")], spark, out) == 0
    assert out.getvalue().splitlines() == ["one", "INTEGER", "1", "r_name", "VARCHAR", '"AMERICA"', "c", "VARCHAR", '";"']


def test_bench(spark, tmp_path):
    got = bench.run({"a": lambda: spark.range(5), "b": lambda: spark.range(3)}, threads=2, warmup=1, runs=2, path=f"{tmp_path}/r.csv")
    assert got["queries"]["a"]["count"] == 4 and got["qps"] > 0 and (tmp_path / "r.csv").read_text().count("\n") == 9
    assert len(bench.SETS["star"]) == 13 and len(bench.SETS["star-fast"]) == 9


def test_statistics(spark):
    r = describe(spark.createDataFrame([(1.0,), (4.0,), (None,), (2.5,)], "v double"), "v").first()
    assert (r.min, r.max, r.mean, r.median, r["count"], r.sum) == (1.0, 4.0, 2.5, 2.5, 3, 7.5)


def test_heat(spark, tmp_path):
    for q in ("q03", "q05"):
        (tmp_path / f"{q}.io.tsv").write_text(f"1.0\t5\t/db/b\tmmapread\t{2 if q == 'q03' else 3}\t4096\n2.0\t5\t/db/a\tmmapread\t0\t4096\n3.0\t5\t/db/a\tread\t9\t1\n")
    traces = read_traces(spark, f"{tmp_path}/q03.io.tsv", f"{tmp_path}/q05.io.tsv", prefix="/db/")
    sizes = spark.createDataFrame([("b", 8192), ("a", 4096)], "filename string, filesize long")
    got = absolute_offsets(traces, sizes)
    assert sorted((r.query, r.block) for r in got.collect()) == [("Q03", 0.0), ("Q03", 3.0), ("Q05", 0.0), ("Q05", 4.0)]
    assert {(r.block, r.heat, r.band) for r in heat(got).collect()} == {(0.0, 2, "yellow"), (3.0, 1, "none"), (4.0, 1, "none")}
    assert of_queries(got, ["Q03"]).count() == 2
    cells = spark.createDataFrame([(0.5,), (1.5,)], "b double").select(rescale(F.col("b"), F.lit(1.0), 2).alias("c")).collect()
    assert [r.c for r in cells] == [0, 2]


def test_stream_of_partials(spark, tmp_path):
    schema, agg = "g string, _s_value long", [Agg("sum", "v", "s")]
    for i in range(3):
        spark.createDataFrame([("a", i), ("b", 10)], schema).write.mode("append").parquet(f"{tmp_path}/parts")
    q = to_memory(merged_stream(spark, f"{tmp_path}/parts", schema, ["g"], agg), "merged_parts")
    q.awaitTermination(60)
    assert {(r.g, r.s) for r in spark.table("merged_parts").collect()} == {("a", 3), ("b", 30)}
