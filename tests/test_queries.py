"""Every query with an oracle gives what an independent engine gives."""

import os

import __spark_entry__ as entry
import duckdb
import pytest

D = "/root/testdata/sf0.001"
NAMES = [k for k in entry.queries() if k in entry.oracle_sql() and not k.startswith("op")]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return con


def rows(values):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_equals_oracle(spark, oracle, name):
    got, want = entry.queries()[name](spark, D), oracle.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows([r[c] for c in columns] for r in got.collect()) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["revenue"] and entry.entry(spark).count() == 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["filter_lt"](spark, D)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.partition("PushedFilters: ")[2]  # abbreviated in the middle
    assert "quantity,3.0)" in pushed and "GreaterThan(l_orderkey,5" in pushed
    assert "l_tax" not in plan


def test_random_placement_uses_every_node(spark):
    for name in ("sched_random", "sched_lb"):
        got = entry.queries()[name](spark, D).collect()
        assert sorted(r.slice for r in got) == list(range(100)) and len({r.node for r in got}) >= 3
