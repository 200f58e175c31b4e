"""The inventory's queries run over whole tables."""

import os

import __spark_entry__ as entry
import duckdb
import pytest

NAMES = ["alias", "filter_ge", "join_right", "agg_count", "agg_avg_nulls", "group_null", "sort_nulls", "sort_expr", "sort_hidden", "except"]


@pytest.mark.parametrize("name", NAMES)
def test_result_or_its_count_grows_with_the_tables(name):
    def judged(d):
        con = duckdb.connect()
        for f in os.listdir(d):
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
        rows = con.sql(entry.oracle_sql()[name]).fetchall()
        if name in ("agg_count", "agg_avg_nulls"):
            return rows[0][0]
        return sum(r[1] for r in rows if r[0]) if name == "group_null" else sum(r[1] is not None for r in rows) if name in ("join_right", "sort_nulls") else len(rows)

    small, large = (judged(f"/root/testdata/sf{s}") for s in (0.001, 0.01))
    assert large > 5 * small > 0
