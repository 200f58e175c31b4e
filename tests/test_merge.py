"""Partial results merge as SQL says: hand-made partials, slices, edge cases."""

import pytest
from pyspark.sql import functions as F

from orrery.plans.merge import Agg, aggregate, combine, concat, merge, partials, pass_through
from orrery.plans.slicing import bounds, clamp, predicate, profile, slice_frames, slice_of
from orrery.sources.catalog import FactTable


def parts(spark, agg, schema, *data):
    """Partial rows as one slice would give them: the aggregate's value first."""
    return [spark.createDataFrame(d, schema) for d in data]


def test_sum_by_keys(spark):
    agg = Agg("sum", "a", "sum_a")
    one = parts(spark, agg, "_sum_a_value long, b int", [(5, 1), (2, 2), (3, 3)], [(1, 2), (1, 3), (3, 4)])
    assert sorted(map(tuple, combine(one, ["b"], [agg]).collect())) == [(1, 5), (2, 3), (3, 4), (4, 3)]
    text = parts(spark, agg, "_sum_a_value long, b string", [(5, "g1"), (2, "g2")], [(1, "g2"), (3, None), (4, None)])
    assert sorted(map(tuple, combine(text, ["b"], [agg]).collect()), key=str) == [("g1", 5), ("g2", 3), (None, 7)]
    two = parts(spark, agg, "_sum_a_value long, b int, c int", [(5, 1, 1), (2, 1, 2), (3, 2, 2)], [(2, 1, 1), (3, 2, 2), (4, 3, 1)])
    assert list(map(tuple, combine(two, ["b", "c"], [agg], [F.asc("b"), F.desc("c")]).collect())) == [(1, 2, 2), (1, 1, 7), (2, 2, 6), (3, 1, 4)]


def test_hidden_keys_stay_groups(spark):
    agg = Agg("sum", "a", "s")
    df = spark.createDataFrame([(5, 1), (6, 2), (7, 3), (8, 4)], "_s_value long, b int")
    assert sorted(r.s for r in merge(df, ["b"], [agg]).select("s").collect()) == [5, 6, 7, 8]


def test_scalars(spark):
    frame = lambda values, kind="long": spark.createDataFrame([(v,) for v in values], f"_v_value {kind}")
    one = lambda kind, df: merge(df, [], [Agg(kind, "a", "v")]).first().v
    assert [one("sum", frame([5, 6])), one("min", frame([5, 6, 2])), one("max", frame([5, 6, 2])), one("count", frame([5, 6, 2]))] == [11, 2, 6, 13]
    assert one("max", frame([5.1, 6.4], "double")) == 6.4 and one("sum", frame([2**60, 1])) == 2**60 + 1
    assert one("max", frame(["a", "b"], "string")) == "b"
    assert one("sum", frame([])) is None and one("count", frame([])) == 0
    avg = spark.createDataFrame([(10.8, 2), (6.23, 1), (25.0, 10), (None, 0)], "_v_sum double, _v_count long")
    assert abs(one("avg", avg) - 3.2331) < 0.001


def test_order_limit_offset(spark):
    frame = lambda *v: [spark.createDataFrame([(x,) for x in v], "a int").coalesce(1)]
    got = lambda df: [r.a for r in df.collect()]
    assert got(combine(frame(1, 4, 3, 2), order=[F.asc("a")])) == [1, 2, 3, 4]
    assert got(combine(frame(1, 2, 3, 4, 5), limit=3, offset=1)) == [2, 3, 4]
    assert got(combine(frame(1, 3, 5, 4, 2), order=[F.asc("a")], limit=3, offset=1)) == [2, 3, 4]
    assert got(combine(frame(1, 2), order=[F.asc("a")], limit=10)) == [1, 2]
    with pytest.raises(ValueError):
        pass_through(frame(1) + frame(2))
    assert got(pass_through(frame(7))) == [7] and concat(frame(1) + frame(1)).count() == 2


ROWS = [(k, k % 3 if k % 5 else None, k * 1.5, f"s{k % 4}") for k in range(-20, 80)] + [(None, 1, None, None), (None, None, 2.0, "x"), (500, 0, 1.0, "late")]
AGGS = [Agg("sum", "v", "s"), Agg("count", "v", "c"), Agg("count", "*", "n"), Agg("min", "t", "lo"), Agg("max", "t", "hi"), Agg("avg", "v", "mean"), Agg("count_distinct", "t", "d"), Agg("first", "v", "f", "struct(k, v)"), Agg("last", "v", "l", "struct(k, v)")]


@pytest.mark.parametrize("n", [1, 2, 10, 97])
def test_sliced_equals_unsliced(spark, n):
    df = spark.createDataFrame(ROWS, "k long, g int, v double, t string")
    df.createOrReplaceTempView("sliced_rows")
    fact = FactTable("sliced_rows", "k", -20, 79, len(ROWS))
    sql = "sum(v) s, count(v) c, count(*) n, min(t) lo, max(t) hi, avg(v) mean, count(distinct t) d, min_by(v, struct(k, v)) f, max_by(v, struct(k, v)) l FROM sliced_rows"
    for keys, text in (([], f"SELECT {sql}"), (["g"], f"SELECT g, {sql} GROUP BY g")):
        got, want = aggregate(df, fact, n, keys, AGGS), spark.sql(text)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert partials(df, fact, n, [], AGGS[2:3]).agg(F.sum("_n_value")).first()[0] == len(ROWS)
    assert [x.count() for x in slice_frames(df, fact, n)] == [df.filter(slice_of(F.col("k"), fact, n) == i).count() for i in range(clamp(fact, n))]
    assert profile(spark, df, fact, n).agg(F.sum("rows")).first()[0] == len(ROWS)


def test_slice_arithmetic():
    f = FactTable("t", "k", 0, 600_000_000, 600_000_000)
    assert len(bounds(f, 1000)) == 1000 and bounds(f, 1000)[1] == (1, 600_000, 1_200_000) and f.shards() == 600
    small = FactTable("t", "k", 3, 5, 2)
    assert clamp(small, 10) == 2 and bounds(small, 10) == [(0, 3, 4), (1, 4, 5)] and small.shards() == 1
    assert bounds(FactTable("t", "k", 7, 7), 5) == [(0, 7, 7)]
    assert predicate(FactTable("t", "k", 0, 100), 0, 4) == "(k <= 25 OR k IS NULL)" and predicate(FactTable("t", "k", 0, 100), 3, 4) == "k > 75"
    assert predicate(small, 0, 1) == "TRUE"


def test_aggregates_are_checked():
    for bad in (("median", "a", "m"), ("first", "a", "m")):
        with pytest.raises(ValueError):
            Agg(*bad)
