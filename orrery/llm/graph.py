"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.store import Table, gathered


def _least(pairs: DataFrame) -> DataFrame:
    """For each u of (u, v): its least neighbour m, joined to every pair.  The join may split a hot u."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (two integer columns); component: the least node reachable.

    Each round links nodes to smaller ones only; the number of rounds is
    logarithmic in practice.  Rounds end in written tables, so lineage stays short.
    An edge from a node to itself counts as a node alone; rows with nulls are ignored.
    """
    a, b = edges.columns
    plain = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna()
    nodes = Table(gathered(plain.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), "edges")
    now, state = nodes, None
    while True:
        links = now.frame().filter("u != v")
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        near = _least(large)
        small = near.select("u", F.col("m").alias("v")).union(near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = Table(gathered(small), "edges")
        got = after.frame().agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now is not nodes:
            now.drop()
        now = after
        if tuple(got) == state or not got[0]:
            break
        state = tuple(got)
    found = now.frame().select(F.col("u").alias("node"), F.col("v").alias("component"))
    every = nodes.frame().select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return every.join(found.groupBy("node").agg(F.min("component").alias("component")), "node", "left").select("node", F.least("node", F.coalesce("component", "node")).alias("component"))
