"""Partial aggregates per slice and how they recombine exactly.

Catalyst does the same inside any aggregate; here the partial results are
DataFrames that can be looked at, placed and merged explicitly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans.slicing import sliced
from orrery.sources.catalog import FactTable


@dataclass(frozen=True)
class Agg:
    """sum, count, min, max, avg, first, last (by ``order``) or count_distinct of an SQL expression (``*`` to count rows)."""

    kind: str
    expr: str
    alias: str
    order: str | None = None

    def __post_init__(self):
        if self.kind not in MERGES:
            raise ValueError(f"no such aggregate: {self.kind}")
        if self.kind in ("first", "last") and not self.order:
            raise ValueError(f"{self.kind} needs an order")

    @property
    def value(self) -> Column:
        return F.lit(1) if self.expr == "*" else F.expr(self.expr)

    def part(self, name: str) -> str:
        return f"_{self.alias}_{name}"

    def partial(self) -> list[Column]:
        x, o = self.value, F.expr(self.order) if self.order else None
        if self.kind == "avg":
            return [F.sum(x).alias(self.part("sum")), F.count(x).alias(self.part("count"))]
        if self.kind in ("first", "last"):
            by, end = (F.min_by, F.min) if self.kind == "first" else (F.max_by, F.max)
            return [by(x, o).alias(self.part("value")), end(F.when(o.isNotNull(), o)).alias(self.part("order"))]
        return [getattr(F, self.kind)(x).alias(self.part("value"))]

    def merged(self) -> Column:
        p = lambda n: F.col(self.part(n))
        if self.kind == "avg":
            return (F.sum(p("sum")) / F.nullif(F.sum(p("count")), F.lit(0))).cast("double").alias(self.alias)
        if self.kind in ("first", "last"):
            return (F.min_by if self.kind == "first" else F.max_by)(p("value"), p("order")).alias(self.alias)
        if self.kind == "count":
            return F.coalesce(F.sum(p("value")), F.lit(0)).alias(self.alias)
        return getattr(F, self.kind)(p("value")).alias(self.alias)


MERGES = ("sum", "count", "min", "max", "avg", "first", "last", "count_distinct")


def partials(df: DataFrame, fact: FactTable, n: int, keys: list[str], aggs: list[Agg]) -> DataFrame:
    """One row per slice and group."""
    return sliced(df, fact, n, "_slice").groupBy("_slice", *keys).agg(*(c for a in aggs for c in a.partial()))


def merge(parts: DataFrame, keys: list[str], aggs: list[Agg]) -> DataFrame:
    """Partial rows of any origin to one row per group; null keys are a group; a global aggregate has one row."""
    return parts.groupBy(*keys).agg(*(a.merged() for a in aggs))


def aggregate(df: DataFrame, fact: FactTable, n: int, keys: list[str], aggs: list[Agg]) -> DataFrame:
    """The whole aggregate from one scan: partial rows by slice, or by distinct value where values are counted, as those merge and their counts don't."""
    values = {a: f"_{a.alias}_distinct" for a in aggs if a.kind == "count_distinct"}
    plain = [a for a in aggs if a not in values]
    if not values:
        return merge(partials(df, fact, n, keys, plain), keys, plain).select(*keys, *(a.alias for a in aggs))
    rows = df.withColumns({c: a.value for a, c in values.items()})
    parts = rows.groupBy(*keys, *values.values()).agg(*(c for a in plain for c in a.partial()), F.count("*").alias("_rows"))
    once = F.count if len(values) == 1 else F.count_distinct  # one value a row already
    return parts.groupBy(*keys).agg(*(once(F.col(values[a])).alias(a.alias) if a in values else a.merged() for a in aggs)).select(*keys, *(a.alias for a in aggs))


def concat(parts: list[DataFrame]) -> DataFrame:
    """Bag union by position with the first part's schema."""
    if not parts:
        raise ValueError("nothing to concatenate")
    return reduce(DataFrame.unionAll, parts)


def pass_through(parts: list[DataFrame]) -> DataFrame:
    if len(parts) != 1:
        raise ValueError(f"exactly one result is expected, not {len(parts)}")
    return parts[0]


def combine(parts: list[DataFrame], keys: list[str] | None = None, aggs: list[Agg] | None = None, order: list[Column] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Aggregate or concatenate, then sort, then cut: what is there if the limit reaches further."""
    out = merge(concat(parts), keys or [], aggs) if aggs else concat(parts)
    if order:
        out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)
