"""What a query's text says: tables, roles of its output, whether it sorts or limits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Nodes at the top of a parsed plan that only read. Fixed values of the parser.
READS = {
    "Project", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Filter", "Join", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedHaving", "UnresolvedRelation",
    "UnresolvedWith", "UnresolvedInlineTable", "WithWindowDefinition", "OneRowRelation", "Generate", "UnresolvedSubqueryColumnAliases", "ResolvedInlineTable", "LocalRelation", "UnresolvedHint", "NameParameterizedQuery", "PosParameterizedQuery",
}
AGGREGATES = ("sum", "count", "min", "max", "avg", "first", "last")


@dataclass
class QueryInfo:
    tables: list[str] = field(default_factory=list)
    group_keys: list[str] = field(default_factory=list)
    aggregates: list[str] = field(default_factory=list)
    needs_sorting: bool = False
    needs_limiting: bool = False
    distinct: bool = False


class NotAQuery(ValueError):
    """The statement does more than read."""


def items(seq) -> list:
    """A list of a Scala sequence."""
    return [seq.apply(i) for i in range(seq.size())]


def parse(spark: SparkSession, sql: str):
    """The unresolved plan.  The one place that uses the session's private handle."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))


def inspect(spark: SparkSession, sql: str) -> QueryInfo:
    plan = parse(spark, sql)
    if plan.nodeName() not in READS:
        raise NotAQuery(f"only queries are accepted, not {plan.nodeName()}")
    info, todo, top = QueryInfo(), [plan], True
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "UnresolvedRelation":
            table = node.multipartIdentifier().mkString(".").lower().rpartition(".")[2]
            if table not in info.tables:
                info.tables.append(table)
        if top:
            info.needs_sorting |= name == "Sort"
            info.needs_limiting |= name in ("GlobalLimit", "LocalLimit", "Offset")
            info.distinct |= name == "Distinct"
            if name in ("Aggregate", "Project"):
                top = False
                if name == "Aggregate":
                    info.group_keys = [x.sql() for x in items(node.groupingExpressions())]
                outputs = node.aggregateExpressions() if name == "Aggregate" else node.projectList()
                for text in (x.toString().lower().lstrip("'") for x in items(outputs)):
                    if text.partition("(")[0] in AGGREGATES:
                        info.aggregates.append(text)
        children = items(node.children())
        if name == "UnresolvedWith":
            children += [x._2() for x in items(node.cteRelations())] if hasattr(items(node.cteRelations())[0], "_2") else []
        todo += reversed(children)
    info.tables.sort()
    return info
