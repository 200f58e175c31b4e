"""The star-schema and web-log tables as SQL over the base tables, for an oracle; Spark's own derivation is in ``star``."""

from __future__ import annotations

import re

VIEWS = {
    "lineorder": """SELECT l.l_orderkey AS lo_orderkey, l.l_linenumber AS lo_linenumber, o.o_custkey AS lo_custkey, l.l_partkey AS lo_partkey,
 l.l_suppkey AS lo_suppkey, CAST(year(o.o_orderdate)*10000+month(o.o_orderdate)*100+day(o.o_orderdate) AS INT) AS lo_orderdate,
 l.l_quantity AS lo_quantity, CAST(l.l_extendedprice AS DECIMAL(12,2)) AS lo_extendedprice, CAST(round(l.l_discount*100) AS INT) AS lo_discount,
 CAST(l.l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l.l_discount AS DECIMAL(4,2))) AS lo_revenue, CAST(p.p_retailprice AS DECIMAL(12,2)) * CAST(0.6 AS DECIMAL(2,1)) AS lo_supplycost
 FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN part p ON l.l_partkey=p.p_partkey""",
    "dwdate": """SELECT DISTINCT CAST(year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) AS INT) AS d_datekey, CAST(year(o_orderdate) AS INT) AS d_year,
 CAST(year(o_orderdate)*100+month(o_orderdate) AS INT) AS d_yearmonthnum, concat(substring('JanFebMarAprMayJunJulAugSepOctNovDec', month(o_orderdate)*3-2, 3), CAST(year(o_orderdate) AS VARCHAR)) AS d_yearmonth, CAST(weekofyear(o_orderdate) AS INT) AS d_weeknuminyear FROM orders""",
    "s_customer": """SELECT c_custkey, n_name AS c_nation, r_name AS c_region, concat(n_name,'#',CAST(c_custkey%10 AS VARCHAR(2))) AS c_city
 FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "s_supplier": """SELECT s_suppkey, n_name AS s_nation, r_name AS s_region, concat(n_name,'#',CAST(s_suppkey%10 AS VARCHAR(2))) AS s_city
 FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "s_part": """SELECT p_partkey, concat('MFGR#',CAST(CAST(floor((bn-1)/5.0) AS INT)+1 AS VARCHAR(2))) AS p_mfgr,
 concat('MFGR#',CAST(CAST(floor((bn-1)/5.0) AS INT)+1 AS VARCHAR(2)),CAST((bn-1)%5+1 AS VARCHAR(2))) AS p_category,
 concat('MFGR#',CAST(CAST(floor((bn-1)/5.0) AS INT)+1 AS VARCHAR(2)),CAST((bn-1)%5+1 AS VARCHAR(2)),lpad(CAST(p_size AS VARCHAR(2)),2,'0')) AS p_brand1
 FROM (SELECT p_partkey, p_size, CAST(substring(p_brand,7) AS INT) AS bn FROM part) x""",
    "rankings": "SELECT p_partkey AS pageURL, p_size AS pageRank FROM part",
    "uservisits": """SELECT c_name AS sourceIP, l_partkey AS destURL, CAST(l_extendedprice AS DECIMAL(12,2)) AS adRevenue, CAST(l_shipdate AS DATE) AS visitDate
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey""",
}


def inlined(sql: str) -> str:
    """The query with the views that it names as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    inner = re.sub(r"^\s*WITH\s", "", sql, flags=re.I)
    head = "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    return f"{head},\n{inner}" if inner != sql else f"{head}\n{sql}"
