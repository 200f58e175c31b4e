"""One query per operator, as SQL that Spark and an independent engine both run.

Decimals are summed exactly and cast at the end; orders are total and say where
nulls go, so that results don't depend on the engine.
"""

from __future__ import annotations

PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"

SQL = {
    # projection, filter, predicate
    "proj": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
    "proj_star": "SELECT * FROM nation",
    "proj_table_star": "SELECT n.*, r_name FROM nation n JOIN region ON n_regionkey = r_regionkey",
    "alias": "SELECT c_custkey AS id, c_name AS title FROM customer AS c",
    "arith": f"SELECT l_returnflag, CAST(SUM({PRICE} * CAST(l_linenumber AS DECIMAL(3,0)) - CAST(l_quantity AS DECIMAL(4,0))) AS DOUBLE) AS v FROM lineitem GROUP BY l_returnflag",
    "filter_eq": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7",
    "filter_lt": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 3 AND l_orderkey > 500",
    "filter_ge": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 48",
    "filter_between_num": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12",
    "filter_between_str": "SELECT p_partkey, p_brand FROM part WHERE p_brand BETWEEN 'Brand#12' AND 'Brand#2'",
    "filter_between_date": "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-02-01'",
    "filter_and_or": "SELECT n_nationkey FROM nation WHERE (n_regionkey = 1 OR n_regionkey = 3) AND NOT (n_nationkey = 6)",
    "filter_in": "SELECT n_name FROM nation WHERE n_regionkey IN (0, 2)",
    "filter_like": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%7%1'",
    "filter_isnull": "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' WHERE o_orderkey IS NULL AND c_acctbal IS NOT NULL",
    "filter_case": "SELECT l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'mid' ELSE 'high' END AS band, COUNT(*) AS n FROM lineitem GROUP BY 1, 2",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15",
    # joins
    "join_comma2": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_comma4": f"SELECT r_name, CAST(SUM({PRICE}) AS DOUBLE) AS price FROM lineitem, supplier, nation, region WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY r_name",
    "join_comma5": "SELECT n_name, COUNT(*) AS n FROM lineitem, orders, customer, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name",
    "join_on": "SELECT c_mktsegment, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "join_derived": "SELECT s_name, t.n FROM supplier JOIN (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey) AS t ON s_suppkey = t.l_suppkey",
    "join_nested": "SELECT c_name, n_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey WHERE r_name = 'EUROPE'",
    "join_fact_fact": "SELECT a.l_returnflag, COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_returnflag",
    "join_left": "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY c_custkey",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F'",
    "join_full": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a FULL OUTER JOIN nation b ON a.n_nationkey = b.n_nationkey + 3",
    "join_semi": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
    "join_anti": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)",
    "join_cross": "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b",
    "join_natural": "SELECT r_regionkey, r_name FROM region NATURAL JOIN (SELECT r_regionkey FROM region WHERE r_regionkey > 1) q",
    "join_theta": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    # aggregates
    "agg_sum": f"SELECT l_linestatus, CAST(SUM({PRICE}) AS DOUBLE) AS s FROM lineitem GROUP BY l_linestatus",
    "agg_count": "SELECT COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "agg_count_star": "SELECT COUNT(*) AS n FROM lineitem",
    "agg_min": "SELECT MIN(l_quantity) AS a, MIN(l_returnflag) AS b, MIN(CAST(l_shipdate AS DATE)) AS c FROM lineitem",
    "agg_max": "SELECT MAX(l_quantity) AS a, MAX(l_returnflag) AS b, MAX(CAST(l_shipdate AS DATE)) AS c FROM lineitem",
    "agg_avg": "SELECT l_returnflag, AVG(CAST(l_linenumber AS DOUBLE)) AS a FROM lineitem GROUP BY l_returnflag",
    "agg_avg_nulls": "SELECT CAST(SUM(o_orderkey) AS DOUBLE) / COUNT(o_orderkey) AS mean FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "agg_count_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_sum_distinct": "SELECT CAST(SUM(DISTINCT p_size) AS BIGINT) AS s FROM part",
    "agg_expr": f"SELECT l_returnflag, CAST(SUM({PRICE}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS mean, COUNT(*) + 1 AS more FROM lineitem GROUP BY l_returnflag",
    "group_one": "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority",
    "group_multi": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "group_varchar": "SELECT c_mktsegment, MIN(c_custkey) AS a FROM customer GROUP BY c_mktsegment",
    "group_null": "SELECT o_orderstatus, COUNT(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY o_orderstatus",
    "group_hidden": "SELECT COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_no_agg": "SELECT l_linenumber FROM lineitem GROUP BY l_linenumber",
    "group_null_value": "SELECT c_mktsegment, MAX(o_orderkey) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey < 0 GROUP BY c_mktsegment",
    "scalar_empty": "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s, COUNT(*) AS n, MIN(l_quantity) AS m FROM lineitem WHERE l_orderkey < -1",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "rollup": "SELECT n_regionkey, n_nationkey, COUNT(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)",
    "cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "median": "SELECT l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag",
    # sort, limit
    "sort_multi": "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus, o_orderkey DESC",
    "sort_nulls": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' ORDER BY o_orderkey ASC NULLS LAST, c_custkey",
    "sort_expr": "SELECT p_partkey FROM part ORDER BY p_size * -1, 1",
    "sort_hidden": "SELECT c_name FROM customer ORDER BY c_custkey DESC",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5",
    "limit_beyond": "SELECT r_name FROM region ORDER BY r_name LIMIT 100 OFFSET 2",
    "offset_only": "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20",
    "topk": f"SELECT l_orderkey, CAST(SUM({PRICE}) AS DOUBLE) AS s FROM lineitem GROUP BY l_orderkey ORDER BY s DESC, l_orderkey LIMIT 10",
    # set operators
    "union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
    # functions
    "substring": "SELECT substring(c_name, 1, 12) AS p, COUNT(*) AS n FROM customer GROUP BY substring(c_name, 1, 12)",
    "math": "SELECT p_partkey, p_size * 2 - 1 AS a, p_size % 7 AS b, CAST(floor(p_size / 3.0) AS INT) AS c FROM part",
    "date_compare": "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1996-06-30' AND CAST(o_orderdate AS DATE) < DATE '1998-01-01' GROUP BY o_orderstatus",
    "scalar_top": "SELECT upper(r_name) AS u, lower(r_name) AS l, CAST(length(r_name) AS INT) AS n, concat(r_name, '!') AS c FROM region",
    # sub-queries
    "subq_from": "SELECT t.p, COUNT(*) AS n FROM (SELECT substring(n_name, 1, 8) AS p FROM nation) AS t GROUP BY t.p",
    "subq_in": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "subq_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "subq_scalar": "SELECT p_partkey FROM part WHERE p_size = (SELECT MAX(p_size) FROM part)",
    "subq_correlated": "SELECT o_custkey, o_orderkey FROM orders a WHERE o_orderkey = (SELECT MAX(b.o_orderkey) FROM orders b WHERE b.o_custkey = a.o_custkey)",
    "cte": "WITH t AS (SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey) SELECT r_name, n FROM t JOIN region ON k = r_regionkey",
    "window_rank": "SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS rn FROM customer",
}

#: Where the engines' functions have different names: (Spark, oracle).
TWO = {
    "agg_first": ("SELECT l_orderkey, min_by(l_quantity, struct(l_linenumber, l_partkey, l_suppkey, l_quantity)) AS v FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, arg_min(l_quantity, row(l_linenumber, l_partkey, l_suppkey, l_quantity)) AS v FROM lineitem GROUP BY l_orderkey"),
    "agg_last": ("SELECT l_orderkey, max_by(l_quantity, struct(l_linenumber, l_partkey, l_suppkey, l_quantity)) AS v FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, arg_max(l_quantity, row(l_linenumber, l_partkey, l_suppkey, l_quantity)) AS v FROM lineitem GROUP BY l_orderkey"),
}
