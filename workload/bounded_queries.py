"""Bounded execution (X1-X5): audited SELECT statements over the given tables."""

from __future__ import annotations

from catalink.operators import bounded
from workload.inputs import table

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

TOP_K = """
    SELECT p.p_name, count(*) AS order_count
    FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey
    JOIN customer c ON c.c_custkey = o.o_custkey
    GROUP BY p.p_name ORDER BY order_count DESC, p.p_name LIMIT 5"""

JOIN_FILTER = """
    SELECT n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total
    FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey
    JOIN orders o ON o.o_custkey = c.c_custkey
    WHERE o.o_orderstatus = 'F' AND c.c_acctbal > 0 AND o.o_totalprice > 1000
    GROUP BY n.n_name"""

GROUP_SUM = """
    SELECT l_returnflag, l_linestatus, count(*) AS line_count, sum(l_quantity) AS quantity,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem GROUP BY l_returnflag, l_linestatus"""

UNION = """
    SELECT 'status' AS kind, o_orderstatus AS value, count(*) AS orders FROM orders GROUP BY o_orderstatus
    UNION SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority"""

WINDOW = """
    SELECT n_name, c_name, place FROM (
        SELECT n.n_name, c.c_name, row_number() OVER (PARTITION BY n.n_nationkey ORDER BY c.c_acctbal DESC, c.c_custkey) AS place
        FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey) ranked
    WHERE place <= 3"""

SUBQUERY = """
    WITH busy AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT c_mktsegment, count(*) AS customers FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM busy WHERE n > (SELECT avg(n) FROM busy)) GROUP BY c_mktsegment"""

BOUNDED = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000000;"


def _query(sql: str, max_rows: int | None = None):
    def run(spark, sf):
        return bounded.run(spark, sql, {n: table(spark, sf, n) for n in NAMES}, max_rows).rows

    return run


QUERIES = {
    "golden_top_k_count": _query(TOP_K),
    "golden_join_filter": _query(JOIN_FILTER),
    "golden_group_sum": _query(GROUP_SUM),
    "golden_union": _query(UNION),
    "golden_window": _query(WINDOW),
    "golden_subquery": _query(SUBQUERY),
    "bounded_query": _query(BOUNDED),
}

ORACLES = {
    "golden_top_k_count": TOP_K,
    "golden_join_filter": JOIN_FILTER,
    "golden_group_sum": GROUP_SUM,
    "golden_union": UNION,
    "golden_window": WINDOW.replace("row_number()", "CAST(row_number()").replace(") AS place\n", ") AS INTEGER) AS place\n"),
    "golden_subquery": SUBQUERY,
    "bounded_query": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
}
