"""Statements that are analysed and then run, so what the analysis claims is held against real rows.

Each text is analysed as the source of an INSERT, and the result of running it gets its column names from
the analysis.  The same text runs in DuckDB, which names and counts the columns itself, so a wrong, missing
or additional column shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.plans import scopes as plan

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

SQL = {
    "exec_join_aggregate": """SELECT c.c_mktsegment, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_mktsegment""",
    "exec_join_outer": """SELECT n.n_name, r.r_name, count(s.s_suppkey) AS n_suppliers FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name, r.r_name""",
    "exec_semi_anti": """SELECT c_mktsegment, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000) AND c.c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY c_mktsegment""",
    "exec_window_rank": """SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rn FROM orders) t WHERE rn <= 2""",
    "exec_window_frame": """SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n_recent, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders""",
    "exec_rollup": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "exec_cube": """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "exec_setops": """SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation EXCEPT SELECT r_regionkey FROM region""",
    "exec_union_distinct": """SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""",
    "exec_case_aggregate": """SELECT l_returnflag, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_discounted, count(DISTINCT l_suppkey) AS n_suppliers, max(l_shipdate) AS last_shipped FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10""",
    "exec_cte_chain": """WITH big AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150), named AS (SELECT o.o_custkey, b.q FROM big b JOIN orders o ON o.o_orderkey = b.l_orderkey) SELECT c.c_name, count(*) AS n, round(sum(n.q), 2) AS q FROM named n JOIN customer c ON c.c_custkey = n.o_custkey GROUP BY c.c_name""",
    "exec_scalar_subquery": """SELECT p_brand, count(*) AS n FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) GROUP BY p_brand""",
    "exec_range_join": """SELECT a.n_name AS name, count(*) AS n FROM nation a JOIN nation b ON b.n_nationkey BETWEEN a.n_nationkey AND a.n_nationkey + 3 GROUP BY a.n_name""",
    "exec_values": """SELECT v.a, v.b FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, b)""",
    "exec_topk": """SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10""",
}


def analysed_names(known: dict[str, list[str]], name: str, text: str) -> list[str]:
    """The result columns of a text by its analysis, with the columns of the tables."""
    record = plan.facts(name, f"INSERT INTO run.{name} {text}", known.get)[0]
    if record["status"] != "ok":
        raise ValueError(f"{name}: {record['error']}")
    return [c["name"] for s in record["scopes"] if s["scope_id"] == "ROOT" for c in s["columns"]]


def _run(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = SPARK.get(name, SQL[name])
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
        for t, df in tables.items():
            df.createOrReplaceTempView(t)
        return spark.sql(text).toDF(*analysed_names({t: df.columns for t, df in tables.items()}, name, text))

    return run


SPARK = {"exec_explode": "SELECT doc_id, count(*) AS n_parts FROM (SELECT doc_id, explode(split(source, '_')) AS part FROM documents) t GROUP BY doc_id"}
SQL["exec_explode"] = "SELECT doc_id, count(*) AS n_parts FROM (SELECT doc_id, unnest(string_split(source, '_')) AS part FROM documents) t GROUP BY doc_id"
QUERIES = {name: _run(name) for name in SQL}
