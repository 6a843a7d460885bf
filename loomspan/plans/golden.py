"""Statements with facts worked out by hand from the rules, over the test tables' schemas.

Each query analyses the whole set; its oracle is a VALUES list that was written down, not computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import impact, insight, lineage
from loomspan.sources.readers import parquet_schemas

STATEMENTS = {
    "g01": "INSERT OVERWRITE mart.x WITH big AS (SELECT o_custkey, o_totalprice FROM orders o WHERE o_totalprice > 1000) "
    "SELECT c.c_name, sum(b.o_totalprice) AS total FROM big b JOIN customer c ON b.o_custkey = c.c_custkey GROUP BY c.c_name",
    "g02": "INSERT INTO mart.u SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "g03": "INSERT INTO mart.s SELECT * FROM region",
    "g04": "INSERT INTO mart.m WITH base AS (SELECT * FROM ods.src), pick AS (SELECT b.id, b.v FROM base b) SELECT p.id FROM pick p",
    "g05": "MERGE INTO mart.t USING (SELECT s_suppkey AS id, s_name AS name FROM supplier) s ON t.id = s.id "
    "WHEN MATCHED THEN UPDATE SET t.name = s.name WHEN NOT MATCHED THEN INSERT (id, name, flag) VALUES (s.id, s.name, 'n')",
    "g06": "INSERT INTO mart.l SELECT e.event_id, w.word FROM events e LATERAL VIEW explode(split(e.props, ',')) w AS word",
    "g07": "INSERT INTO mart.w SELECT o_orderkey, CASE WHEN o_totalprice > 5000 THEN 'big' ELSE 'small' END AS size_class, "
    "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rn FROM orders",
    "g08": "INSERT INTO mart.k SELECT 5 AS five, current_date AS d, count(*) AS n, concat('a', 'b') AS ab FROM region",
    "g09": "INSERT INTO mart.d SELECT x.p_name, x.s_name FROM part x JOIN supplier x ON x.p_partkey = x.s_suppkey",
    "g10": "INSERT INTO mart.v SELECT v.a, v.b FROM (VALUES (1, 'x')) AS v(a, b)",
    "g11": "INSERT INTO mart.e SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "g12": "INSERT INTO mart.a1 SELECT r_name FROM region; INSERT INTO mart.a2 SELECT r_name FROM WHERE; INSERT INTO mart.a3 PARTITION (dt = '2025-01-01') SELECT n.n_name FROM nation n",
    "g13": "INSERT INTO mart.f SELECT t.payload.kind AS kind FROM ods.raw t",
    "g14": "INSERT INTO mart.q SELECT c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "g15": "INSERT INTO mart.i SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region",
    "g16": "INSERT INTO mart.j SELECT c.c_name FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = spark.createDataFrame(list(STATEMENTS.items()), "task_name string, sql string")
    return lineage.analyze(tasks, parquet_schemas(spark, sf_dir, TABLES))


def values(columns: str, rows: str) -> str:
    return f"SELECT * FROM (VALUES {rows.strip()}) AS t({columns})"


def _on(f):
    return lambda s, d: f(analysed(s, d))


QUERIES = {
    "e2e_lineage": _on(lambda a: lineage.end_to_end(a).select("stmt", "name", F.coalesce("merge_branch", F.lit("")).alias("merge_branch"), F.coalesce("source_table", F.lit("")).alias("source_table"), F.coalesce("source_column", F.lit("")).alias("source_column"), F.coalesce("transform", F.lit("")).alias("transform"), "complete", "reasons")),
    "scope_graph": _on(lambda a: lineage.graph_edges(a).select("stmt", "from_node", "to_node")),
    "scope_roles": _on(lambda a: lineage.scope_facts(a).select("stmt", "scope_id", "kind", "role", "depth", F.coalesce("set_op", F.lit("")).alias("set_op"))),
    "join_facts": _on(lambda a: lineage.join_facts(a).select("stmt", "scope_id", "join_type", "left_scope", "right_scope", "condition_columns")),
    "filter_facts": _on(lambda a: lineage.filter_facts(a).select("stmt", "scope_id", "clause", "expression", "columns")),
    "group_facts": _on(lambda a: lineage.grouping_facts(a).select("stmt", "scope_id", "from_scope", "from_column")),
    "window_facts": _on(lambda a: lineage.window_facts(a).select("stmt", "scope_id", "name", "function", "partition_by", "order_by")),
    "case_branches": _on(lambda a: lineage.case_facts(a).select("stmt", "name", "branch_no", "when_expr", "then_value")),
    "union_alignment": _on(lambda a: lineage.edge_facts(a).where("transform = 'UNION'").select("stmt", "to_scope", "to_column", "from_scope", "from_column")),
    "column_sources": _on(lambda a: lineage.edge_facts(a).select("stmt", "to_scope", "to_column", "from_scope", "from_column", "transform")),
    "merge_columns": _on(lambda a: lineage.edge_facts(a).where("merge_branch is not null").select("stmt", "to_column", "merge_branch", "from_scope", "from_column", "transform")),
    "lateral_view_facts": _on(lambda a: lineage.generator_facts(a).select("stmt", "scope_id", "function", "output_columns")),
    "trace_leaves": _on(lambda a: impact.traces(a, "ROOT").drop("scope_id")),
    "multi_statement": _on(lambda a: lineage.statements(a).select("stmt", "status", F.coalesce("target_table", F.lit("")).alias("target_table"), F.concat_ws(",", "partition_columns").alias("partition_columns"))),
    "warnings_by_type": _on(lambda a: lineage.warning_facts(a).groupBy("stmt", "type").agg(F.count("*").alias("n"))),
    "dangling_scopes": _on(lambda a: insight.dangling_scopes(a).select("stmt", "scope_id", "is_subquery_of")),
    "column_usage_metadata": lambda s, d: lineage.input_metadata(analysed(s, d), parquet_schemas(s, d, TABLES)).select("stmt", "table_name", "column_name", "metadata_complete"),
    "output_metadata": lambda s, d: lineage.output_metadata(analysed(s, d), parquet_schemas(s, d, TABLES)).select("stmt", "column_name", "ordinal", "metadata_complete"),
    "scope_stats": _on(lambda a: lineage.stats(a).drop("task_id", "stmt_no")),
}

SQL = {
    "e2e_lineage": values(
        "stmt, name, merge_branch, source_table, source_column, transform, complete, reasons",
        """
('g01', 'c_name', '', 'customer', 'c_name', 'DIRECT', true, ''), ('g01', 'total', '', 'orders', 'o_totalprice', 'AGGREGATE', true, ''),
('g02', 'name', '', 'nation', 'n_name', 'UNION', true, ''), ('g02', 'name', '', 'region', 'r_name', 'UNION', true, ''),
('g03', 'r_regionkey', '', 'region', 'r_regionkey', 'DIRECT', true, ''), ('g03', 'r_name', '', 'region', 'r_name', 'DIRECT', true, ''),
('g04', 'id', '', 'ods.src', 'id', 'DIRECT', true, ''),
('g05', 'name', 'matched', 'supplier', 's_name', 'DIRECT', true, ''), ('g05', 'id', 'not_matched', 'supplier', 's_suppkey', 'DIRECT', true, ''),
('g05', 'name', 'not_matched', 'supplier', 's_name', 'DIRECT', true, ''), ('g05', 'flag', 'not_matched', '', '', '', true, ''),
('g06', 'event_id', '', 'events', 'event_id', 'DIRECT', true, ''), ('g06', 'word', '', 'events', 'props', 'EXPRESSION', true, ''),
('g07', 'o_orderkey', '', 'orders', 'o_orderkey', 'DIRECT', true, ''), ('g07', 'size_class', '', 'orders', 'o_totalprice', 'CONDITIONAL', true, ''),
('g07', 'rn', '', 'orders', 'o_custkey', 'WINDOW', true, ''), ('g07', 'rn', '', 'orders', 'o_orderdate', 'WINDOW', true, ''),
('g08', 'five', '', '', '', '', true, ''), ('g08', 'd', '', '', '', '', true, ''), ('g08', 'n', '', 'region', '*', 'AGGREGATE', true, ''), ('g08', 'ab', '', '', '', '', true, ''),
('g09', 'p_name', '', 'part', 'p_name', 'DIRECT', true, ''), ('g09', 's_name', '', 'supplier', 's_name', 'DIRECT', true, ''),
('g10', 'a', '', '', '', '', true, ''), ('g10', 'b', '', '', '', '', true, ''),
('g11', 'c_custkey', '', 'customer', 'c_custkey', 'DIRECT', true, ''),
('g12#0', 'r_name', '', 'region', 'r_name', 'DIRECT', true, ''), ('g12#2', 'n_name', '', 'nation', 'n_name', 'DIRECT', true, ''),
('g13', 'kind', '', 'ods.raw', 'payload', 'DIRECT', true, ''),
('g14', 'c_name', '', 'customer', 'c_name', 'DIRECT', true, ''), ('g14', 'o_orderkey', '', 'orders', 'o_orderkey', 'DIRECT', true, ''),
('g15', 'k', '', 'nation', 'n_nationkey', 'UNION', true, ''), ('g15', 'k', '', 'region', 'r_regionkey', 'UNION', true, ''),
('g16', 'c_name', '', 'customer', 'c_name', 'DIRECT', true, '')
""",
    ),
    "scope_graph": values(
        "stmt, from_node, to_node",
        """
('g01', 'orders', 'cte:big'), ('g01', 'cte:big', 'ROOT'), ('g01', 'customer', 'ROOT'),
('g02', 'nation', 'union:main:b01'), ('g02', 'region', 'union:main:b02'), ('g02', 'union:main:b01', 'union:main'), ('g02', 'union:main:b02', 'union:main'), ('g02', 'union:main', 'ROOT'),
('g03', 'region', 'ROOT'), ('g04', 'ods.src', 'cte:base'), ('g04', 'cte:base', 'cte:pick'), ('g04', 'cte:pick', 'ROOT'),
('g05', 'supplier', 'subq:s'), ('g05', 'subq:s', 'ROOT'), ('g06', 'events', 'udtf:w'), ('g06', 'events', 'ROOT'), ('g06', 'udtf:w', 'ROOT'),
('g07', 'orders', 'ROOT'), ('g08', 'region', 'ROOT'), ('g09', 'part', 'ROOT'), ('g09', 'supplier', 'ROOT'), ('g10', 'udtf:v', 'ROOT'),
('g11', 'customer', 'ROOT'), ('g11', 'orders', 'subq:derived_0'), ('g11', 'customer', 'subq:derived_0'), ('g12#0', 'region', 'ROOT'), ('g12#2', 'nation', 'ROOT'),
('g13', 'ods.raw', 'ROOT'), ('g14', 'customer', 'ROOT'), ('g14', 'orders', 'ROOT'),
('g15', 'nation', 'union:main:b01'), ('g15', 'region', 'union:main:b02'), ('g15', 'union:main:b01', 'union:main'), ('g15', 'union:main:b02', 'union:main'), ('g15', 'union:main', 'ROOT'),
('g16', 'customer', 'ROOT'), ('g16', 'orders', 'ROOT')
""",
    ),
    "scope_roles": values(
        "stmt, scope_id, kind, role, depth, set_op",
        """
('g01', 'cte:big', 'cte', 'filter', 1, ''), ('g01', 'ROOT', 'root', 'aggregate', 2, ''),
('g02', 'union:main:b01', 'union_branch', 'union_branch', 1, ''), ('g02', 'union:main:b02', 'union_branch', 'union_branch', 1, ''), ('g02', 'union:main', 'union', 'union', 2, 'UNION_ALL'), ('g02', 'ROOT', 'root', 'transform', 3, ''),
('g03', 'ROOT', 'root', 'pass_through', 1, ''), ('g04', 'cte:base', 'cte', 'transform', 1, ''), ('g04', 'cte:pick', 'cte', 'pass_through', 2, ''), ('g04', 'ROOT', 'root', 'pass_through', 3, ''),
('g05', 'subq:s', 'subquery', 'pass_through', 1, ''), ('g05', 'ROOT', 'root', 'join', 2, ''), ('g06', 'udtf:w', 'subquery', 'transform', 1, ''), ('g06', 'ROOT', 'root', 'pass_through', 2, ''),
('g07', 'ROOT', 'root', 'dedup', 1, ''), ('g08', 'ROOT', 'root', 'aggregate', 1, ''), ('g09', 'ROOT', 'root', 'join', 1, ''), ('g10', 'udtf:v', 'subquery', 'label', 1, ''), ('g10', 'ROOT', 'root', 'pass_through', 2, ''),
('g11', 'subq:derived_0', 'subquery', 'filter', 1, ''), ('g11', 'ROOT', 'root', 'filter', 1, ''), ('g12#0', 'ROOT', 'root', 'pass_through', 1, ''), ('g12#2', 'ROOT', 'root', 'pass_through', 1, ''),
('g13', 'ROOT', 'root', 'pass_through', 1, ''), ('g14', 'ROOT', 'root', 'join', 1, ''),
('g15', 'union:main:b01', 'union_branch', 'union_branch', 1, ''), ('g15', 'union:main:b02', 'union_branch', 'union_branch', 1, ''), ('g15', 'union:main', 'union', 'union', 2, 'INTERSECT'), ('g15', 'ROOT', 'root', 'transform', 3, ''),
('g16', 'ROOT', 'root', 'join', 1, '')
""",
    ),
    "join_facts": values(
        "stmt, scope_id, join_type, left_scope, right_scope, condition_columns",
        """
('g01', 'ROOT', 'INNER', 'cte:big', 'customer', 'cte:big.o_custkey,customer.c_custkey'), ('g05', 'ROOT', 'MERGE', 'mart.t', 'subq:s', 'mart.t.id,subq:s.id'),
('g09', 'ROOT', 'INNER', 'part', 'supplier', 'part.p_partkey,supplier.s_suppkey'), ('g14', 'ROOT', 'LEFT_OUTER', 'customer', 'orders', 'customer.c_custkey,orders.o_custkey,orders.o_orderstatus'),
('g16', 'ROOT', 'LEFT_SEMI', 'customer', 'orders', 'customer.c_custkey,orders.o_custkey')
""",
    ),
    "filter_facts": values(
        "stmt, scope_id, clause, expression, columns",
        """
('g01', 'cte:big', 'WHERE', 'o_totalprice > 1000', 'orders.o_totalprice'), ('g11', 'subq:derived_0', 'WHERE', 'o.o_custkey = c.c_custkey', 'orders.o_custkey,customer.c_custkey'),
('g11', 'ROOT', 'WHERE', 'EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)', '')
""",
    ),
    "group_facts": values("stmt, scope_id, from_scope, from_column", "('g01', 'ROOT', 'customer', 'c_name')"),
    "window_facts": values("stmt, scope_id, name, function, partition_by, order_by", "('g07', 'ROOT', 'rn', 'ROW_NUMBER', 'orders.o_custkey', 'orders.o_orderdate DESC')"),
    "case_branches": values("stmt, name, branch_no, when_expr, then_value", "('g07', 'size_class', 0, 'o_totalprice > 5000', '''big'''), ('g07', 'size_class', 1, 'ELSE', '''small''')"),
    "union_alignment": values(
        "stmt, to_scope, to_column, from_scope, from_column",
        """
('g02', 'union:main', 'name', 'union:main:b01', 'name'), ('g02', 'union:main', 'name', 'union:main:b02', 'r_name'), ('g02', 'ROOT', 'name', 'union:main', 'name'),
('g15', 'union:main', 'k', 'union:main:b01', 'k'), ('g15', 'union:main', 'k', 'union:main:b02', 'r_regionkey'), ('g15', 'ROOT', 'k', 'union:main', 'k')
""",
    ),
    "column_sources": values(
        "stmt, to_scope, to_column, from_scope, from_column, transform",
        """
('g01', 'cte:big', 'o_custkey', 'orders', 'o_custkey', 'DIRECT'), ('g01', 'cte:big', 'o_totalprice', 'orders', 'o_totalprice', 'DIRECT'), ('g01', 'ROOT', 'c_name', 'customer', 'c_name', 'DIRECT'), ('g01', 'ROOT', 'total', 'cte:big', 'o_totalprice', 'AGGREGATE'),
('g02', 'union:main:b01', 'name', 'nation', 'n_name', 'DIRECT'), ('g02', 'union:main:b02', 'r_name', 'region', 'r_name', 'DIRECT'), ('g02', 'union:main', 'name', 'union:main:b01', 'name', 'UNION'), ('g02', 'union:main', 'name', 'union:main:b02', 'r_name', 'UNION'), ('g02', 'ROOT', 'name', 'union:main', 'name', 'UNION'),
('g03', 'ROOT', 'r_regionkey', 'region', 'r_regionkey', 'DIRECT'), ('g03', 'ROOT', 'r_name', 'region', 'r_name', 'DIRECT'),
('g04', 'cte:base', '*', 'ods.src', '*', 'EXPAND_ALL'), ('g04', 'cte:base', 'id', 'ods.src', 'id', 'DIRECT'), ('g04', 'cte:base', 'v', 'ods.src', 'v', 'DIRECT'),
('g04', 'cte:pick', 'id', 'cte:base', 'id', 'DIRECT'), ('g04', 'cte:pick', 'v', 'cte:base', 'v', 'DIRECT'), ('g04', 'ROOT', 'id', 'cte:pick', 'id', 'DIRECT'),
('g05', 'subq:s', 'id', 'supplier', 's_suppkey', 'DIRECT'), ('g05', 'subq:s', 'name', 'supplier', 's_name', 'DIRECT'), ('g05', 'ROOT', 'name', 'subq:s', 'name', 'DIRECT'), ('g05', 'ROOT', 'id', 'subq:s', 'id', 'DIRECT'), ('g05', 'ROOT', 'name', 'subq:s', 'name', 'DIRECT'), ('g05', 'ROOT', 'flag', 'CONSTANT', '\'\'n\'\'', 'CONSTANT'),
('g06', 'udtf:w', 'word', 'events', 'props', 'EXPRESSION'), ('g06', 'ROOT', 'event_id', 'events', 'event_id', 'DIRECT'), ('g06', 'ROOT', 'word', 'udtf:w', 'word', 'DIRECT'),
('g07', 'ROOT', 'o_orderkey', 'orders', 'o_orderkey', 'DIRECT'), ('g07', 'ROOT', 'size_class', 'orders', 'o_totalprice', 'CONDITIONAL'), ('g07', 'ROOT', 'rn', 'orders', 'o_custkey', 'WINDOW'), ('g07', 'ROOT', 'rn', 'orders', 'o_orderdate', 'WINDOW'),
('g08', 'ROOT', 'five', 'CONSTANT', '5', 'CONSTANT'), ('g08', 'ROOT', 'd', 'SYSTEM', 'current_date', 'EXPRESSION'), ('g08', 'ROOT', 'n', 'region', '*', 'AGGREGATE'), ('g08', 'ROOT', 'ab', 'CONSTANT', 'concat(\'\'a\'\', \'\'b\'\')', 'EXPRESSION'),
('g09', 'ROOT', 'p_name', 'part', 'p_name', 'DIRECT'), ('g09', 'ROOT', 's_name', 'supplier', 's_name', 'DIRECT'),
('g10', 'udtf:v', 'a', 'CONSTANT', '1', 'CONSTANT'), ('g10', 'udtf:v', 'b', 'CONSTANT', '\'\'x\'\'', 'CONSTANT'), ('g10', 'ROOT', 'a', 'udtf:v', 'a', 'DIRECT'), ('g10', 'ROOT', 'b', 'udtf:v', 'b', 'DIRECT'),
('g11', 'subq:derived_0', '_col_0', 'CONSTANT', '1', 'CONSTANT'), ('g11', 'ROOT', 'c_custkey', 'customer', 'c_custkey', 'DIRECT'), ('g12#0', 'ROOT', 'r_name', 'region', 'r_name', 'DIRECT'), ('g12#2', 'ROOT', 'n_name', 'nation', 'n_name', 'DIRECT'),
('g13', 'ROOT', 'kind', 'ods.raw', 'payload', 'DIRECT'), ('g14', 'ROOT', 'c_name', 'customer', 'c_name', 'DIRECT'), ('g14', 'ROOT', 'o_orderkey', 'orders', 'o_orderkey', 'DIRECT'),
('g15', 'union:main:b01', 'k', 'nation', 'n_nationkey', 'DIRECT'), ('g15', 'union:main:b02', 'r_regionkey', 'region', 'r_regionkey', 'DIRECT'), ('g15', 'union:main', 'k', 'union:main:b01', 'k', 'UNION'), ('g15', 'union:main', 'k', 'union:main:b02', 'r_regionkey', 'UNION'), ('g15', 'ROOT', 'k', 'union:main', 'k', 'UNION'),
('g16', 'ROOT', 'c_name', 'customer', 'c_name', 'DIRECT')
""",
    ),
    "merge_columns": values(
        "stmt, to_column, merge_branch, from_scope, from_column, transform",
        """
('g05', 'name', 'matched', 'subq:s', 'name', 'DIRECT'), ('g05', 'id', 'not_matched', 'subq:s', 'id', 'DIRECT'), ('g05', 'name', 'not_matched', 'subq:s', 'name', 'DIRECT'), ('g05', 'flag', 'not_matched', 'CONSTANT', '''n''', 'CONSTANT')
""",
    ),
    "lateral_view_facts": values("stmt, scope_id, function, output_columns", "('g06', 'udtf:w', 'explode', 'word')"),
    "trace_leaves": values(
        "stmt, name, leaf_scope, leaf_column, transform, n_visited",
        """
('g01', 'c_name', 'customer', 'c_name', 'DIRECT', 2), ('g01', 'total', 'orders', 'o_totalprice', 'AGGREGATE', 3), ('g02', 'name', 'nation', 'n_name', 'UNION', 6), ('g02', 'name', 'region', 'r_name', 'UNION', 6),
('g03', 'r_regionkey', 'region', 'r_regionkey', 'DIRECT', 2), ('g03', 'r_name', 'region', 'r_name', 'DIRECT', 2), ('g04', 'id', 'ods.src', 'id', 'DIRECT', 4),
('g05', 'name', 'supplier', 's_name', 'DIRECT', 3), ('g05', 'id', 'supplier', 's_suppkey', 'DIRECT', 3), ('g05', 'flag', 'CONSTANT', '\'\'n\'\'', 'CONSTANT', 2),
('g06', 'event_id', 'events', 'event_id', 'DIRECT', 2), ('g06', 'word', 'events', 'props', 'EXPRESSION', 3), ('g07', 'o_orderkey', 'orders', 'o_orderkey', 'DIRECT', 2), ('g07', 'size_class', 'orders', 'o_totalprice', 'CONDITIONAL', 2),
('g07', 'rn', 'orders', 'o_custkey', 'WINDOW', 3), ('g07', 'rn', 'orders', 'o_orderdate', 'WINDOW', 3), ('g08', 'five', 'CONSTANT', '5', 'CONSTANT', 2), ('g08', 'd', 'SYSTEM', 'current_date', 'EXPRESSION', 2),
('g08', 'n', 'region', '*', 'AGGREGATE', 2), ('g08', 'ab', 'CONSTANT', 'concat(\'\'a\'\', \'\'b\'\')', 'EXPRESSION', 2), ('g09', 'p_name', 'part', 'p_name', 'DIRECT', 2), ('g09', 's_name', 'supplier', 's_name', 'DIRECT', 2),
('g10', 'a', 'CONSTANT', '1', 'DIRECT', 3), ('g10', 'b', 'CONSTANT', '\'\'x\'\'', 'DIRECT', 3), ('g11', 'c_custkey', 'customer', 'c_custkey', 'DIRECT', 2), ('g12#0', 'r_name', 'region', 'r_name', 'DIRECT', 2), ('g12#2', 'n_name', 'nation', 'n_name', 'DIRECT', 2),
('g13', 'kind', 'ods.raw', 'payload', 'DIRECT', 2), ('g14', 'c_name', 'customer', 'c_name', 'DIRECT', 2), ('g14', 'o_orderkey', 'orders', 'o_orderkey', 'DIRECT', 2),
('g15', 'k', 'nation', 'n_nationkey', 'UNION', 6), ('g15', 'k', 'region', 'r_regionkey', 'UNION', 6), ('g16', 'c_name', 'customer', 'c_name', 'DIRECT', 2)
""",
    ),
    "multi_statement": values(
        "stmt, status, target_table, partition_columns",
        """
('g01', 'ok', 'mart.x', ''), ('g02', 'ok', 'mart.u', ''), ('g03', 'ok', 'mart.s', ''), ('g04', 'ok', 'mart.m', ''), ('g05', 'ok', 'mart.t', ''), ('g06', 'ok', 'mart.l', ''), ('g07', 'ok', 'mart.w', ''), ('g08', 'ok', 'mart.k', ''),
('g09', 'ok', 'mart.d', ''), ('g10', 'ok', 'mart.v', ''), ('g11', 'ok', 'mart.e', ''), ('g12#0', 'ok', 'mart.a1', ''), ('g12#1', 'error', '', ''), ('g12#2', 'ok', 'mart.a3', 'dt'), ('g13', 'ok', 'mart.f', ''), ('g14', 'ok', 'mart.q', ''),
('g15', 'ok', 'mart.i', ''), ('g16', 'ok', 'mart.j', '')
""",
    ),
    "warnings_by_type": values(
        "stmt, type, n",
        """
('g04', 'star_not_expanded', 1::BIGINT), ('g07', 'magic_number', 1::BIGINT), ('g08', 'magic_number', 1::BIGINT), ('g09', 'duplicate_alias', 4::BIGINT), ('g12#1', 'PARSE_ERROR', 1::BIGINT), ('g14', 'filter_in_join_on_clause', 1::BIGINT)
""",
    ),
    "dangling_scopes": values("stmt, scope_id, is_subquery_of", "('g11', 'subq:derived_0', true)"),
    "column_usage_metadata": values(
        "stmt, table_name, column_name, metadata_complete",
        """
('g01', 'customer', 'c_name', true), ('g01', 'customer', 'c_custkey', true), ('g01', 'orders', 'o_custkey', true), ('g01', 'orders', 'o_totalprice', true), ('g02', 'nation', 'n_name', true), ('g02', 'region', 'r_name', true),
('g03', 'region', 'r_regionkey', true), ('g03', 'region', 'r_name', true), ('g04', 'ods.src', '*', false), ('g04', 'ods.src', 'id', false), ('g04', 'ods.src', 'v', false), ('g05', 'supplier', 's_suppkey', true), ('g05', 'supplier', 's_name', true),
('g06', 'events', 'event_id', true), ('g06', 'events', 'props', true), ('g07', 'orders', 'o_orderkey', true), ('g07', 'orders', 'o_totalprice', true), ('g07', 'orders', 'o_custkey', true), ('g07', 'orders', 'o_orderdate', true),
('g08', 'region', 'r_regionkey', true), ('g08', 'region', 'r_name', true), ('g09', 'part', 'p_name', true), ('g09', 'part', 'p_partkey', true), ('g09', 'supplier', 's_name', true), ('g09', 'supplier', 's_suppkey', true),
('g11', 'customer', 'c_custkey', true), ('g11', 'orders', 'o_custkey', true), ('g12#0', 'region', 'r_name', true), ('g12#2', 'nation', 'n_name', true), ('g13', 'ods.raw', 'payload', false),
('g14', 'customer', 'c_name', true), ('g14', 'customer', 'c_custkey', true), ('g14', 'orders', 'o_orderkey', true), ('g14', 'orders', 'o_custkey', true), ('g14', 'orders', 'o_orderstatus', true), ('g15', 'nation', 'n_nationkey', true), ('g15', 'region', 'r_regionkey', true),
('g16', 'customer', 'c_name', true), ('g16', 'customer', 'c_custkey', true), ('g16', 'orders', 'o_custkey', true)
""",
    ),
    "output_metadata": values(
        "stmt, column_name, ordinal, metadata_complete",
        """
('g01', 'c_name', 0, false), ('g01', 'total', 1, false), ('g02', 'name', 0, false), ('g03', 'r_regionkey', 0, false), ('g03', 'r_name', 1, false), ('g04', 'id', 0, false), ('g05', 'name', 0, false), ('g05', 'id', 1, false), ('g05', 'flag', 3, false),
('g06', 'event_id', 0, false), ('g06', 'word', 1, false), ('g07', 'o_orderkey', 0, false), ('g07', 'size_class', 1, false), ('g07', 'rn', 2, false), ('g08', 'five', 0, false), ('g08', 'd', 1, false), ('g08', 'n', 2, false), ('g08', 'ab', 3, false),
('g09', 'p_name', 0, false), ('g09', 's_name', 1, false), ('g10', 'a', 0, false), ('g10', 'b', 1, false), ('g11', 'c_custkey', 0, false), ('g12#0', 'r_name', 0, false), ('g12#2', 'n_name', 0, false), ('g13', 'kind', 0, false),
('g14', 'c_name', 0, false), ('g14', 'o_orderkey', 1, false), ('g15', 'k', 0, false), ('g16', 'c_name', 0, false)
""",
    ),
    "scope_stats": values(
        "stmt, scope_count, physical_table_count, cte_count, subquery_count, union_count, union_branch_count, max_depth, case_when_count, window_function_count, join_count, aggregate_function_count",
        """
('g01', 4, 2, 1, 0, 0, 0, 2, 0, 0, 1, 1), ('g02', 6, 2, 0, 0, 1, 2, 3, 0, 0, 0, 0), ('g03', 2, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0), ('g04', 4, 1, 2, 0, 0, 0, 3, 0, 0, 0, 0), ('g05', 4, 2, 0, 1, 0, 0, 2, 0, 0, 1, 0),
('g06', 3, 1, 0, 1, 0, 0, 2, 0, 0, 0, 0), ('g07', 2, 1, 0, 0, 0, 0, 1, 1, 1, 0, 0), ('g08', 2, 1, 0, 0, 0, 0, 1, 0, 0, 0, 1), ('g09', 3, 2, 0, 0, 0, 0, 1, 0, 0, 1, 0), ('g10', 2, 0, 0, 1, 0, 0, 2, 0, 0, 0, 0),
('g11', 3, 1, 0, 1, 0, 0, 1, 0, 0, 0, 0), ('g12#0', 2, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0), ('g12#2', 2, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0), ('g13', 2, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0), ('g14', 3, 2, 0, 0, 0, 0, 1, 0, 0, 1, 0),
('g15', 6, 2, 0, 0, 1, 2, 3, 0, 0, 0, 0), ('g16', 3, 2, 0, 0, 0, 0, 1, 0, 0, 1, 0)
""",
    ),
}
