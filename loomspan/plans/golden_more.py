"""More statements, and stored documents, with facts worked out by hand from the rules.

As in golden: every query analyses its whole set, and its oracle was written down, not computed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import audit, contract, lineage, profile
from loomspan.plans.golden import TABLES, values
from loomspan.sources.readers import parquet_schemas

STATEMENTS = {
    # The detectors.
    "h01": "INSERT INTO mart.a SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 1",
    "h02": "INSERT INTO mart.b SELECT sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_f FROM orders",
    # Order, joins, set operations, merge actions.
    "h03": "INSERT INTO mart.c SELECT a.n_name AS name, b.r_name AS region FROM nation a FULL OUTER JOIN region b ON a.n_regionkey = b.r_regionkey ORDER BY name DESC, b.r_regionkey",
    "h04": "INSERT INTO mart.d SELECT o.o_orderkey FROM orders o JOIN lineitem l USING (o_orderkey)",
    "h05": "INSERT INTO mart.e SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier",
    "h06": "MERGE INTO nation t USING (SELECT r_regionkey AS n_nationkey, r_name AS n_name FROM region) s ON t.n_nationkey = s.n_nationkey "
    "WHEN MATCHED AND s.n_name = 'x' THEN DELETE WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *",
    # Several names for one expression, and generators in the select list.
    "h07": "INSERT INTO mart.g SELECT db.parse(e.props) AS (a, b) FROM events e",
    "h08": "INSERT INTO mart.h SELECT posexplode(split(props, ',')) FROM events",
    # The ladder of bare names, rung by rung: two scopes, a listed table, an unlisted table, a star, one scope, none.
    "h09": "INSERT INTO mart.i SELECT k FROM (SELECT n_nationkey AS k FROM nation) x JOIN (SELECT r_regionkey AS k FROM region) y ON x.k = y.k",
    "h10": "INSERT INTO mart.j SELECT c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey",
    "h11": "INSERT INTO mart.k SELECT zz FROM nation JOIN ods.raw2 r ON n_nationkey = r.id",
    "h12": "INSERT INTO mart.l WITH s AS (SELECT * FROM ods.raw3) SELECT q FROM s",
    "h13": "INSERT INTO mart.m2 SELECT missing FROM (SELECT n_name FROM nation) x",
    "h14": "INSERT INTO mart.n SELECT nothing FROM nation",
    # A partition column the catalogue does not list (the star shows it, but as a bare name it is found nowhere), a union in a union, a name given twice, a listed target.
    "h15": "INSERT INTO mart.o SELECT * FROM region WHERE dt = '2025-01-01'",
    "h16": "INSERT INTO mart.p SELECT n_name AS v FROM nation UNION ALL SELECT v FROM (SELECT r_name AS v FROM region UNION SELECT c_name FROM customer) z",
    "h17": "INSERT INTO mart.r SELECT n_name AS x, upper(n_name) AS x FROM nation",
    "h18": "INSERT INTO region SELECT n_regionkey AS r_regionkey, n_name AS r_name, 7 AS extra FROM nation",
    # Tables under scopes, conditions and expressions.
    "h19": "INSERT INTO mart.s2 WITH a AS (SELECT c_custkey FROM customer), b AS (SELECT a.c_custkey FROM a JOIN orders o ON a.c_custkey = o.o_custkey) SELECT c_custkey FROM b",
    "h20": "INSERT INTO mart.t2 SELECT p_name FROM part WHERE (p_size IN (1, 2) OR p_size BETWEEN 5 AND 9) AND p_brand NOT LIKE 'x%' AND p_type IS NOT NULL AND coalesce(p_retailprice, 0) >= 10 AND p_name NOT IN ('a')",
    "h21": "INSERT INTO mart.v2 SELECT CASE WHEN p_size > 10 THEN 'big' WHEN p_size > 5 THEN 'mid' ELSE 'small' END AS s FROM part",
}

_SRC = lambda scope, column: {"scope": scope, "column": column}
_COL = lambda name, transform, *sources, **more: {"name": name, "transform": transform, "sources": list(sources), **more}


def _document(scopes: dict, nodes: list[str], edges: list[tuple[str, str]], **more) -> dict:
    graph = {"nodes": nodes, "edges": [{"from": a, "to": b} for a, b in edges]}
    return {"task_id": "t", "target_table": "m.t", "stmt_kind": "INSERT", "source_tables": [n for n in nodes if "." in n], "scopes": scopes, "scope_graph": graph, "diagnostics": {"warnings": []}, **more}


DOCUMENTS = {
    # Nothing wrong.
    1: _document({"ROOT": {"kind": "root", "depends_on": ["s.a"], "columns": [_COL("x", "DIRECT", _SRC("s.a", "x")), _COL("y", "CONSTANT", expression="-1"), _COL("z", "EXPRESSION", expression="current_date()")]}}, ["s.a", "ROOT"], [("s.a", "ROOT")]),
    # A column its scope does not have, an unknown source, a scope nobody knows, a name given twice, an edge from nowhere.
    2: _document(
        {"cte:c": {"kind": "cte", "depends_on": ["s.a"], "columns": [_COL("x", "DIRECT", _SRC("s.a", "x"))]}, "ROOT": {"kind": "root", "depends_on": ["cte:c"], "columns": [_COL("x", "DIRECT", _SRC("cte:c", "x")), _COL("x", "DIRECT", _SRC("cte:c", "gone")), _COL("u", "DIRECT", _SRC("UNKNOWN", "u")), _COL("v", "DIRECT", _SRC("cte:q", "v"))]}},
        ["s.a", "cte:c", "ROOT"], [("s.a", "cte:c"), ("cte:c", "ROOT"), ("s.b", "ROOT")],
    ),
    # A scope expanded from a table whose schema lacks a column, a star left, a column from nothing.
    3: _document(
        {"cte:w": {"kind": "cte", "depends_on": ["s.w"], "columns": [_COL(n, "DIRECT", _SRC("s.w", n)) for n in ("a", "b", "c")]}, "ROOT": {"kind": "root", "depends_on": ["cte:w"], "columns": [_COL("a", "DIRECT", _SRC("cte:w", "a")), _COL("dt", "DIRECT", _SRC("cte:w", "dt")), _COL("*", "EXPAND_ALL", _SRC("cte:w", "*")), _COL("n", "EXPRESSION", expression="f()")]}},
        ["s.w", "cte:w", "ROOT"], [("s.w", "cte:w"), ("cte:w", "ROOT")],
    ),
    # No result columns; members missing, empty, of another kind or value.
    4: {"task_id": "", "target_table": "m.t", "stmt_kind": "SELECT", "scopes": {"ROOT": {"kind": "root", "columns": [], "depends_on": ["s.a", 3]}}, "scope_graph": {"nodes": ["s.a", "ROOT"]}},
    # Only a warning.
    5: _document({"ROOT": {"kind": "root", "depends_on": ["s.a"], "columns": [_COL("x", "DIRECT", _SRC("s.a", "x"))]}}, ["s.a", "ROOT"], [("s.a", "ROOT")], diagnostics={"warnings": [{"type": "duplicate_alias", "scope": "ROOT", "msg": "a"}]}),
}


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = spark.createDataFrame(list(STATEMENTS.items()), "task_name string, sql string")
    return lineage.analyze(tasks, parquet_schemas(spark, sf_dir, TABLES))


def deliveries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, None, json.dumps(d)) for i, d in DOCUMENTS.items()], "stmt_id bigint, received_at timestamp, payload string")


def _on(f):
    return lambda s, d: f(analysed(s, d))


def _docs(f):
    return lambda s, d: f(lineage.from_documents(deliveries(s)))


_text = lambda *names: [F.coalesce(F.col(n), F.lit("")).alias(n) for n in names]

QUERIES = {
    "more_edges": _on(lambda a: lineage.edge_facts(a).select("stmt", "to_scope", "to_column", *_text("merge_branch"), "from_scope", "from_column", "transform")),
    "more_warnings": _on(lambda a: lineage.warning_facts(a).select("stmt", "type", "scope_id")),
    "more_joins": _on(lambda a: lineage.join_facts(a).select("stmt", "scope_id", "join_type", "left_scope", "right_scope", *_text("condition_expression"), "condition_columns")),
    "equal_columns": _on(lambda a: lineage.equal_columns(a).select("stmt", "scope_id", "left_key", "right_key")),
    "order_facts": _on(lambda a: lineage.ordering_facts(a).select("stmt", "scope_id", "no", "from_scope", "from_column", "direction")),
    "scope_order": _on(lambda a: lineage.scope_order(a).select("stmt", "scope_id", "order_no", "direct_tables", "tables")),
    "set_operations": _on(lambda a: lineage.scope_facts(a).where("kind = 'union'").select("stmt", "scope_id", "set_op", F.concat_ws(",", "branches").alias("branches"))),
    "condition_facts": _on(lambda a: profile.conditions(a).select("stmt", "scope_id", "clause", "expression", *_text("condition_kind"), "filter_kind", "operators", "physical")),
    "condition_fields": _on(lambda a: profile.condition_fields(a).select("stmt", "scope_id", "clause", "table_name", "column_name")),
    "expression_catalog": _on(lambda a: profile.expressions(a).select("stmt", "expr_id", "kind", "transform", "expression", "n_branches")),
    "incomplete_traces": _on(lambda a: lineage.end_to_end(a).where("not complete").select("stmt", "name", "reasons")),
    "listed_targets": lambda s, d: lineage.output_metadata(analysed(s, d), parquet_schemas(s, d, TABLES)).where("metadata_complete").select("stmt", "column_name", "ordinal"),
    "document_issues": _docs(lambda a: audit.issue_facts(a).select("stmt", "issue", *_text("scope_id", "column_name", "ref"))),
    "document_severity": _docs(lambda a: audit.audit(a).select("stmt", "severity", "root_cols", F.coalesce(audit.red_class(F.map_keys("issues")), F.lit("")).alias("red_class"))),
    "document_contract": lambda s, d: contract.document_breaks(deliveries(s)),
}

SQL = {
    "more_edges": values(
        "stmt, to_scope, to_column, merge_branch, from_scope, from_column, transform",
        """
('h01', 'union:main:b01', 'n_name', '', 'nation', 'n_name', 'DIRECT'), ('h01', 'union:main:b02', 'n_name', '', 'nation', 'n_name', 'DIRECT'), ('h01', 'union:main', 'n_name', '', 'union:main:b01', 'n_name', 'UNION'),
('h01', 'union:main', 'n_name', '', 'union:main:b02', 'n_name', 'UNION'), ('h01', 'ROOT', 'n_name', '', 'union:main', 'n_name', 'UNION'), ('h02', 'ROOT', 'n_f', '', 'orders', 'o_orderstatus', 'AGGREGATE'),
('h03', 'ROOT', 'name', '', 'nation', 'n_name', 'DIRECT'), ('h03', 'ROOT', 'region', '', 'region', 'r_name', 'DIRECT'), ('h04', 'ROOT', 'o_orderkey', '', 'orders', 'o_orderkey', 'DIRECT'),
('h05', 'union:main:b01', 'k', '', 'customer', 'c_nationkey', 'DIRECT'), ('h05', 'union:main:b02', 's_nationkey', '', 'supplier', 's_nationkey', 'DIRECT'), ('h05', 'union:main', 'k', '', 'union:main:b01', 'k', 'UNION'),
('h05', 'union:main', 'k', '', 'union:main:b02', 's_nationkey', 'UNION'), ('h05', 'ROOT', 'k', '', 'union:main', 'k', 'UNION'),
('h06', 'subq:s', 'n_nationkey', '', 'region', 'r_regionkey', 'DIRECT'), ('h06', 'subq:s', 'n_name', '', 'region', 'r_name', 'DIRECT'), ('h06', 'ROOT', 'n_nationkey', 'matched', 'subq:s', 'n_nationkey', 'DIRECT'),
('h06', 'ROOT', 'n_name', 'matched', 'subq:s', 'n_name', 'DIRECT'), ('h06', 'ROOT', 'n_nationkey', 'not_matched', 'subq:s', 'n_nationkey', 'DIRECT'), ('h06', 'ROOT', 'n_name', 'not_matched', 'subq:s', 'n_name', 'DIRECT'),
('h07', 'ROOT', 'a', '', 'events', 'props', 'EXPRESSION'), ('h07', 'ROOT', 'b', '', 'events', 'props', 'EXPRESSION'), ('h08', 'ROOT', 'pos', '', 'events', 'props', 'EXPRESSION'), ('h08', 'ROOT', 'col', '', 'events', 'props', 'EXPRESSION'),
('h09', 'subq:x', 'k', '', 'nation', 'n_nationkey', 'DIRECT'), ('h09', 'subq:y', 'k', '', 'region', 'r_regionkey', 'DIRECT'), ('h09', 'ROOT', 'k', '', 'subq:x', 'k', 'DIRECT'),
('h10', 'ROOT', 'c_name', '', 'customer', 'c_name', 'DIRECT'), ('h10', 'ROOT', 'o_totalprice', '', 'orders', 'o_totalprice', 'DIRECT'), ('h11', 'ROOT', 'zz', '', 'ods.raw2', 'zz', 'DIRECT'),
('h12', 'cte:s', '*', '', 'ods.raw3', '*', 'EXPAND_ALL'), ('h12', 'cte:s', 'q', '', 'ods.raw3', 'q', 'DIRECT'), ('h12', 'ROOT', 'q', '', 'cte:s', 'q', 'DIRECT'),
('h13', 'subq:x', 'n_name', '', 'nation', 'n_name', 'DIRECT'), ('h13', 'ROOT', 'missing', '', 'subq:x', 'missing', 'DIRECT'), ('h14', 'ROOT', 'nothing', '', 'UNKNOWN', 'nothing', 'DIRECT'),
('h15', 'ROOT', 'r_regionkey', '', 'region', 'r_regionkey', 'DIRECT'), ('h15', 'ROOT', 'r_name', '', 'region', 'r_name', 'DIRECT'), ('h15', 'ROOT', 'dt', '', 'region', 'dt', 'DIRECT'),
('h16', 'union:main:b01', 'v', '', 'nation', 'n_name', 'DIRECT'), ('h16', 'union:z:b01', 'v', '', 'region', 'r_name', 'DIRECT'), ('h16', 'union:z:b02', 'c_name', '', 'customer', 'c_name', 'DIRECT'),
('h16', 'union:z', 'v', '', 'union:z:b01', 'v', 'UNION'), ('h16', 'union:z', 'v', '', 'union:z:b02', 'c_name', 'UNION'), ('h16', 'subq:z', 'v', '', 'union:z', 'v', 'UNION'), ('h16', 'union:main:b02', 'v', '', 'subq:z', 'v', 'DIRECT'),
('h16', 'union:main', 'v', '', 'union:main:b01', 'v', 'UNION'), ('h16', 'union:main', 'v', '', 'union:main:b02', 'v', 'UNION'), ('h16', 'ROOT', 'v', '', 'union:main', 'v', 'UNION'),
('h17', 'ROOT', 'x', '', 'nation', 'n_name', 'EXPRESSION'), ('h18', 'ROOT', 'r_regionkey', '', 'nation', 'n_regionkey', 'DIRECT'), ('h18', 'ROOT', 'r_name', '', 'nation', 'n_name', 'DIRECT'), ('h18', 'ROOT', 'extra', '', 'CONSTANT', '7', 'CONSTANT'),
('h19', 'cte:a', 'c_custkey', '', 'customer', 'c_custkey', 'DIRECT'), ('h19', 'cte:b', 'c_custkey', '', 'cte:a', 'c_custkey', 'DIRECT'), ('h19', 'ROOT', 'c_custkey', '', 'cte:b', 'c_custkey', 'DIRECT'),
('h20', 'ROOT', 'p_name', '', 'part', 'p_name', 'DIRECT'), ('h21', 'ROOT', 's', '', 'part', 'p_size', 'CONDITIONAL')
""",
    ),
    "more_warnings": values(
        "stmt, type, scope_id",
        """
('h01', 'duplicate_table_in_union', 'union:main'), ('h02', 'complex_aggregate_with_case', 'ROOT'), ('h06', 'merge_delete_ignored', 'ROOT'), ('h09', 'ambiguous_unqualified', 'ROOT'), ('h11', 'unresolved_unqualified_no_schema', 'ROOT'),
('h12', 'star_not_expanded', 'cte:s'), ('h14', 'column_not_found', 'ROOT'), ('h15', 'column_not_found', 'ROOT'), ('h18', 'magic_number', 'ROOT'), ('h21', 'magic_number', 'ROOT')
""",
    ),
    "more_joins": values(
        "stmt, scope_id, join_type, left_scope, right_scope, condition_expression, condition_columns",
        """
('h03', 'ROOT', 'FULL_OUTER', 'nation', 'region', 'a.n_regionkey = b.r_regionkey', 'nation.n_regionkey,region.r_regionkey'), ('h04', 'ROOT', 'INNER', 'orders', 'lineitem', 'using(o_orderkey)', 'orders.o_orderkey,lineitem.o_orderkey'),
('h06', 'ROOT', 'MERGE', 'nation', 'subq:s', 't.n_nationkey = s.n_nationkey', 'nation.n_nationkey,subq:s.n_nationkey'), ('h09', 'ROOT', 'INNER', 'subq:x', 'subq:y', 'x.k = y.k', 'subq:x.k,subq:y.k'),
('h10', 'ROOT', 'INNER', 'customer', 'orders', 'c_custkey = o_custkey', 'customer.c_custkey,orders.o_custkey'), ('h11', 'ROOT', 'INNER', 'nation', 'ods.raw2', 'n_nationkey = r.id', 'nation.n_nationkey,ods.raw2.id'),
('h19', 'cte:b', 'INNER', 'cte:a', 'orders', 'a.c_custkey = o.o_custkey', 'cte:a.c_custkey,orders.o_custkey')
""",
    ),
    "equal_columns": values(
        "stmt, scope_id, left_key, right_key",
        """
('h03', 'ROOT', 'nation.n_regionkey', 'region.r_regionkey'), ('h04', 'ROOT', 'orders.o_orderkey', 'lineitem.o_orderkey'), ('h06', 'ROOT', 'nation.n_nationkey', 'subq:s.n_nationkey'), ('h09', 'ROOT', 'subq:x.k', 'subq:y.k'),
('h10', 'ROOT', 'customer.c_custkey', 'orders.o_custkey'), ('h11', 'ROOT', 'nation.n_nationkey', 'ods.raw2.id'), ('h19', 'cte:b', 'cte:a.c_custkey', 'orders.o_custkey')
""",
    ),
    "order_facts": values("stmt, scope_id, no, from_scope, from_column, direction", "('h03', 'ROOT', 0, 'ROOT', 'name', 'DESC'), ('h03', 'ROOT', 1, 'region', 'r_regionkey', 'ASC')"),
    "scope_order": values(
        "stmt, scope_id, order_no, direct_tables, tables",
        """
('h01', 'union:main:b01', 0, 'nation', 'nation'), ('h01', 'union:main:b02', 1, 'nation', 'nation'), ('h01', 'union:main', 2, '', 'nation'), ('h01', 'ROOT', 3, '', 'nation'), ('h02', 'ROOT', 0, 'orders', 'orders'),
('h03', 'ROOT', 0, 'nation,region', 'nation,region'), ('h04', 'ROOT', 0, 'lineitem,orders', 'lineitem,orders'),
('h05', 'union:main:b01', 0, 'customer', 'customer'), ('h05', 'union:main:b02', 1, 'supplier', 'supplier'), ('h05', 'union:main', 2, '', 'customer,supplier'), ('h05', 'ROOT', 3, '', 'customer,supplier'),
('h06', 'subq:s', 0, 'region', 'region'), ('h06', 'ROOT', 1, '', 'region'), ('h07', 'ROOT', 0, 'events', 'events'), ('h08', 'ROOT', 0, 'events', 'events'),
('h09', 'subq:x', 0, 'nation', 'nation'), ('h09', 'subq:y', 1, 'region', 'region'), ('h09', 'ROOT', 2, '', 'nation,region'), ('h10', 'ROOT', 0, 'customer,orders', 'customer,orders'), ('h11', 'ROOT', 0, 'nation,ods.raw2', 'nation,ods.raw2'),
('h12', 'cte:s', 0, 'ods.raw3', 'ods.raw3'), ('h12', 'ROOT', 1, '', 'ods.raw3'), ('h13', 'subq:x', 0, 'nation', 'nation'), ('h13', 'ROOT', 1, '', 'nation'), ('h14', 'ROOT', 0, '', ''), ('h15', 'ROOT', 0, 'region', 'region'),
('h16', 'union:main:b01', 0, 'nation', 'nation'), ('h16', 'union:z:b01', 1, 'region', 'region'), ('h16', 'union:z:b02', 2, 'customer', 'customer'), ('h16', 'union:z', 3, '', 'customer,region'), ('h16', 'subq:z', 4, '', 'customer,region'),
('h16', 'union:main:b02', 5, '', 'customer,region'), ('h16', 'union:main', 6, '', 'customer,nation,region'), ('h16', 'ROOT', 7, '', 'customer,nation,region'), ('h17', 'ROOT', 0, 'nation', 'nation'), ('h18', 'ROOT', 0, 'nation', 'nation'),
('h19', 'cte:a', 0, 'customer', 'customer'), ('h19', 'cte:b', 1, 'orders', 'customer,orders'), ('h19', 'ROOT', 2, '', 'customer,orders'), ('h20', 'ROOT', 0, 'part', 'part'), ('h21', 'ROOT', 0, 'part', 'part')
""",
    ),
    "set_operations": values(
        "stmt, scope_id, set_op, branches",
        "('h01', 'union:main', 'UNION_ALL', 'union:main:b01,union:main:b02'), ('h05', 'union:main', 'EXCEPT', 'union:main:b01,union:main:b02'), ('h16', 'union:main', 'UNION_ALL', 'union:main:b01,union:main:b02'), ('h16', 'union:z', 'UNION', 'union:z:b01,union:z:b02')",
    ),
    "condition_facts": values(
        "stmt, scope_id, clause, expression, condition_kind, filter_kind, operators, physical",
        """
('h01', 'union:main:b02', 'WHERE', 'n_regionkey = 1', 'SINGLE_CONDITION', 'other_filter', '=', 'nation.n_regionkey'), ('h03', 'ROOT', 'JOIN_ON', 'a.n_regionkey = b.r_regionkey', 'SINGLE_CONDITION', 'join_condition', '=', 'nation.n_regionkey,region.r_regionkey'),
('h04', 'ROOT', 'JOIN_ON', 'using(o_orderkey)', '', 'join_condition', '', 'orders.o_orderkey,lineitem.o_orderkey'),
('h06', 'ROOT', 'WHEN', 's.n_name = ''x''', 'SINGLE_CONDITION', 'other_filter', '=', 'region.r_name'), ('h06', 'ROOT', 'JOIN_ON', 't.n_nationkey = s.n_nationkey', 'SINGLE_CONDITION', 'join_condition', '=', 'nation.n_nationkey,region.r_regionkey'),
('h09', 'ROOT', 'JOIN_ON', 'x.k = y.k', 'SINGLE_CONDITION', 'join_condition', '=', 'nation.n_nationkey,region.r_regionkey'), ('h10', 'ROOT', 'JOIN_ON', 'c_custkey = o_custkey', 'SINGLE_CONDITION', 'join_condition', '=', 'customer.c_custkey,orders.o_custkey'),
('h11', 'ROOT', 'JOIN_ON', 'n_nationkey = r.id', 'SINGLE_CONDITION', 'join_condition', '=', 'nation.n_nationkey,ods.raw2.id'), ('h15', 'ROOT', 'WHERE', 'dt = ''2025-01-01''', 'SINGLE_CONDITION', 'partition_filter', '=', ''),
('h19', 'cte:b', 'JOIN_ON', 'a.c_custkey = o.o_custkey', 'SINGLE_CONDITION', 'join_condition', '=', 'customer.c_custkey,orders.o_custkey'),
('h20', 'ROOT', 'WHERE', '(p_size IN (1, 2) OR p_size BETWEEN 5 AND 9) AND p_brand NOT LIKE ''x%'' AND p_type IS NOT NULL AND coalesce(p_retailprice, 0) >= 10 AND p_name NOT IN (''a'')', 'MIXED_AND_OR', 'other_filter',
 'IN,BETWEEN,NOT_LIKE,IS_NOT_NULL,>=,COALESCE,NOT_IN', 'part.p_size,part.p_brand,part.p_type,part.p_retailprice,part.p_name')
""",
    ),
    "condition_fields": values(
        "stmt, scope_id, clause, table_name, column_name",
        """
('h01', 'union:main:b02', 'WHERE', 'nation', 'n_regionkey'), ('h03', 'ROOT', 'JOIN_ON', 'nation', 'n_regionkey'), ('h03', 'ROOT', 'JOIN_ON', 'region', 'r_regionkey'), ('h04', 'ROOT', 'JOIN_ON', 'orders', 'o_orderkey'), ('h04', 'ROOT', 'JOIN_ON', 'lineitem', 'o_orderkey'),
('h06', 'ROOT', 'WHEN', 'region', 'r_name'), ('h06', 'ROOT', 'JOIN_ON', 'nation', 'n_nationkey'), ('h06', 'ROOT', 'JOIN_ON', 'region', 'r_regionkey'), ('h09', 'ROOT', 'JOIN_ON', 'nation', 'n_nationkey'), ('h09', 'ROOT', 'JOIN_ON', 'region', 'r_regionkey'),
('h10', 'ROOT', 'JOIN_ON', 'customer', 'c_custkey'), ('h10', 'ROOT', 'JOIN_ON', 'orders', 'o_custkey'), ('h11', 'ROOT', 'JOIN_ON', 'nation', 'n_nationkey'), ('h11', 'ROOT', 'JOIN_ON', 'ods.raw2', 'id'),
('h19', 'cte:b', 'JOIN_ON', 'customer', 'c_custkey'), ('h19', 'cte:b', 'JOIN_ON', 'orders', 'o_custkey'), ('h20', 'ROOT', 'WHERE', 'part', 'p_size'), ('h20', 'ROOT', 'WHERE', 'part', 'p_brand'), ('h20', 'ROOT', 'WHERE', 'part', 'p_type'),
('h20', 'ROOT', 'WHERE', 'part', 'p_retailprice'), ('h20', 'ROOT', 'WHERE', 'part', 'p_name')
""",
    ),
    "expression_catalog": values(
        "stmt, expr_id, kind, transform, expression, n_branches",
        """
('h02', 'expr_1', 'result', 'AGGREGATE', 'sum(CASE WHEN o_orderstatus = ''F'' THEN 1 ELSE 0 END)', 0), ('h07', 'expr_1', 'result', 'EXPRESSION', 'db.parse(e.props)', 0), ('h08', 'expr_1', 'result', 'EXPRESSION', 'posexplode(split(props, '',''))', 0),
('h17', 'expr_1', 'result', 'EXPRESSION', 'upper(n_name)', 0), ('h21', 'expr_1', 'result', 'CONDITIONAL', 'CASE WHEN p_size > 10 THEN ''big'' WHEN p_size > 5 THEN ''mid'' ELSE ''small'' END', 3),
('h21', 'expr_2', 'case', 'CONDITIONAL', 'CASE WHEN p_size > 10 THEN ''big'' WHEN p_size > 5 THEN ''mid'' ELSE ''small'' END', 3)
""",
    ),
    "incomplete_traces": values("stmt, name, reasons", "('h13', 'missing', 'missing_scope_column'), ('h14', 'nothing', 'unknown_source')"),
    "listed_targets": values("stmt, column_name, ordinal", "('h06', 'n_nationkey', 0), ('h06', 'n_name', 1), ('h18', 'r_regionkey', 0), ('h18', 'r_name', 1)"),
    "document_issues": values(
        "stmt, issue, scope_id, column_name, ref",
        """
('2', 'scope_graph_dangling_edge', 'ROOT', '', 's.b'), ('2', 'dangling_column_ref', 'cte:c', 'gone', 'ROOT'), ('2', 'unknown_column_ref', 'ROOT', 'u', 'u'), ('2', 'dangling_scope_ref', 'ROOT', 'v', 'cte:q'), ('2', 'duplicate_root_columns', 'ROOT', 'x', ''),
('3', 'schema_incomplete_column_ref', 'cte:w', 'dt', 'ROOT'), ('3', 'star_passthrough_placeholder', 'ROOT', '*', ''), ('3', 'nonconstant_no_sources', 'ROOT', 'n', ''), ('4', 'root_empty_columns', 'ROOT', '', 'm.t')
""",
    ),
    "document_severity": values("stmt, severity, root_cols, red_class", "('1', 'GREEN', 3, ''), ('2', 'RED', 4, 'unknown_source'), ('3', 'YELLOW', 4, ''), ('4', 'RED', 0, 'no_root_columns'), ('5', 'YELLOW', 1, '')"),
    "document_contract": values(
        "stmt_id, place, rule",
        "(4::BIGINT, 'task_id', 'empty'), (4::BIGINT, 'stmt_kind', 'value'), (4::BIGINT, 'scopes{}.depends_on[]', 'string'), (4::BIGINT, 'scope_graph.edges', 'missing')",
    ),
}
