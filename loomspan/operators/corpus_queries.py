"""Queries over whole corpora: stored documents, tasks, edges, audits and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import audit, contract, diff, impact, insight, lineage, profile
from loomspan.operators.queries import _P1_WITH
from loomspan.runtime import table
from loomspan.sources import readers


def _docs(f):
    return lambda s, d: f(lineage.from_documents(table(s, d, "lineage_docs")))


def _tasks(f):
    return lambda s, d: f(lineage.analyze(table(s, d, "tasks"), table(s, d, "catalog_columns")))


def _on(f, *names):
    return lambda s, d: f(*(table(s, d, n) for n in names))


QUERIES = {
    # Stored lineage documents.
    "docs_scope_roles": _docs(lambda a: lineage.scope_facts(a).groupBy("kind", "role").agg(F.count("*").alias("n_scopes"))),
    "docs_transform_counts": _docs(lambda a: lineage.column_facts(a).groupBy("transform").agg(F.count("*").alias("n_columns"), F.sum("n_sources").alias("n_sources"))),
    "docs_case_branches": _docs(lambda a: lineage.case_facts(a).select("stmt", "scope_id", "name", "branch_no", F.coalesce("when_expr", F.lit("")).alias("when_expr"), F.coalesce("then_value", F.lit("")).alias("then_value"))),
    "docs_window_functions": _docs(lambda a: lineage.window_facts(a).groupBy("stmt").agg(F.count("*").alias("n_windows"))),
    "docs_issue_counts": _docs(lambda a: audit.issue_counts(audit.audit(a))),
    "docs_severity": _docs(lambda a: audit.severity_counts(audit.audit(a))),
    "docs_risky": _docs(lambda a: audit.risky_statements(audit.audit(a))),
    "docs_grain": _docs(lambda a: profile.grain(a).select("stmt", "grain")),
    "docs_key_renames": _docs(lambda a: profile.key_renames(a).groupBy("from_name", "to_name").agg(F.count("*").alias("n"))),
    "docs_stats": _docs(lambda a: lineage.stats(a).select("stmt", "cte_count", "subquery_count", "union_count", "union_branch_count", "case_when_count", "window_function_count", "aggregate_function_count")),
    "docs_column_usage": _docs(impact.column_usage),
    "docs_table_impact": _docs(impact.table_impact),
    "docs_profiles": _docs(profile.profiles),
    "docs_findings": _docs(insight.findings),
    "docs_insight_links": _docs(insight.link_counts),
    "docs_issues": _docs(audit.issue_facts),
    "docs_red": _docs(lambda a: audit.red_statements(audit.audit(a))),
    "docs_conditions": _docs(lambda a: profile.conditions(a).drop("task_id", "stmt_no")),
    "docs_contract": _on(contract.break_counts, "lineage_docs"),
    "docs_contract_required": _on(lambda d: contract.document_breaks(d).where(r"rule = 'missing' and place rlike '^(scopes\\{\\}\\.(columns\\[\\]\\.)?)?\\w+$'").groupBy("place").agg(F.count("*").alias("n_breaks"), F.count_distinct("stmt_id").alias("n_statements")), "lineage_docs"),
    # Statements of the task corpus, analysed.
    "task_statements": _tasks(lambda a: lineage.statements(a).groupBy("status", "stmt_kind").agg(F.count("*").alias("n_statements"))),
    "task_warnings": _tasks(lambda a: lineage.warning_facts(a).groupBy("type").agg(F.count("*").alias("n_warnings"))),
    "task_end_to_end": _tasks(lineage.end_to_end),
    "task_column_usage": _tasks(impact.column_usage),
    "task_traces": _tasks(lambda a: impact.traces(a, "ROOT")),
    "task_downstream": _tasks(impact.feeds),
    "task_upstream": _tasks(impact.upstream),
    "task_impact_reach": _tasks(impact.reach_of_sources),
    "task_severity": _tasks(lambda a: audit.severity_counts(audit.audit(a))),
    "task_schema_gaps": _tasks(audit.schema_gaps),
    "task_star_actions": _tasks(audit.star_actions),
    "task_steps": _tasks(lambda a: profile.steps(a).groupBy("role").agg(F.count("*").alias("n_steps"))),
    "task_important_columns": _tasks(profile.important_columns),
    "task_conditions": _tasks(lambda a: profile.conditions(a).groupBy("clause", "condition_kind", "filter_kind").agg(F.count("*").alias("n_conditions"))),
    "task_expressions": _tasks(profile.expressions),
    "task_risk": _tasks(lambda a: insight.task_risk(a).groupBy("risk").agg(F.count("*").alias("n_statements"))),
    "task_flat_lineage": _tasks(insight.flat_lineage),
    "task_equi_keys": _tasks(lineage.equal_columns),
    "task_first_statements": _tasks(lambda a: lineage.statements(lineage.first_statements(a))),
    "task_scope_order": _tasks(lineage.scope_order),
    "task_condition_fields": lambda s, d: profile.condition_fields(lineage.analyze(table(s, d, "tasks"), (c := table(s, d, "catalog_columns"))), c),
    "task_objects": _tasks(insight.objects),
    "task_findings": _tasks(insight.findings),
    "task_red": _tasks(lambda a: audit.red_statements(audit.audit(a))),
    "task_input_metadata": lambda s, d: lineage.input_metadata(lineage.analyze(table(s, d, "tasks"), (c := table(s, d, "catalog_columns"))), c),
    "task_output_metadata": lambda s, d: lineage.output_metadata(lineage.analyze(table(s, d, "tasks"), (c := table(s, d, "catalog_columns"))), c),
    "task_scopes": _tasks(lineage.scope_facts),
    "task_graph": _tasks(lineage.graph_edges),
    "task_edges": _tasks(lineage.edge_facts),
    "task_joins": _tasks(lineage.join_facts),
    "task_filters": _tasks(lineage.filter_facts),
    "task_groupings": _tasks(lineage.grouping_facts),
    "task_windows": _tasks(lineage.window_facts),
    "task_cases": _tasks(lineage.case_facts),
    "task_generators": _tasks(lineage.generator_facts),
    "task_stats": _tasks(lineage.stats),
    "task_xref_errors": _tasks(lineage.cross_reference_errors),
    "task_dangling_scopes": _tasks(insight.dangling_scopes),
    # Stored edges, audits, outputs, files and catalogues.
    "edges_end_to_end": _on(impact.stored_lineage, "column_edges"),
    "edges_table_usage": _on(impact.stored_usage, "column_edges"),
    "audits_summary": _on(audit.record_summary, "audit_records"),
    "audits_issue_counts": _on(audit.record_issue_counts, "audit_records"),
    "audits_red_rate": _on(audit.red_rate, "audit_records"),
    "audits_reds": _on(audit.record_reds, "audit_records"),
    "outputs_view_issues": _on(audit.view_issues, "left_output"),
    "outputs_presence": _on(lambda l, r: diff.presence(l, r).select("statement", "n_left", "n_right"), "left_output", "right_output"),
    "files_status": _on(lambda f: readers.task_bodies(f).groupBy("status").agg(F.count("*").alias("n_files")), "task_files"),
    "files_success_rate": _on(lambda f: readers.corpus_status(readers.task_bodies(f)), "task_files"),
    "catalog_normalized": _on(lambda c: readers.normalized_catalog(c).select("table_key", "name", "ordinal"), "catalog_columns"),
}

_DOCS = _P1_WITH[: _P1_WITH.index("lists AS (")].rstrip().rstrip(",")
_OBJ = _DOCS + ", c AS (SELECT * FROM col WHERE json_type(c) = 'OBJECT')"
_LIST = "CASE json_type(x) WHEN 'ARRAY' THEN list_filter(CAST(x AS JSON[]), lambda v: json_type(v) = 'OBJECT') WHEN 'OBJECT' THEN [x] ELSE [] END"


def _list(path: str) -> str:
    return _LIST.replace("x", f"json_extract(c, '{path}')")


_SCOPE_FLAGS = f"""
, flags AS (SELECT stmt_id, scope_id, bool_or(json_extract_string(c, '$.transform') = 'WINDOW') AS win, bool_or(json_extract_string(c, '$.transform') = 'AGGREGATE') AS agg,
    bool_and(coalesce(json_extract_string(c, '$.transform'), '?') = 'CONSTANT') AS con, bool_and(coalesce(json_extract_string(c, '$.transform'), '?') IN ('DIRECT', 'CONSTANT')) AS dir FROM c GROUP BY ALL),
sc AS (SELECT s.stmt_id, s.scope_id, json_extract(s.payload, '$.scopes."' || s.scope_id || '"') AS x FROM scopes s),
sized AS (SELECT sc.stmt_id, sc.scope_id, json_extract_string(x, '$.kind') AS kind, win, agg, con, dir,
    CASE json_type(x, '$.group_by') WHEN 'ARRAY' THEN len(list_filter(CAST(json_extract(x, '$.group_by') AS JSON[]), lambda v: json_type(v) = 'OBJECT')) WHEN 'OBJECT' THEN 1 ELSE 0 END AS g,
    CASE json_type(x, '$.joins') WHEN 'ARRAY' THEN len(list_filter(CAST(json_extract(x, '$.joins') AS JSON[]), lambda v: json_type(v) = 'OBJECT')) WHEN 'OBJECT' THEN 1 ELSE 0 END AS j,
    CASE json_type(x, '$.filters') WHEN 'ARRAY' THEN len(list_filter(CAST(json_extract(x, '$.filters') AS JSON[]), lambda v: json_type(v) = 'OBJECT')) WHEN 'OBJECT' THEN 1 ELSE 0 END
      + CASE json_type(x, '$.having') WHEN 'ARRAY' THEN len(list_filter(CAST(json_extract(x, '$.having') AS JSON[]), lambda v: json_type(v) = 'OBJECT')) WHEN 'OBJECT' THEN 1 ELSE 0 END AS f
  FROM sc LEFT JOIN flags USING (stmt_id, scope_id) WHERE json_type(x) = 'OBJECT')
"""

_EDGES_WITH = """
WITH RECURSIVE e AS (SELECT DISTINCT edge_id, stmt_id, to_scope, to_column, from_scope, from_column FROM column_edges WHERE stmt_id IS NOT NULL),
inside AS (SELECT DISTINCT stmt_id, to_scope AS scope FROM e),
walk AS (
  SELECT stmt_id, to_column AS name, from_scope, from_column FROM e WHERE to_scope = 'ROOT'
  UNION
  SELECT w.stmt_id, w.name, e.from_scope, e.from_column FROM walk w JOIN e ON e.stmt_id = w.stmt_id AND e.to_scope = w.from_scope AND e.to_column = w.from_column),
ends AS (
  SELECT DISTINCT w.stmt_id, w.name, w.from_scope AS source_table, w.from_column AS source_column FROM walk w ANTI JOIN inside i ON i.stmt_id = w.stmt_id AND i.scope = w.from_scope
  WHERE w.from_scope IS NOT NULL AND w.from_scope NOT IN ('CONSTANT', 'SYSTEM', 'UNKNOWN'))
"""

SQL = {
    "docs_scope_roles": _OBJ
    + _SCOPE_FLAGS
    + """SELECT kind, CASE WHEN kind IN ('union', 'union_branch') THEN kind WHEN coalesce(win, false) THEN 'dedup' WHEN coalesce(agg, false) OR g > 0 THEN 'aggregate' WHEN j > 0 THEN 'join' WHEN f > 0 THEN 'filter'
  WHEN coalesce(con, false) THEN 'label' WHEN coalesce(dir, false) THEN 'pass_through' ELSE 'transform' END AS role, count(*) AS n_scopes FROM sized GROUP BY ALL""",
    "docs_transform_counts": _OBJ + f" SELECT json_extract_string(c, '$.transform') AS transform, count(*) AS n_columns, CAST(sum(len({_list('$.sources')})) AS BIGINT) AS n_sources FROM c GROUP BY ALL",
    "docs_case_branches": _OBJ
    + f""", b AS (SELECT stmt_id, scope_id, json_extract_string(c, '$.name') AS name, unnest(range(len({_list('$.case_branches')}))) AS branch_no, unnest({_list('$.case_branches')}) AS x FROM c)
SELECT CAST(stmt_id AS VARCHAR) AS stmt, scope_id, name, CAST(branch_no AS INT) AS branch_no, coalesce(json_extract_string(x, '$.when_expr'), '') AS when_expr, coalesce(json_extract_string(x, '$.then_value'), '') AS then_value FROM b""",
    "docs_window_functions": _OBJ + " SELECT CAST(stmt_id AS VARCHAR) AS stmt, count(*) AS n_windows FROM c WHERE json_type(c, '$.window') = 'OBJECT' GROUP BY ALL",
    "docs_grain": _OBJ
    + _SCOPE_FLAGS
    + "SELECT CAST(d.stmt_id AS VARCHAR) AS stmt, CASE WHEN coalesce(bool_or(coalesce(s.agg, false) OR s.g > 0), false) THEN 'aggregate_level' ELSE 'record_level' END AS grain FROM docs d LEFT JOIN sized s USING (stmt_id) WHERE json_type(d.payload) = 'OBJECT' GROUP BY ALL",
    "docs_key_renames": _OBJ
    + f""", d AS (SELECT DISTINCT stmt_id, scope_id, json_extract_string({_list('$.sources')}[1], '$.column') AS from_name, json_extract_string(c, '$.name') AS to_name FROM c
  WHERE json_extract_string(c, '$.transform') = 'DIRECT' AND len({_list('$.sources')}) = 1)
SELECT from_name, to_name, count(*) AS n FROM d WHERE from_name <> '*' AND from_name <> to_name GROUP BY ALL""",
    "docs_stats": _OBJ
    + """, k AS (SELECT stmt_id, count(*) FILTER (WHERE kind = 'cte') AS a, count(*) FILTER (WHERE kind = 'subquery') AS b, count(*) FILTER (WHERE kind = 'union') AS u, count(*) FILTER (WHERE kind = 'union_branch') AS r
  FROM (SELECT stmt_id, json_extract_string(payload, '$.scopes."' || scope_id || '".kind') AS kind FROM scopes) GROUP BY stmt_id),
t AS (SELECT stmt_id, count(*) FILTER (WHERE t = 'CONDITIONAL') AS c, count(*) FILTER (WHERE t = 'WINDOW') AS w, count(*) FILTER (WHERE t = 'AGGREGATE') AS g FROM (SELECT stmt_id, json_extract_string(c, '$.transform') AS t FROM c) GROUP BY stmt_id)
SELECT CAST(d.stmt_id AS VARCHAR) AS stmt, CAST(coalesce(a, 0) AS INT) AS cte_count, CAST(coalesce(b, 0) AS INT) AS subquery_count, CAST(coalesce(u, 0) AS INT) AS union_count, CAST(coalesce(r, 0) AS INT) AS union_branch_count,
  CAST(coalesce(t.c, 0) AS INT) AS case_when_count, CAST(coalesce(w, 0) AS INT) AS window_function_count, CAST(coalesce(g, 0) AS INT) AS aggregate_function_count
FROM docs d LEFT JOIN k USING (stmt_id) LEFT JOIN t USING (stmt_id) WHERE json_type(d.payload) = 'OBJECT'""",
    "docs_table_impact": _DOCS
    + """, t AS (SELECT stmt_id, json_extract_string(payload, '$.target_table') AS target, unnest(CAST(json_extract(payload, '$.source_tables') AS VARCHAR[])) AS source_table FROM docs WHERE json_type(payload, '$.source_tables') = 'ARRAY')
SELECT source_table, count(DISTINCT stmt_id) AS n_statements, count(DISTINCT target) AS n_targets FROM t WHERE source_table IS NOT NULL GROUP BY ALL""",
    "edges_end_to_end": _EDGES_WITH + "SELECT stmt_id, name, source_table, source_column FROM ends",
    "edges_table_usage": _EDGES_WITH + "SELECT source_table, count(DISTINCT stmt_id) AS n_statements, count(DISTINCT (stmt_id, name)) AS n_outputs FROM ends GROUP BY ALL",
    "audits_summary": """WITH r AS (SELECT DISTINCT ON (audit_id) * FROM audit_records)
SELECT severity, count(*) AS n_records, CAST(sum(coalesce(list_sum(map_values(issues)), 0)) AS BIGINT) AS n_issues, CAST(sum(coalesce(list_sum(map_values(warnings)), 0)) AS BIGINT) AS n_warnings, CAST(coalesce(sum(root_cols), 0) AS BIGINT) AS root_cols FROM r GROUP BY severity""",
    "audits_issue_counts": """WITH r AS (SELECT DISTINCT audit_id, severity, lower(replace(trim(e.key), '`', '')) AS issue, e.value AS n FROM (SELECT audit_id, severity, unnest(map_entries(issues)) AS e FROM audit_records))
SELECT issue, count(DISTINCT audit_id) AS n_records, CAST(sum(n) AS BIGINT) AS n_issues, count(*) FILTER (WHERE severity = 'RED') AS n_red FROM r GROUP BY issue""",
    "audits_red_rate": """WITH r AS (SELECT DISTINCT audit_id, severity, audited_at FROM audit_records)
SELECT strftime(audited_at, '%Y-%m') AS period, count(*) AS n_records, count(*) FILTER (WHERE severity = 'RED') AS n_red, round(count(*) FILTER (WHERE severity = 'RED') / count(*), 6) AS red_rate FROM r GROUP BY ALL""",
    "outputs_presence": "SELECT statement, count(*) FILTER (WHERE side = 'l') AS n_left, count(*) FILTER (WHERE side = 'r') AS n_right FROM (SELECT statement, 'l' AS side FROM left_output UNION ALL SELECT statement, 'r' FROM right_output) GROUP BY statement",
    "audits_reds": """WITH r AS (SELECT DISTINCT ON (audit_id) audit_id, stmt, target, severity, list_transform(map_keys(issues), lambda k: lower(replace(trim(k), '`', ''))) AS k FROM audit_records)
SELECT audit_id, stmt, target, CASE WHEN list_has_any(k, ['unknown_column_ref', 'field_lineage.mmd_contains_unknown']) THEN 'unknown_source' WHEN list_has_any(k, ['dangling_column_ref', 'dangling_scope_ref']) THEN 'broken_reference'
  WHEN list_contains(k, 'root_empty_columns') THEN 'no_root_columns' WHEN list_has_any(k, ['missing_field_lineage', 'missing_scope_overview']) THEN 'missing_views'
  WHEN list_has_any(k, ['scope_graph_dangling_edge', 'duplicate_root_columns']) THEN 'other_structural' END AS red_class FROM r WHERE severity = 'RED'""",
    "outputs_view_issues": """WITH s AS (SELECT DISTINCT statement FROM left_output WHERE statement IS NOT NULL)
SELECT statement, 'missing_scope_overview' AS issue FROM s WHERE statement NOT IN (SELECT statement FROM left_output WHERE path = 'views/scope_overview.mmd' AND statement IS NOT NULL)
UNION ALL SELECT statement, 'missing_field_lineage' FROM s WHERE statement NOT IN (SELECT statement FROM left_output WHERE path = 'views/field_lineage.mmd' AND statement IS NOT NULL)
UNION ALL SELECT DISTINCT statement, 'field_lineage.mmd_contains_unknown' FROM left_output WHERE statement IS NOT NULL AND path = 'views/field_lineage.mmd' AND contains(body, 'UNKNOWN')""",
    "docs_contract_required": """WITH ok AS (SELECT stmt_id, payload FROM lineage_docs WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
sc AS (SELECT stmt_id, json_extract(payload, '$.scopes."' || id || '"') AS x FROM (SELECT stmt_id, payload, unnest(json_keys(payload, '$.scopes')) AS id FROM ok WHERE json_type(payload, '$.scopes') = 'OBJECT')),
col AS (SELECT stmt_id, unnest(CAST(json_extract(x, '$.columns') AS JSON[])) AS c FROM sc WHERE json_type(x) = 'OBJECT' AND json_type(x, '$.columns') = 'ARRAY'),
gone AS (
  SELECT stmt_id, k AS place FROM ok, (VALUES ('task_id'), ('target_table'), ('stmt_kind'), ('scope_graph'), ('scopes')) AS m(k) WHERE json_type(payload, '$.' || k) IS NULL
  UNION ALL SELECT stmt_id, 'scopes{}.' || k FROM sc, (VALUES ('kind'), ('depends_on'), ('columns')) AS m(k) WHERE json_type(x) = 'OBJECT' AND json_type(x, '$.' || k) IS NULL
  UNION ALL SELECT stmt_id, 'scopes{}.columns[].' || k FROM col, (VALUES ('name'), ('transform'), ('sources')) AS m(k) WHERE json_type(c) = 'OBJECT' AND json_type(c, '$.' || k) IS NULL)
SELECT place, count(*) AS n_breaks, count(DISTINCT stmt_id) AS n_statements FROM gone GROUP BY place""",
    "files_status": "SELECT CASE WHEN body IS NULL OR NOT json_valid(body) OR json_type(body) <> 'OBJECT' THEN 'error' WHEN trim(coalesce(json_extract_string(body, '$.sql'), '')) = '' THEN 'empty' ELSE 'ok' END AS status, count(*) AS n_files FROM task_files GROUP BY 1",
    "files_success_rate": "WITH s AS (SELECT CASE WHEN body IS NULL OR NOT json_valid(body) OR json_type(body) <> 'OBJECT' THEN 'error' WHEN trim(coalesce(json_extract_string(body, '$.sql'), '')) = '' THEN 'empty' ELSE 'ok' END AS s FROM task_files) SELECT count(*) FILTER (WHERE s = 'ok') AS n_ok, count(*) FILTER (WHERE s = 'error') AS n_error, count(*) FILTER (WHERE s = 'empty') AS n_empty, round(count(*) FILTER (WHERE s = 'ok') / count(*) FILTER (WHERE s <> 'empty'), 6) AS success_rate FROM s",
    "catalog_normalized": "SELECT lower(replace(trim(table_key), '`', '')) AS table_key, lower(trim(name)) AS name, min(ordinal) AS ordinal FROM catalog_columns GROUP BY 1, 2",
}
