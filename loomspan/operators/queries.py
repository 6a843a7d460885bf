"""The core problems' queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from loomspan.operators import diff, nested, orphans, trees
from loomspan.runtime import table

_P4 = ("column_edges", "catalog_columns", "audit_records", "issue_kinds")


def _on(f, *names):
    return lambda s, d: f(*(table(s, d, n) for n in names))


QUERIES = {
    "p1_found": _on(nested.child_objects, "lineage_docs"),
    "p1_scopes": _on(nested.scopes, "lineage_docs"),
    "p1_columns": _on(nested.columns, "lineage_docs"),
    "p1_links": _on(nested.links, "lineage_docs"),
    "p1_table_sizes": _on(nested.table_sizes, "lineage_docs"),
    "p2_found": _on(trees.found, "column_edges", "scope_joins"),
    "p2_hierarchies": lambda s, d: trees.hierarchies(table(s, d, "column_edges"), table(s, d, "scope_joins"), lists=True),
    "p2_tree_report": _on(trees.tree_report, "column_edges", "scope_joins"),
    "p4_found": _on(orphans.found, *_P4),
    "p4_cascade": _on(lambda e, c: orphans.cascade(e, c).select("edge_id", "stmt_id", "reason", "period", "round"), "column_edges", "catalog_columns"),
    "p4_report": _on(orphans.report, *_P4),
    "p6_found": _on(diff.compare, "left_output", "right_output"),
    "p6_summary": _on(diff.summary, "left_output", "right_output"),
}

_P1_WITH = """
WITH docs AS (
  SELECT stmt_id, payload FROM (
    SELECT *, row_number() OVER (PARTITION BY stmt_id ORDER BY received_at DESC, payload DESC) AS rn
    FROM lineage_docs WHERE stmt_id IS NOT NULL AND payload IS NOT NULL AND json_valid(payload)) WHERE rn = 1),
scopes AS (
  SELECT stmt_id, payload, unnest(json_keys(payload, '$.scopes')) AS scope_id FROM docs WHERE json_type(payload, '$.scopes') = 'OBJECT'),
cols AS (
  SELECT stmt_id, scope_id, CASE json_type(c) WHEN 'ARRAY' THEN CAST(c AS JSON[]) WHEN 'OBJECT' THEN [c] ELSE [] END AS c
  FROM (SELECT stmt_id, scope_id, json_extract(payload, '$.scopes."' || scope_id || '".columns') AS c FROM scopes)),
col AS (SELECT stmt_id, scope_id, unnest(range(len(c))) AS column_no, unnest(c) AS c FROM cols),
lists AS (
  SELECT stmt_id, scope_id, column_no, kind, v, a, b FROM col, (VALUES ('source', '$.sources', '$.scope', '$.column'), ('case_branch', '$.case_branches', '$.when_expr', '$.then_value'),
    ('branch', '$.branches', '$.branch', '$.from_column'), ('partition_by', '$.window.partition_by', '$.scope', '$.column'), ('order_by', '$.window.order_by', '$.scope', '$.column')) AS k(kind, v, a, b)
  WHERE json_type(c) = 'OBJECT'),
vals AS (
  SELECT l.stmt_id, l.scope_id, l.column_no, l.kind, l.a, l.b, json_extract(col.c, l.v) AS x FROM lists l JOIN col USING (stmt_id, scope_id, column_no)),
items AS (
  SELECT stmt_id, scope_id, column_no, kind, a, b, CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END AS x FROM vals),
item AS (SELECT stmt_id, scope_id, column_no, kind, a, b, unnest(range(len(x))) AS child_no, unnest(x) AS x FROM items)
"""

_P1_SQL = (
    _P1_WITH
    + """SELECT stmt_id, scope_id, CAST(column_no AS INT) AS column_no, kind AS child_kind, CAST(child_no AS INT) AS child_no,
  coalesce(json_extract_string(x, a), '') AS first_value, coalesce(json_extract_string(x, b), '') AS second_value
FROM item WHERE json_type(x) = 'OBJECT'
"""
)
_P1_ROWS = (
    _P1_WITH
    + """, sc AS (SELECT stmt_id, scope_id, json_extract(payload, '$.scopes."' || scope_id || '"') AS x FROM scopes),
flat AS (
  SELECT 'scope' AS tag, NULL AS parent_tag, stmt_id, NULL AS parent_key, scope_id AS row_key FROM sc WHERE json_type(x) = 'OBJECT'
  UNION ALL SELECT 'column', 'scope', stmt_id, scope_id, scope_id || '/' || column_no FROM col WHERE json_type(c) = 'OBJECT'
  UNION ALL SELECT kind, 'column', stmt_id, scope_id || '/' || column_no, '' FROM item WHERE json_type(x) = 'OBJECT')
"""
)

_P2_WITH = """
WITH RECURSIVE links AS (
  SELECT DISTINCT 'source' AS tree_kind, stmt_id, to_scope || '|' || coalesce(to_column, '') AS child, from_scope || '|' || coalesce(from_column, '') AS parent FROM column_edges WHERE edge_ordinal = 0
  UNION SELECT DISTINCT 'join', stmt_id, right_scope, left_scope FROM scope_joins),
nodes AS (
  SELECT tree_kind, stmt_id, child AS node FROM links WHERE child IS NOT NULL UNION SELECT tree_kind, stmt_id, parent FROM links WHERE parent IS NOT NULL),
ups AS (SELECT tree_kind, stmt_id, child AS node, min(parent) AS parent FROM links WHERE child IS NOT NULL AND parent IS NOT NULL GROUP BY ALL),
down AS (
  SELECT n.tree_kind, n.stmt_id, n.node, n.node AS root, 0 AS depth, [n.node] AS path FROM nodes n ANTI JOIN ups u ON n.tree_kind = u.tree_kind AND n.stmt_id = u.stmt_id AND n.node = u.node
  UNION ALL
  SELECT u.tree_kind, u.stmt_id, u.node, d.root, d.depth + 1, list_append(d.path, u.node) FROM down d JOIN ups u ON d.tree_kind = u.tree_kind AND d.stmt_id = u.stmt_id AND d.node = u.parent),
placed AS (
  SELECT n.tree_kind, n.stmt_id, n.node, u.parent, coalesce(d.root, '') AS root, coalesce(d.depth, -1) AS depth, coalesce(d.path, []) AS path
  FROM nodes n LEFT JOIN down d ON n.tree_kind = d.tree_kind AND n.stmt_id = d.stmt_id AND n.node = d.node LEFT JOIN ups u ON n.tree_kind = u.tree_kind AND n.stmt_id = u.stmt_id AND n.node = u.node),
below AS (
  SELECT tree_kind, stmt_id, node, count(*) AS n, list_sort(list(kid)) AS kids FROM (SELECT tree_kind, stmt_id, unnest(path[1:-2]) AS node, node AS kid FROM placed) GROUP BY ALL)
"""

_P4_WITH = r"""
WITH RECURSIVE edges AS (SELECT DISTINCT edge_id, stmt_id, to_scope, to_column, from_scope, from_column, seen_at FROM column_edges),
plain AS (
  SELECT *, array_to_string((string_split(lower(replace(trim(from_scope), '`', '')), '.'))[-2:], '.') AS t, lower(replace(trim(from_column), '`', '')) AS c, from_scope = 'ROOT' OR contains(from_scope, ':') AS inner_ref
  FROM edges WHERE from_scope IS NOT NULL),
refs AS (SELECT * FROM plain WHERE from_scope NOT IN ('CONSTANT', 'SYSTEM', 'UNKNOWN') AND from_column <> '*'),
cat AS (SELECT array_to_string((string_split(lower(replace(trim(table_key), '`', '')), '.'))[-2:], '.') AS t, lower(replace(trim(name), '`', '')) AS c, created_at AS s, deleted_at AS e FROM catalog_columns),
codes AS (SELECT DISTINCT audit_id, audited_at, lower(replace(trim(k), '`', '')) AS code FROM (SELECT audit_id, audited_at, unnest(map_keys(issues)) AS k FROM audit_records)),
kinds AS (SELECT lower(replace(trim(issue_code), '`', '')) AS code, added_at AS s, retired_at AS e FROM issue_kinds),
direct AS (
  SELECT 'column_edges' AS ref_table, r.edge_id AS ref_id, r.from_scope || '|' || r.from_column AS ref_key, 'missing' AS reason, strftime(r.seen_at, '%Y-%m') AS period
  FROM refs r WHERE r.inner_ref AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.stmt_id = r.stmt_id AND x.to_scope = r.from_scope AND x.to_column = r.from_column)
  UNION ALL
  SELECT 'column_edges', edge_id, t || '|' || c, CASE WHEN n = 0 THEN 'missing' WHEN gone THEN 'deleted' ELSE 'late' END, strftime(seen_at, '%Y-%m') FROM (
    SELECT r.edge_id, r.seen_at, r.t, r.c, count(cat.t) AS n, coalesce(bool_or(cat.e <= r.seen_at), false) AS gone, coalesce(bool_or(cat.s <= r.seen_at AND (cat.e IS NULL OR r.seen_at < cat.e)), false) AS alive
    FROM refs r LEFT JOIN cat ON cat.t = r.t AND cat.c = r.c WHERE NOT r.inner_ref GROUP BY ALL) WHERE NOT alive
  UNION ALL
  SELECT 'audit_records', audit_id, code, CASE WHEN n = 0 THEN 'missing' WHEN gone THEN 'deleted' ELSE 'late' END, strftime(audited_at, '%Y-%m') FROM (
    SELECT r.audit_id, r.audited_at, r.code, count(k.code) AS n, coalesce(bool_or(k.e <= r.audited_at), false) AS gone, coalesce(bool_or(k.s <= r.audited_at AND (k.e IS NULL OR r.audited_at < k.e)), false) AS alive
    FROM codes r LEFT JOIN kinds k USING (code) GROUP BY ALL) WHERE NOT alive)
"""

_P4_RUN = """,
run(edge_id, stmt_id, to_scope, to_column, round) USING KEY (edge_id) AS (
  SELECT e.edge_id, e.stmt_id, e.to_scope, e.to_column, 0 FROM edges e JOIN direct d ON d.ref_table = 'column_edges' AND d.ref_id = e.edge_id
  UNION
  SELECT e.edge_id, e.stmt_id, e.to_scope, e.to_column, r.round + 1 FROM run r JOIN edges e ON e.stmt_id = r.stmt_id AND e.from_scope = r.to_scope AND e.from_column = r.to_column
  WHERE NOT EXISTS (SELECT 1 FROM recurring.run x WHERE x.edge_id = e.edge_id)),
every AS (
  SELECT r.edge_id, r.stmt_id, d.ref_key, coalesce(d.reason, 'inherited') AS reason, strftime(e.seen_at, '%Y-%m') AS period, CAST(r.round AS INT) AS round
  FROM run r JOIN edges e USING (edge_id) LEFT JOIN (SELECT * FROM direct WHERE ref_table = 'column_edges') d ON d.ref_id = r.edge_id),
inherited AS (SELECT edge_id, period FROM every WHERE round > 0)
"""

_P6_WITH = """
WITH l AS (SELECT statement, path, severity, root_cols, body FROM (SELECT *, row_number() OVER (PARTITION BY statement, path ORDER BY written_at DESC) AS rn FROM left_output) WHERE rn = 1),
r AS (SELECT statement, path, severity, root_cols, body FROM (SELECT *, row_number() OVER (PARTITION BY statement, path ORDER BY written_at DESC) AS rn FROM right_output) WHERE rn = 1),
both_sides AS (SELECT l.statement, l.path, l.severity AS ls, r.severity AS rs, l.root_cols AS lc, r.root_cols AS rc, l.body AS lb, r.body AS rb FROM l JOIN r ON l.statement = r.statement AND l.path = r.path),
js AS (SELECT * FROM both_sides WHERE lb IS DISTINCT FROM rb AND ends_with(path, '.json') AND coalesce(json_valid(lb), false) AND coalesce(json_valid(rb), false)),
lt AS (SELECT js.statement, js.path, list(t.fullkey || ' ' || t.type || ' ' || coalesce(CAST(t.atom AS VARCHAR), '') ORDER BY t.fullkey) AS v FROM js, json_tree(js.lb) t GROUP BY ALL),
rt AS (SELECT js.statement, js.path, list(t.fullkey || ' ' || t.type || ' ' || coalesce(CAST(t.atom AS VARCHAR), '') ORDER BY t.fullkey) AS v FROM js, json_tree(js.rb) t GROUP BY ALL),
same_json AS (SELECT statement, path FROM lt JOIN rt USING (statement, path) WHERE lt.v = rt.v),
ls AS (SELECT DISTINCT statement FROM l), rs AS (SELECT DISTINCT statement FROM r),
cells AS (
  SELECT statement, '' AS path, 'missing_left' AS kind, '' AS field FROM rs ANTI JOIN ls USING (statement)
  UNION ALL SELECT statement, '', 'missing_right', '' FROM ls ANTI JOIN rs USING (statement)
  UNION ALL SELECT statement, path, 'missing_left_file', '' FROM r SEMI JOIN ls USING (statement) ANTI JOIN l USING (statement, path)
  UNION ALL SELECT statement, path, 'missing_right_file', '' FROM l SEMI JOIN rs USING (statement) ANTI JOIN r USING (statement, path)
  UNION ALL SELECT statement, path, 'content_diff', 'severity' FROM both_sides WHERE ls IS DISTINCT FROM rs
  UNION ALL SELECT statement, path, 'content_diff', 'root_cols' FROM both_sides WHERE lc IS DISTINCT FROM rc
  UNION ALL SELECT statement, path, 'content_diff', 'body' FROM both_sides ANTI JOIN same_json USING (statement, path) WHERE lb IS DISTINCT FROM rb)
"""

SQL = {
    "p1_found": _P1_SQL,
    "p1_scopes": _P1_ROWS
    + """SELECT stmt_id, scope_id AS row_key, json_extract_string(x, '$.kind') AS kind, json_extract_string(x, '$.role') AS role, json_extract_string(x, '$.set_op') AS set_op, TRY_CAST(json_extract_string(x, '$.distinct') AS BOOLEAN) AS distinct
FROM sc WHERE json_type(x) = 'OBJECT'""",
    "p1_columns": _P1_WITH
    + """SELECT stmt_id, scope_id AS parent_key, scope_id || '/' || column_no AS row_key, CAST(column_no AS INT) AS position, json_extract_string(c, '$.name') AS name, json_extract_string(c, '$.transform') AS transform,
  json_extract_string(c, '$.agg_function') AS agg_function, json_extract_string(c, '$.merge_branch') AS merge_branch FROM col WHERE json_type(c) = 'OBJECT'""",
    "p1_links": _P1_ROWS + "SELECT tag, parent_tag, count(*) AS n_rows, count(*) AS n_linked, count(DISTINCT (stmt_id, parent_key)) AS n_parents FROM flat WHERE parent_tag IS NOT NULL GROUP BY ALL",
    "p1_table_sizes": _P1_ROWS + "SELECT tag, count(*) AS n_rows, count(DISTINCT stmt_id) AS n_statements FROM flat GROUP BY tag",
    "p2_found": _P2_WITH + "SELECT tree_kind, stmt_id, node, root, depth FROM placed",
    "p2_hierarchies": _P2_WITH + "SELECT p.tree_kind, p.stmt_id, p.node, p.parent, p.root, p.depth, coalesce(b.n, 0) AS n_descendants, p.path, coalesce(b.kids, []) AS descendants FROM placed p LEFT JOIN below b ON p.tree_kind = b.tree_kind AND p.stmt_id = b.stmt_id AND p.node = b.node",
    "p2_tree_report": _P2_WITH
    + """SELECT p.tree_kind, count(*) AS n_nodes, count(*) FILTER (WHERE depth = 0) AS n_roots, count(*) FILTER (WHERE depth < 0) AS n_cyclic, max(depth) AS max_depth, max(coalesce(b.n, 0)) AS max_descendants
FROM placed p LEFT JOIN below b ON p.tree_kind = b.tree_kind AND p.stmt_id = b.stmt_id AND p.node = b.node GROUP BY p.tree_kind""",
    "p4_found": _P4_WITH + "SELECT ref_table, ref_id, ref_key, reason, period FROM direct",
    "p4_cascade": _P4_WITH + _P4_RUN + "SELECT edge_id, stmt_id, reason, period, round FROM every",
    "p4_report": _P4_WITH
    + _P4_RUN
    + """SELECT ref_table, period, count(*) FILTER (WHERE reason = 'missing') AS n_missing, count(*) FILTER (WHERE reason = 'deleted') AS n_deleted, count(*) FILTER (WHERE reason = 'late') AS n_late, count(*) FILTER (WHERE reason = 'inherited') AS n_inherited
FROM (SELECT ref_table, period, reason FROM direct UNION ALL SELECT 'column_edges', period, 'inherited' FROM inherited) GROUP BY ALL""",
    "p6_found": _P6_WITH + "SELECT statement, path, kind, field FROM cells",
    "p6_summary": _P6_WITH + "SELECT kind, field, count(*) AS n_cells, count(DISTINCT statement) AS n_statements FROM cells GROUP BY ALL",
}
