"""Statements into fact tables, and what is derived from them.

`analyze` is one narrow stage: every task's text is parsed and resolved where it lies, and one nested
row per statement comes out.  The fact tables are projections of that row, so nothing is shuffled
until something is aggregated over the corpus; the end-to-end lineage of a statement is walked in the
same pass.  A catalogue small enough to be counted below CATALOG_COLUMNS is shipped with the task;
a larger one is joined per statement by the tables it names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomspan.functions import jsontext
from loomspan.functions.names import py_table_name, table_name
from loomspan.operators import audit as faults
from loomspan.operators import nested
from loomspan.plans import conditions
from loomspan.plans import scopes as plan
from loomspan.plans import sqlparse
from loomspan.plans import trace as walk
from loomspan.runtime import spread

#: Largest catalogue, in columns, that is shipped to every task.
CATALOG_COLUMNS = 500_000

_REF = "struct<scope:string,column:string>"
_WAY = "struct<scope:string,column:string,direction:string>"
_COLUMN = f"struct<ordinal:int,name:string,transform:string,expression:string,agg_function:string,merge_branch:string,sources:array<{_REF}>,case_branches:array<struct<when_expr:string,then_value:string>>,window:struct<partition_by:array<{_REF}>,order_by:array<{_WAY}>,function:string,frame:string>,magic_number:string,case_in_aggregate:boolean,is_constant:boolean>"
_JOIN = f"struct<join_no:int,join_type:string,left_scope:string,right_scope:string,alias_in_parent:string,condition_expression:string,condition_columns:array<{_REF}>,compares_literal:boolean,shape:string,operators:array<string>,equal:array<struct<left_scope:string,left_column:string,right_scope:string,right_column:string>>,physical:array<{_REF}>>"
_SCOPE = (
    f"struct<scope_id:string,kind:string,is_distinct:boolean,depth:int,writes_to:string,alias_in_parent:string,set_op:string,limit_text:string,grouping:string,branches:array<string>,branch_index:int,depends_on:array<string>,"
    f"reads_scopes:array<string>,inner_scopes:array<string>,columns:array<{_COLUMN}>,joins:array<{_JOIN}>,filters:array<struct<clause:string,expression:string,columns:array<{_REF}>,shape:string,filter_kind:string,operators:array<string>,physical:array<{_REF}>>>,group_by:array<{_REF}>,order_by:array<{_WAY}>,"
    f"generators:array<struct<alias:string,function:string,expression:string,output_columns:array<string>>>,order_no:int,direct_tables:array<string>,tables:array<string>>"
)
_LINEAGE = "struct<scope_id:string,name:string,merge_branch:string,sources:array<struct<scope:string,column:string,transform:string>>,complete:boolean,reasons:array<string>>"
STATEMENT = (
    f"task_id string, stmt_no int, stmt string, status string, error string, target_table string, stmt_kind string, source_tables array<string>, partition_columns array<string>, "
    f"warnings array<struct<ordinal:int,type:string,scope_id:string,msg:string>>, scopes array<{_SCOPE}>, graph_nodes array<string>, graph_edges array<struct<from_node:string,to_node:string>>, lineage array<{_LINEAGE}>, issues array<{faults.ISSUE}>"
)


def flat_columns(record: dict) -> list[tuple]:
    """Columns for the walks; a source without scope is unknown, a name that is null is ''."""
    return [(s["scope_id"], c["name"] or "", c["transform"], c["merge_branch"], [(r["scope"] or "UNKNOWN", r["column"] or "") for r in c["sources"]]) for s in record["scopes"] for c in s["columns"]]


def traced(record: dict) -> dict:
    """Adds what is walked: end-to-end lineage, the order of the scopes and the tables under each, and the
    physical columns of every condition."""
    scopes = record["scopes"]
    ids = {s["scope_id"] for s in scopes}
    columns = flat_columns(record)
    record["lineage"] = walk.end_to_end(columns, ids)
    leaves = walk.Leaves(columns, ids)
    depends = {s["scope_id"]: s["depends_on"] for s in scopes}
    order = {n: i for i, n in enumerate(walk.ordered(list(depends), [(d, s) for s, ds in depends.items() for d in ds]))}
    for s in scopes:
        s["order_no"] = order[s["scope_id"]]
        s["direct_tables"] = sorted({d for d in s["depends_on"] if d not in ids})
        s["tables"] = walk.feeding_tables(depends, s["scope_id"])
        for x, refs in [(f, f["columns"]) for f in s["filters"]] + [(j, j["condition_columns"]) for j in s["joins"]]:
            x["physical"] = [{"scope": a, "column": b} for a, b in walk.physical_refs(leaves, [(r["scope"] or "UNKNOWN", r["column"] or "") for r in refs])]
    record["issues"] = faults.issues_of(record)
    return record


def _lookup(columns: dict[str, list[str]]):
    """Names as written first, then in compared form."""
    return lambda table: columns.get(table) or columns.get(py_table_name(table))


def analyze(tasks: DataFrame, catalog: DataFrame | None = None, task: str = "task_name", sql: str = "sql") -> DataFrame:
    """One row per statement of every task (null texts are tasks without statements).  `catalog` has
    table_key, name and ordinal; the first spelling of a name in order counts."""
    source = spread(tasks).select(F.col(task).cast("string").alias("task_id"), F.col(sql).alias("sql"))
    known: dict[str, list[str]] | None = None
    if catalog is not None:
        per_table = catalog.select(table_name("table_key").alias("t"), F.lower("name").alias("c"), "ordinal").where("t is not null and c is not null").groupBy("t", "c").agg(F.min("ordinal").alias("o")).groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda x: x["c"]).alias("cs"))
        if catalog.limit(CATALOG_COLUMNS + 1).count() <= CATALOG_COLUMNS:
            known = {r["t"]: list(r["cs"]) for r in per_table.collect()}
        else:
            source = _with_schema(source, per_table)
    schema = to_arrow_schema(T.StructType.fromDDL(STATEMENT))
    joined = catalog is not None and known is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                own = batch["known"].to_pylist() if joined else None
                out = []
                for i, (name, text) in enumerate(zip(batch["task_id"].to_pylist(), batch["sql"].to_pylist(), strict=True)):
                    columns = {x["t"]: x["cs"] for x in own[i] or []} if joined else known
                    for record in plan.facts(name, text or "", None if columns is None else _lookup(columns)):
                        record["graph_edges"] = [{"from_node": d, "to_node": s["scope_id"]} for s in record["scopes"] for d in s["depends_on"]]
                        record["graph_nodes"] = sorted({*(s["scope_id"] for s in record["scopes"]), *record["source_tables"], *(e["from_node"] for e in record["graph_edges"])})
                        out.append(traced(record))
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return source.mapInArrow(run, STATEMENT)


def from_documents(deliveries: DataFrame) -> DataFrame:
    """Stored lineage documents (stmt_id, task_id, received_at, payload) as the same rows: the latest
    readable delivery of each statement.  `stmt` is the stmt_id as text; absent members are empty."""
    schema = to_arrow_schema(T.StructType.fromDDL(STATEMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                out = []
                for stmt, payload in zip(batch["stmt_id"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                    ok, document = jsontext.parse(payload)
                    if ok and isinstance(document, dict):
                        out.append(document_record(str(stmt), document))
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return nested.latest_readable(deliveries).mapInArrow(run, STATEMENT)


def _text(node: dict, member: str) -> str | None:
    return None if node.get(member) is None else jsontext.as_text(node[member])


def _members(node: dict, member: str) -> list[dict]:
    return [x for _, x in nested._entries(node.get(member))]


def _texts(value) -> list[str]:
    return [jsontext.as_text(x) for x in value if x is not None] if isinstance(value, list) else []


def document_record(stmt: str, d: dict) -> dict:
    """A lineage document in the form `analyze` gives."""
    ref = lambda x: {"scope": _text(x, "scope"), "column": _text(x, "column")}
    way = lambda x: {**ref(x), "direction": _text(x, "direction")}
    scopes = []
    given = d.get("scopes") if isinstance(d.get("scopes"), dict) else {}
    for name, s in given.items():
        if not isinstance(s, dict):
            continue
        columns = []
        for i, c in nested._entries(s.get("columns")):
            w = c.get("window") if isinstance(c.get("window"), dict) else None
            columns.append(
                {
                    "ordinal": i, "name": _text(c, "name"), "transform": _text(c, "transform"), "expression": _text(c, "expression"), "agg_function": _text(c, "agg_function"), "merge_branch": _text(c, "merge_branch"),
                    "sources": [ref(x) for x in _members(c, "sources")], "case_branches": [{"when_expr": _text(x, "when_expr"), "then_value": _text(x, "then_value")} for x in _members(c, "case_branches")],
                    "window": w and {"partition_by": [ref(x) for x in _members(w, "partition_by")], "order_by": [way(x) for x in _members(w, "order_by")], "function": None, "frame": None}, "magic_number": None, "case_in_aggregate": False,
                    "is_constant": not _members(c, "sources") and conditions.is_constant(conditions.expression(_text(c, "expression"))),
                }
            )
        said = lambda x, member: conditions.told(conditions.expression(_text(x, member)))
        joins = [{"join_no": i, "join_type": _text(j, "join_type"), "left_scope": _text(j, "left_scope"), "right_scope": _text(j, "right_scope"), "alias_in_parent": _text(j, "alias_in_parent"), "condition_expression": _text(j, "condition_expression"), "condition_columns": [ref(x) for x in _members(j, "condition_columns")], "compares_literal": False,
            **{k: v for k, v in said(j, "condition_expression").items() if k != "filter_kind"}, "equal": _equal(_text(j, "condition_expression"), [ref(x) for x in _members(j, "condition_columns")])} for i, j in nested._entries(s.get("joins"))]
        filters = [{"clause": clause, "expression": _text(f, "expression"), "columns": [ref(x) for x in _members(f, "columns")], **said(f, "expression")} for clause, member in (("WHERE", "filters"), ("HAVING", "having")) for f in _members(s, member)]
        depends = _texts(s.get("depends_on"))
        scopes.append(
            {
                "scope_id": jsontext.clean(name), "kind": _text(s, "kind"), "is_distinct": s.get("distinct") is True, "depth": None, "writes_to": _text(s, "writes_to"), "alias_in_parent": _text(s, "alias_in_parent"), "set_op": _text(s, "set_op"), "limit_text": None, "grouping": None,
                "branches": _texts(s.get("branches")), "branch_index": None, "depends_on": depends, "reads_scopes": [x for x in depends if x in given], "inner_scopes": [], "columns": columns, "joins": joins, "filters": filters,
                "group_by": [ref(x) for x in _members(s, "group_by")], "order_by": [way(x) for x in _members(s, "order_by")], "generators": [],
            }
        )
    graph = d.get("scope_graph") if isinstance(d.get("scope_graph"), dict) else {}
    diagnostics = d.get("diagnostics") if isinstance(d.get("diagnostics"), dict) else {}
    out = {
        "task_id": _text(d, "task_id"), "stmt_no": 0, "stmt": stmt, "status": "ok", "error": None, "target_table": _text(d, "target_table"), "stmt_kind": _text(d, "stmt_kind"), "source_tables": _texts(d.get("source_tables")), "partition_columns": [],
        "warnings": [{"ordinal": i, "type": _text(w, "type"), "scope_id": _text(w, "scope"), "msg": _text(w, "msg")} for i, w in nested._entries(diagnostics.get("warnings"))], "scopes": scopes,
        "graph_nodes": _texts(graph.get("nodes")), "graph_edges": [{"from_node": _text(e, "from"), "to_node": _text(e, "to")} for e in _members(graph, "edges")],
    }
    return traced(out)


def _equal(text: str | None, refs: list[dict]) -> list[dict]:
    """Columns a stored condition holds equal; a side is the first of its references with that name."""
    e = conditions.expression(text)
    if e is None:
        return []
    by: dict[str, dict] = {}
    for r in refs:
        by.setdefault((r["column"] or "").lower(), r)
    sides = [(by.get(a.parts[-1]), by.get(b.parts[-1])) for a, b in conditions.equalities(e)]
    return [{"left_scope": l["scope"], "left_column": l["column"], "right_scope": r["scope"], "right_column": r["column"]} for l, r in sides if l and r]


def _with_schema(source: DataFrame, per_table: DataFrame) -> DataFrame:
    """Each task with the catalogue entries of the tables it names, for catalogues too large to ship.
    Rows are matched by a hash of their text, which alone decides what a task names; a task_id may be null or repeated."""
    keyed = source.withColumn("text", F.sha2("sql", 256))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, seen = [], []
            for key, text in zip(batch["text"].to_pylist(), batch["sql"].to_pylist(), strict=True):
                for t in sqlparse.names(text):
                    texts.append(key)
                    seen.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(seen, pa.string())], names=["text", "t"])

    named = keyed.where("sql is not null").select("text", "sql").mapInArrow(tables, "text string, t string").distinct()
    used = named.join(per_table, "t").groupBy("text").agg(F.collect_list(F.struct("t", "cs")).alias("known"))
    return keyed.join(used, "text", "left").drop("text")


# -- fact tables --------------------------------------------------------------------------------------

_KEY = ("task_id", "stmt_no", "stmt")


def statements(a: DataFrame) -> DataFrame:
    return a.select(*_KEY, "status", "error", "target_table", "stmt_kind", "source_tables", "partition_columns", F.size("scopes").alias("n_scopes"))


def _scopes(a: DataFrame) -> DataFrame:
    return a.select(*_KEY, F.explode("scopes").alias("s"))


def _under(a: DataFrame, member: str, alias: str = "x") -> DataFrame:
    return _scopes(a).select(*_KEY, F.col("s.scope_id").alias("scope_id"), F.col("s.kind").alias("scope_kind"), F.posexplode(f"s.{member}").alias("no", alias))


def scope_facts(a: DataFrame) -> DataFrame:
    plain = ("scope_id", "kind", "is_distinct", "depth", "writes_to", "alias_in_parent", "set_op", "limit_text", "grouping", "branches", "branch_index", "depends_on")
    s = _scopes(a)
    return s.select(*_KEY, *(F.col(f"s.{c}").alias(c) for c in plain), role(F.col("s")).alias("role"))


def role(s: Column) -> Column:
    """What a scope is for: its kind for set operations, else the first that holds."""
    any_of = lambda t: F.exists(s["columns"], lambda c: c["transform"] == t)
    only = lambda *ts: (F.size(s["columns"]) > 0) & F.forall(s["columns"], lambda c: c["transform"].isin(*ts))
    return (
        F.when(s["kind"].isin("union", "union_branch"), s["kind"])
        .when(any_of("WINDOW"), "dedup")
        .when(any_of("AGGREGATE") | (F.size(s["group_by"]) > 0), "aggregate")
        .when(F.size(s["joins"]) > 0, "join")
        .when(F.size(s["filters"]) > 0, "filter")
        .when(only("CONSTANT"), "label")
        .when(only("DIRECT", "CONSTANT"), "pass_through")
        .otherwise("transform")
    )


def column_facts(a: DataFrame) -> DataFrame:
    plain = ("ordinal", "name", "transform", "expression", "agg_function", "merge_branch", "magic_number", "case_in_aggregate")
    return _under(a, "columns").select(*_KEY, "scope_id", *(F.col(f"x.{c}").alias(c) for c in plain), F.size("x.sources").alias("n_sources"))


def edge_facts(a: DataFrame) -> DataFrame:
    """One row per source of a column."""
    c = _under(a, "columns").select(*_KEY, F.col("scope_id").alias("to_scope"), F.col("x.ordinal").alias("to_ordinal"), F.col("x.name").alias("to_column"), F.col("x.transform").alias("transform"), F.col("x.merge_branch").alias("merge_branch"), F.posexplode("x.sources").alias("edge_ordinal", "r"))
    return c.select(*_KEY, "to_scope", "to_ordinal", "to_column", F.col("r.scope").alias("from_scope"), F.col("r.column").alias("from_column"), "transform", "merge_branch", "edge_ordinal")


def join_facts(a: DataFrame) -> DataFrame:
    plain = ("join_no", "join_type", "left_scope", "right_scope", "alias_in_parent", "condition_expression", "compares_literal")
    return _under(a, "joins").select(*_KEY, "scope_id", *(F.col(f"x.{c}").alias(c) for c in plain), refs_text("x.condition_columns").alias("condition_columns"))


def refs_text(c: str | Column) -> Column:
    """References as text, scope.column joined by commas."""
    return F.concat_ws(",", F.transform(c, lambda r: F.concat_ws(".", r["scope"], r["column"])))


def filter_facts(a: DataFrame) -> DataFrame:
    return _under(a, "filters").select(*_KEY, "scope_id", "no", F.col("x.clause").alias("clause"), F.col("x.expression").alias("expression"), refs_text("x.columns").alias("columns"))


def grouping_facts(a: DataFrame) -> DataFrame:
    return _under(a, "group_by").select(*_KEY, "scope_id", "no", F.col("x.scope").alias("from_scope"), F.col("x.column").alias("from_column"))


def ordering_facts(a: DataFrame) -> DataFrame:
    return _under(a, "order_by").select(*_KEY, "scope_id", "no", F.col("x.scope").alias("from_scope"), F.col("x.column").alias("from_column"), F.col("x.direction").alias("direction"))


def generator_facts(a: DataFrame) -> DataFrame:
    return _under(a, "generators").select(*_KEY, "scope_id", F.col("x.alias").alias("alias"), F.col("x.function").alias("function"), F.col("x.expression").alias("expression"), F.concat_ws(",", "x.output_columns").alias("output_columns"))


def case_facts(a: DataFrame) -> DataFrame:
    c = _under(a, "columns").select(*_KEY, "scope_id", F.col("x.name").alias("name"), F.posexplode("x.case_branches").alias("branch_no", "b"))
    return c.select(*_KEY, "scope_id", "name", "branch_no", F.col("b.when_expr").alias("when_expr"), F.col("b.then_value").alias("then_value"))


def window_facts(a: DataFrame) -> DataFrame:
    c = _under(a, "columns").where("x.window is not null")
    order = F.concat_ws(",", F.transform("x.window.order_by", lambda r: F.concat(r["scope"], F.lit("."), r["column"], F.lit(" "), r["direction"])))
    return c.select(*_KEY, "scope_id", F.col("x.name").alias("name"), F.col("x.window.function").alias("function"), refs_text("x.window.partition_by").alias("partition_by"), order.alias("order_by"), F.col("x.window.frame").alias("frame"))


def graph_edges(a: DataFrame) -> DataFrame:
    """What feeds a scope: every scope or table it depends on."""
    return _under(a, "depends_on").select(*_KEY, F.col("x").alias("from_node"), F.col("scope_id").alias("to_node"))


def warning_facts(a: DataFrame) -> DataFrame:
    """Warnings raised while resolving, and those of the four detectors."""
    return a.select(*_KEY, F.explode("warnings").alias("w")).select(*_KEY, F.col("w.type").alias("type"), F.col("w.scope_id").alias("scope_id"), F.col("w.msg").alias("msg"))


def scope_order(a: DataFrame) -> DataFrame:
    """Scopes in the order in which they can be computed, with the tables each reads itself and all under it."""
    s = _scopes(a.where("status = 'ok'"))
    return s.select(*_KEY, F.col("s.scope_id").alias("scope_id"), F.col("s.order_no").alias("order_no"), F.concat_ws(",", "s.direct_tables").alias("direct_tables"), F.concat_ws(",", "s.tables").alias("tables"))


def equal_columns(a: DataFrame) -> DataFrame:
    """Pairs of columns that a join holds equal."""
    e = _under(a, "joins").select(*_KEY, "scope_id", F.col("x.join_no").alias("join_no"), F.explode("x.equal").alias("e"))
    return e.select(*_KEY, "scope_id", "join_no", F.concat_ws(".", "e.left_scope", "e.left_column").alias("left_key"), F.concat_ws(".", "e.right_scope", "e.right_column").alias("right_key"))


def first_statements(a: DataFrame) -> DataFrame:
    """Of each task its first statement alone; a task without any gives none."""
    return a.where("stmt_no = 0 and status in ('ok', 'error')")


def stats(a: DataFrame) -> DataFrame:
    """The eleven counters of a statement, without a shuffle."""
    n_kind = lambda k: F.size(F.filter("scopes", lambda s: s["kind"] == k))
    every = F.flatten(F.transform("scopes", lambda s: s["columns"]))
    n_transform = lambda t: F.size(F.filter(F.col("cols"), lambda c: c["transform"] == t))
    named = F.transform("scopes", lambda s: s["scope_id"])
    sides = F.flatten(F.transform("scopes", lambda s: F.flatten(F.transform(s["joins"], lambda j: F.array(j["left_scope"], j["right_scope"])))))
    from_columns = F.flatten(F.transform(every, lambda c: F.transform(c["sources"], lambda r: r["scope"])))
    physical = F.array_except(F.array_compact(F.array_distinct(F.concat(from_columns, sides))), F.concat(named, F.array(*map(F.lit, walk.LEAVES))))
    out = a.where("status = 'ok'").select(*_KEY, "scopes", every.alias("cols"), F.size(physical).alias("physical_table_count"))
    return out.select(
        *_KEY, (F.size("scopes") + F.col("physical_table_count")).alias("scope_count"), "physical_table_count", n_kind("cte").alias("cte_count"), n_kind("subquery").alias("subquery_count"), n_kind("union").alias("union_count"),
        n_kind("union_branch").alias("union_branch_count"), F.array_max(F.transform("scopes", lambda s: s["depth"])).alias("max_depth"), n_transform("CONDITIONAL").alias("case_when_count"), n_transform("WINDOW").alias("window_function_count"),
        F.aggregate("scopes", F.lit(0), lambda n, s: n + F.size(s["joins"])).alias("join_count"), n_transform("AGGREGATE").alias("aggregate_function_count"),
    )


def end_to_end(a: DataFrame) -> DataFrame:
    """Root columns with their physical sources, one row each; a column without any has nulls."""
    l = a.select(*_KEY, "target_table", F.posexplode("lineage").alias("ordinal", "l"))
    l = l.select(*_KEY, "target_table", "ordinal", F.col("l.name").alias("name"), F.col("l.merge_branch").alias("merge_branch"), F.col("l.complete").alias("complete"), F.concat_ws(",", "l.reasons").alias("reasons"), F.explode_outer("l.sources").alias("r"))
    return l.select(*_KEY, "target_table", "ordinal", "name", "merge_branch", F.col("r.scope").alias("source_table"), F.col("r.column").alias("source_column"), F.col("r.transform").alias("transform"), "complete", "reasons")


def cross_reference_errors(a: DataFrame) -> DataFrame:
    """Sources and graph ends that are neither a scope, a table of the statement nor a pseudo source."""
    ok = F.concat(F.transform("scopes", lambda s: s["scope_id"]), "source_tables", F.array(*map(F.lit, walk.LEAVES)), F.array("target_table"))
    named = F.concat(
        F.flatten(F.transform("scopes", lambda s: F.flatten(F.transform(s["columns"], lambda c: F.transform(c["sources"], lambda r: F.struct(s["scope_id"].alias("scope_id"), r["scope"].alias("ref"))))))),
        F.flatten(F.transform("scopes", lambda s: F.transform(s["depends_on"], lambda d: F.struct(s["scope_id"].alias("scope_id"), d.alias("ref"))))),
    )
    r = a.where("status = 'ok'").select(*_KEY, ok.alias("ok"), F.explode(F.array_distinct(named)).alias("n"))
    return r.where(~F.array_contains("ok", F.col("n.ref"))).select(*_KEY, F.col("n.scope_id").alias("scope_id"), F.col("n.ref").alias("unknown_ref"))


# -- metadata -----------------------------------------------------------------------------------------


def used_columns(a: DataFrame) -> DataFrame:
    """Every reference a statement makes to a physical table, once: table, column."""
    refs = lambda s: F.concat(F.flatten(F.transform(s["columns"], lambda c: c["sources"])), F.flatten(F.transform(s["joins"], lambda j: j["condition_columns"])), F.flatten(F.transform(s["filters"], lambda f: f["columns"])), s["group_by"], F.transform(s["order_by"], lambda o: F.struct(o["scope"].alias("scope"), o["column"].alias("column"))))
    every = F.array_distinct(F.flatten(F.transform("scopes", refs)))
    r = a.where("status = 'ok'").select(*_KEY, "source_tables", F.explode(every).alias("r"))
    return r.where(F.array_contains("source_tables", F.col("r.scope"))).select(*_KEY, F.col("r.scope").alias("table_name"), F.col("r.column").alias("column_name"))


def _latest(c: str) -> Column:
    """The value of the last entry that has one, by ordinal, then the greatest."""
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("ordinal", c))).alias(c)


def input_metadata(a: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue columns of the source tables that a statement uses: all of a table of which `*` is
    used, all of every source table if anything is UNKNOWN, else those named; tables without entry give the
    names inferred from their use, with metadata_complete false."""
    c = catalog.select(table_name("table_key").alias("t"), F.lower("name").alias("c"), "ordinal", "type", "comment").groupBy("t", "c").agg(F.min("ordinal").alias("ordinal"), _latest("type"), _latest("comment"))
    unknown = F.exists("scopes", lambda s: F.exists(s["columns"], lambda x: F.exists(x["sources"], lambda r: r["scope"] == "UNKNOWN")))
    per = a.where("status = 'ok'").select(*_KEY, unknown.alias("unknown"), F.explode("source_tables").alias("table_name"))
    use = used_columns(a).groupBy(*_KEY, "table_name").agg(F.collect_set("column_name").alias("used"))
    u = per.join(use, [*_KEY, "table_name"], "left").select(*_KEY, "table_name", "unknown", F.coalesce("used", F.array().cast("array<string>")).alias("used"), table_name("table_name").alias("t"))
    kept = F.col("unknown") | F.array_contains("used", F.lit("*")) | F.array_contains("used", F.col("c"))
    known = u.join(c, "t").where(kept).select(*_KEY, "table_name", F.col("c").alias("column_name"), "ordinal", "type", "comment", F.lit(True).alias("metadata_complete"))
    bare = u.join(c.select("t").distinct(), "t", "left_anti").select(*_KEY, "table_name", F.explode("used").alias("column_name"))
    return known.unionByName(bare.select(*_KEY, "table_name", "column_name", F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("comment"), F.lit(False).alias("metadata_complete")))


def output_metadata(a: DataFrame, catalog: DataFrame) -> DataFrame:
    """The target's columns: catalogue entries among the root's names, else the root's names."""
    root = column_facts(a).where("scope_id = 'ROOT'").groupBy(*_KEY, "name").agg(F.min("ordinal").alias("root_ordinal"))
    out = root.join(a.select(*_KEY, "target_table"), list(_KEY)).withColumn("t", table_name("target_table"))
    c = catalog.select(table_name("table_key").alias("t"), F.lower("name").alias("name"), "ordinal", "type", "comment").groupBy("t", "name").agg(F.min("ordinal").alias("ordinal"), _latest("type"), _latest("comment"))
    there = c.select("t").distinct().withColumn("listed", F.lit(True))
    j = out.join(c, ["t", "name"], "left").join(there, "t", "left")
    return j.where("listed is null or ordinal is not null").select(*_KEY, "target_table", F.col("name").alias("column_name"), F.coalesce("ordinal", "root_ordinal").alias("ordinal"), "type", "comment", F.coalesce("listed", F.lit(False)).alias("metadata_complete"))
