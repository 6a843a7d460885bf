"""Sinks: fact stores in Parquet, artifacts as JSON lines or one folder per statement, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import render
from loomspan.operators import audit, contract, lineage, profile
from loomspan.plans import trace as walk

FACTS = {
    "statements": lineage.statements, "scopes": lineage.scope_facts, "columns": lineage.column_facts, "edges": lineage.edge_facts, "joins": lineage.join_facts, "filters": lineage.filter_facts, "groupings": lineage.grouping_facts,
    "orderings": lineage.ordering_facts, "generators": lineage.generator_facts, "case_branches": lineage.case_facts, "windows": lineage.window_facts, "graph_edges": lineage.graph_edges, "warnings": lineage.warning_facts, "end_to_end": lineage.end_to_end,
}


def write_facts(analysed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The nested rows once, then every fact table from what was written, so statements are parsed
    only once."""
    analysed.write.mode(mode).parquet(f"{path}/analysed")
    stored = analysed.sparkSession.read.parquet(f"{path}/analysed")
    for name, facts in FACTS.items():
        facts(stored).write.mode(mode).parquet(f"{path}/{name}")


def lineage_json(analysed: DataFrame) -> DataFrame:
    """One lineage document per statement, members that are null left out."""
    members = ("task_id", "stmt", "target_table", "stmt_kind", "source_tables", "partition_columns")
    scopes = F.map_from_entries(F.transform("scopes", lambda s: F.struct(s["scope_id"], s)))
    graph = F.struct(F.col("graph_nodes").alias("nodes"), F.transform("graph_edges", lambda e: F.struct(e["from_node"].alias("from"), e["to_node"].alias("to"))).alias("edges"))
    return analysed.where("status = 'ok'").select("task_id", "stmt", F.to_json(F.struct(*members, graph.alias("scope_graph"), scopes.alias("scopes"), F.struct(F.col("warnings")).alias("diagnostics"))).alias("lineage"))


def write_artifacts(analysed: DataFrame, path: str) -> None:
    """Lineage and profile documents in bulk, as JSON lines in one folder per kind."""
    lineage_json(analysed).write.mode("overwrite").json(f"{path}/lineage")
    profile.profiles(analysed).write.mode("overwrite").json(f"{path}/profile")
    audit.audit(analysed).write.mode("overwrite").json(f"{path}/audit")


def _kept(value, member: str = ""):
    """A value without null members and empty lists, but for the lists a document must have."""
    if isinstance(value, dict):
        return {k: v for k, x in value.items() if (v := _kept(x, k)) is not None and (v != [] or k in ("columns", "depends_on", "sources", "nodes", "edges"))}
    return [_kept(x, member) for x in value] if isinstance(value, list) else value


def document(d: dict) -> dict:
    """A statement row as a lineage document."""
    out = {k: d[k] for k in ("task_id", "target_table", "stmt_kind", "source_tables", "partition_columns")}
    out["end_to_end_lineage"] = [{"column": l["name"], "merge_branch": l["merge_branch"], "trace_complete": l["complete"], "trace_incomplete_reasons": l["reasons"], "physical_sources": [{"table": s["scope"], "column": s["column"], "transform": s["transform"]} for s in l["sources"]]} for l in d["lineage"]]
    out["scope_graph"] = {"nodes": d["graph_nodes"], "edges": [{"from": e["from_node"], "to": e["to_node"]} for e in d["graph_edges"]]}
    walked = ("scope_id", "order_no", "direct_tables", "tables", "reads_scopes", "inner_scopes")
    out["scopes"] = {s["scope_id"]: {"distinct" if k == "is_distinct" else k: v for k, v in s.items() if k not in walked} for s in d["scopes"]}
    return _kept(out)


def write_statement(row, folder: str, profile_text: str | None = None) -> list[str]:
    """The files of one statement row: lineage.json, profile.json if given, diagnostics.json and its
    views.  Raises ValueError if the document breaks its contract or a reference leads nowhere, naming up to five."""
    d = row.asDict(recursive=True)
    own = document(d)
    bad = [f"{place}: {rule}" for place, rule in contract.breaks(own, contract.rules())]
    if bad:
        raise ValueError("broken contract: " + "; ".join(bad[:5]))
    bad = dangling(d)
    if bad:
        raise ValueError("unknown references: " + "; ".join(bad[:5]))
    out = Path(folder)
    (out / "views" / "per_column").mkdir(parents=True, exist_ok=True)
    files = {"lineage.json": json.dumps(own, ensure_ascii=False, indent=2), **({"profile.json": profile_text} if profile_text else {}), "diagnostics.json": json.dumps({"warnings": d["warnings"]}, ensure_ascii=False), **{f"views/{k}": v for k, v in render.views(d).items()}}
    for name, text in files.items():
        (out / name).write_text(text, encoding="utf-8")
    return sorted(files)


def run_task(spark: SparkSession, task: dict, folder: str) -> dict:
    """Analyses one task, {"task_name", "sql"}, and writes its statements, in folders of their own if there are
    several.  Never raises: what went wrong is told in the result, which is a success if anything was written."""
    if not isinstance(task, dict) or not str(task.get("sql") or "").strip():
        return {"success": False, "error": "no sql", "statements": []}
    named = spark.createDataFrame([(task.get("task_name"), task["sql"])], "task_name string, sql string")
    rows = lineage.analyze(named).where("status in ('ok', 'error')").collect()  # the statements of one task
    profiles = {r["stmt_no"]: r["profile"] for r in profile.profiles(lineage.analyze(named)).collect()}
    done, errors = [], []
    for r in rows:
        try:
            if r["status"] != "ok":
                raise ValueError(r["error"])
            write_statement(r, str(Path(folder) / (str(r["stmt_no"]) if len(rows) > 1 else "")), profiles.get(r["stmt_no"]))
            done.append(r["stmt"])
        except ValueError as e:
            errors.append(f"{r['stmt']}: {e}")
    return {"success": bool(done), "error": "; ".join(errors) or (None if rows else "no statement"), "statements": done}


def dangling(d: dict) -> list[str]:
    """References of a statement that are neither scope, table nor pseudo source."""
    known = {s["scope_id"] for s in d["scopes"]} | set(d["graph_nodes"]) | set(walk.LEAVES)
    return [f"{s['scope_id']}.{c['name']} -> {r['scope']}" for s in d["scopes"] for c in s["columns"] for r in c["sources"] if r["scope"] not in known]


def write_html(row, path: str) -> None:
    Path(path).write_text(render.html(row.asDict(recursive=True)), encoding="utf-8")
