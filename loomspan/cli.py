"""Command line: parse, corpus, insight, audit and compare."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomspan.functions import render
from loomspan.operators import audit, diff, insight, lineage, profile
from loomspan.sources import readers, sinks


def _session() -> SparkSession:
    return SparkSession.builder.appName("loomspan").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomspan")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("parse", help="analyse one SQL file")
    one.add_argument("--sql-file", required=True)
    one.add_argument("--task-name")
    one.add_argument("--html", action="store_true")
    many = sub.add_parser("corpus", help="analyse a folder of task JSON files")
    many.add_argument("--input", required=True)
    look = sub.add_parser("insight", help="objects and links of stored statements")
    look.add_argument("--input", required=True)
    check = sub.add_parser("audit", help="severity and issues of stored statements")
    check.add_argument("--input", required=True)
    check.add_argument("--fail-on-red", action="store_true")
    check.add_argument("--fail-on-warning", action="store_true")
    check.add_argument("--markdown", help="write a report to this file")
    check.add_argument("--top", type=int, default=25, help="statements listed in the report")
    for s in (one, many):
        s.add_argument("--schema-file")
    for s in (one, many, look, check):
        s.add_argument("--output", required=True)
    two = sub.add_parser("compare", help="compare two stored outputs (Parquet of statement, path, severity, root_cols, body, written_at)")
    two.add_argument("--left", required=True)
    two.add_argument("--right", required=True)
    two.add_argument("--fail-on-diff", action="store_true")
    args = p.parse_args(argv)
    spark = _session()
    if args.command == "compare":
        counts = {f"{r['kind']} {r['field']}".strip(): r["n_cells"] for r in diff.summary(spark.read.parquet(args.left), spark.read.parquet(args.right)).collect()}
        print(json.dumps(counts, indent=2, sort_keys=True))
        return int(bool(counts) and args.fail_on_diff)
    if args.command in ("insight", "audit"):
        stored = spark.read.parquet(f"{args.input}/analysed")
        if args.command == "insight":
            insight.objects(stored).write.mode("overwrite").json(f"{args.output}/objects")
            insight.links(stored).write.mode("overwrite").json(f"{args.output}/links")
            return 0
        done = audit.audit(stored)
        done.write.mode("overwrite").json(args.output)
        counts = {r["severity"]: r["n_statements"] for r in audit.severity_counts(done).collect()}
        print(json.dumps(counts, sort_keys=True))
        if args.markdown:
            done = spark.read.schema(done.schema).json(args.output)
            issues = [tuple(r) for r in audit.issue_counts(done).orderBy("issue").collect()]  # a row a kind
            reds = [tuple(r) for r in audit.red_statements(done).orderBy("stmt").limit(args.top).collect()]
            risky = [tuple(r) for r in audit.risky_statements(done, args.top).collect()]
            Path(args.markdown).write_text(render.audit_markdown("Audit", counts, issues, reds, risky), encoding="utf-8")
        return int(args.fail_on_red and counts.get("RED", 0) > 0 or args.fail_on_warning and counts.get("YELLOW", 0) > 0)
    catalog = readers.column_metadata(spark, args.schema_file) if args.schema_file else None
    if args.command == "corpus":
        tasks = readers.task_directory(spark, args.input)
        print(json.dumps(readers.corpus_status(tasks).first().asDict(), default=str))
        sinks.write_facts(lineage.analyze(tasks.where("status = 'ok'"), catalog), args.output)
        tasks.where("status = 'error'").write.mode("overwrite").json(f"{args.output}/errors")
        return 0
    tasks = readers.sql_files(spark, args.sql_file)
    if args.task_name:
        tasks = tasks.withColumn("task_name", F.lit(args.task_name))
    rows = lineage.analyze(tasks, catalog).where("status <> 'other'").collect()  # the statements of one file
    profiles = {r["stmt"]: r["profile"] for r in profile.profiles(lineage.analyze(tasks, catalog)).collect()}
    good = [r for r in rows if r["status"] == "ok"]
    for r in good:
        folder = Path(args.output) / (f"{r['task_id']}_{r['stmt_no']}" if len(rows) > 1 else "")
        sinks.write_statement(r, str(folder), profiles.get(r["stmt"]))
        if args.html:
            sinks.write_html(r, str(folder / "report.html"))
    for r in rows:
        if r["status"] != "ok":
            print(f"{r['stmt']}: {r['error']}", file=sys.stderr)
    return int(not good)


if __name__ == "__main__":
    sys.exit(main())
