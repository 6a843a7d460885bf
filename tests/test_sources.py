"""Sources, sinks, rendering, streaming and the command line."""

import json
from datetime import datetime

import pytest

from loomspan import cli
from loomspan.functions import render
from loomspan.operators import insight, lineage, profile
from loomspan.sources import readers, sinks
from loomspan.streaming import watch

SQL = "insert into a.b select c.d, count(*) n from e.f c group by c.d"


@pytest.fixture
def tasks(tmp_path):
    folder = tmp_path / "tasks"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"task_name": "x", "sql": SQL}))
    (folder / "2.json").write_text('{"bad')
    (folder / "3.json").write_text(json.dumps({"sql": " "}))
    return str(folder)


def test_task_directory(spark, tasks):
    rows = {r["task_name"]: r["status"] for r in readers.task_directory(spark, tasks).collect()}
    assert rows == {"x": "ok", "2": "error", "3": "empty"}
    assert readers.corpus_status(readers.task_directory(spark, tasks)).first()["success_rate"] == 0.5


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("a.csv", "﻿table_name,column_name,data_type,column_comment\nDB.`T`,a,int,hi\nDB.`T`,b,string,\n"),
        ("a.json", '{"DB.T": ["a", "b"]}'),
        ("b.json", '{"DB.T": [{"name": "a", "type": "int"}, {"column_name": "b"}]}'),
        ("c.json", '{"DB.T": {"column_details": [{"name": "a"}, {"name": "b"}]}}'),
        ("d.json", '[{"table_name": "DB.T", "column_name": "a"}, {"table_name": "DB.T", "column_name": "b"}]'),
        ("e.json", '{"tables": [{"table_name": "DB.T", "columns": [{"name": "a"}, "b"]}]}'),
    ],
)
def test_column_metadata_shapes(spark, tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    got = readers.normalized_catalog(readers.column_metadata(spark, str(path)))
    assert sorted((r["table_key"], r["ordinal"], r["name"]) for r in got.collect()) == [("db.t", 0, "a"), ("db.t", 1, "b")]


def test_metadata_suffix_and_tables(spark, tmp_path):
    with pytest.raises(ValueError, match="csv or .json"):
        readers.column_metadata(spark, "x.txt")
    path = tmp_path / "t.csv"
    path.write_text("table_name,table_name_cn,table_desc,layer\ndb.t,eins,zwei,ods\n")
    t = readers.table_metadata(spark, str(path))
    c = spark.createDataFrame([("lake.DB.T", 0, "a", None, None)], readers.CATALOG)
    assert readers.attach_tables(c, t).first()["table_desc"] == "zwei"


def test_spark_catalog(spark):
    spark.range(1).createOrReplaceTempView("known_view")
    assert [r["name"] for r in readers.spark_catalog(spark, ["known_view", "unknown_view"]).collect()] == ["id"]


def test_large_catalogue_is_joined(spark, monkeypatch):
    t = spark.createDataFrame([("x", "insert into a.b select * from DB.t"), ("y", None)], "task_name string, sql string")
    c = spark.createDataFrame([("db.t", 0, "p"), ("db.t", 1, "q")], "table_key string, ordinal int, name string")
    small = {r["stmt"]: r["scopes"] for r in lineage.analyze(t, c).collect()}
    monkeypatch.setattr(lineage, "CATALOG_COLUMNS", 1)
    large = {r["stmt"]: r["scopes"] for r in lineage.analyze(t, c).collect()}
    assert small == large
    assert [x["name"] for x in large["x"][0]["columns"]] == ["p", "q"]


def test_fact_store_and_artifacts(spark, tasks, tmp_path):
    a = lineage.analyze(readers.task_directory(spark, tasks).where("status = 'ok'"))
    sinks.write_facts(a, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store" / "edges")).count() == 2
    sinks.write_artifacts(a, str(tmp_path / "art"))
    doc = json.loads(spark.read.json(str(tmp_path / "art" / "lineage")).first()["lineage"])
    assert doc["scopes"]["ROOT"]["group_by"] == [{"scope": "e.f", "column": "d"}]
    back = lineage.from_documents(spark.createDataFrame([(1, None, json.dumps(doc))], "stmt_id bigint, received_at timestamp, payload string"))
    assert [tuple(r) for r in lineage.end_to_end(back).select("name", "source_table", "transform").collect()] == [("d", "e.f", "DIRECT"), ("n", "e.f", "AGGREGATE")]


def test_views_and_dangling_references(spark, tasks, tmp_path):
    row = lineage.analyze(readers.task_directory(spark, tasks).where("status = 'ok'")).first()
    files = sinks.write_statement(row, str(tmp_path / "out"))
    assert "views/per_column/n.mmd" in files
    d = row.asDict(recursive=True)
    assert "-->|AGGREGATE|" in render.physical_lineage(d)
    assert "<script" in render.html(d) and "http" not in render.html(d)
    assert render.safe_id("--") != "__"
    d["scopes"][0]["columns"][0]["sources"] = [{"scope": "nowhere", "column": "x"}]
    assert sinks.dangling(d) == ["ROOT.d -> nowhere"]


def test_profile_budget(spark):
    wide = ", ".join(f"case when a.c{i} > {i} then 'abcdefghij' else a.d{i} end as column_number_{i}" for i in range(900))
    a = lineage.analyze(spark.createDataFrame([("w", f"insert into d.t select {wide} from s.a a")], "task_name string, sql string"))
    r = profile.profiles(a).first()
    assert r["bytes"] <= profile.BUDGET
    assert json.loads(r["profile"])["column_count"] == 900


def test_document_findings(spark, tasks):
    p = profile.profiles(lineage.analyze(readers.task_directory(spark, tasks).where("status = 'ok'")))
    good = "\n".join(f"# L{i} x" for i in range(1, 6)) + "\na.b has d and n; schema is incomplete"
    docs = spark.createDataFrame([("x", good)], "stmt string, text string")
    assert insight.document_findings(p, docs).count() == 0
    assert insight.document_findings(p, docs.withColumn("text", docs.text.substr(1, 5))).count() > 3


def test_stream(spark, tasks, tmp_path):
    q = watch.store(watch.analysed_stream(spark, tasks), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert [r["stmt"] for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["x"]


def test_stream_of_orphan_references(spark, tmp_path):
    at = lambda d: datetime(2025, 1, d)
    columns = "edge_id bigint, stmt_id bigint, from_scope string, from_column string, seen_at timestamp"
    rows = [(1, 1, "db.t", "a", at(2)), (1, 1, "db.t", "a", at(2)), (2, 1, "x.db.T", "`A`", at(4)), (3, 1, "db.t", "b", at(2)), (4, 1, "cte:c", "b", at(2)), (5, 1, "CONSTANT", "1", at(2)), (6, 1, "db.t", "a", at(1)), (9, 1, "db.t", "zz", at(20))]
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / "e"))
    catalog = spark.createDataFrame([("db.t", "a", at(2), at(4))], "table_key string, name string, created_at timestamp, deleted_at timestamp")
    stream = spark.readStream.schema(columns).parquet(str(tmp_path / "e"))
    q = watch.orphan_references(stream, catalog).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.schema("window_start timestamp, table_name string, reason string, n_edges bigint").parquet(str(tmp_path / "o")).collect()
    assert sorted((r["reason"], r["n_edges"]) for r in got) == [("deleted", 1), ("late", 1), ("missing", 1)]


def test_running_severity(spark, tasks, tmp_path):
    watch.running_severity(watch.analysed_stream(spark, tasks), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("YELLOW", 1, 2)]  # count(*) leaves a star


def test_one_task(spark, tmp_path):
    good = sinks.run_task(spark, {"task_name": "x", "sql": SQL + "; insert into"}, str(tmp_path / "x"))
    assert good["success"] and good["statements"] == ["x#0"] and "x#1" in good["error"]
    assert (tmp_path / "x" / "0" / "profile.json").exists()
    assert sinks.run_task(spark, {"sql": " "}, str(tmp_path / "y")) == {"success": False, "error": "no sql", "statements": []}
    assert not sinks.run_task(spark, {"task_name": "z", "sql": "insert into"}, str(tmp_path / "z"))["success"]


def test_command_line(spark, tasks, tmp_path, capsys):
    sql = tmp_path / "q.sql"
    sql.write_text(f"{SQL};\n{SQL} having count(*) > 1")
    assert cli.main(["parse", "--sql-file", str(sql), "--output", str(tmp_path / "p"), "--html"]) == 0
    assert (tmp_path / "p" / "q_1" / "report.html").exists()
    assert cli.main(["corpus", "--input", tasks, "--output", str(tmp_path / "s")]) == 0
    assert cli.main(["audit", "--input", str(tmp_path / "s"), "--output", str(tmp_path / "a"), "--fail-on-red", "--markdown", str(tmp_path / "a.md")]) == 0
    assert "0.0% of 1 statements are red" in (tmp_path / "a.md").read_text()
    assert cli.main(["insight", "--input", str(tmp_path / "s"), "--output", str(tmp_path / "i")]) == 0
    sql.write_text("insert into")
    assert cli.main(["parse", "--sql-file", str(sql), "--output", str(tmp_path / "bad")]) == 1


def test_both_ways_of_a_catalogue_agree(spark, monkeypatch):
    c = spark.createDataFrame([("orders", 0, "o"), ("dw.a", 0, "x"), ("dw.a", 1, "y"), ("dw.b", 0, "z")], "table_key string, ordinal int, name string")
    texts = {
        "select * from orders": ["o"],
        "select * from dw.a,dw.b": ["x", "y", "z"],
        "select * from (select * from dw.a)t": ["x", "y"],
        "select * from lake.DW . `A`/*x*/": ["x", "y"],
        "select * from `dw.b`": ["z"],
        "select z from orders,dw.b where'1'=z": ["z"],
    }
    tasks = spark.createDataFrame([(name, f"insert into m.t {sql}") for sql in texts for name in (None, "same")] + [("same", None)], "task_name string, sql string")
    roots = lambda: sorted((r["stmt"] or "", str([(x["name"], x["sources"]) for s in r["scopes"] if s["scope_id"] == "ROOT" for x in s["columns"]]), str(r["lineage"])) for r in lineage.analyze(tasks, c).collect())
    small = roots()
    assert len(small) == 2 * len(texts) + 1
    monkeypatch.setattr(lineage, "CATALOG_COLUMNS", 1)
    assert roots() == small
    for sql, names in texts.items():
        own = lineage.analyze(spark.createDataFrame([("k", f"insert into m.t {sql}")], "task_name string, sql string"), c).first()
        assert [x["name"] for s in own["scopes"] if s["scope_id"] == "ROOT" for x in s["columns"]] == names
