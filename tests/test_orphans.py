import random
from datetime import datetime

from pyspark.sql import functions as F

from loomspan.operators import orphans

EDGES = "edge_id bigint, stmt_id bigint, task_id string, to_scope string, to_column string, from_scope string, from_column string, edge_ordinal int, transform string, seen_at timestamp, loaded_at timestamp"
CATALOG = "table_key string, ordinal int, name string, type string, comment string, created_at timestamp, deleted_at timestamp"
AUDITS = "audit_id bigint, issues map<string,int>, audited_at timestamp"
KINDS = "issue_code string, grade string, added_at timestamp, retired_at timestamp"
D = lambda m, d=1: datetime(2025, m, d)


def edge(i, to, source, at, stmt=1):
    return (i, stmt, "t", *to, *source, 0, "DIRECT", at, at)


def found(spark, edges, catalog=(), audits=(), kinds=()):
    f = orphans.found(spark.createDataFrame(list(edges), EDGES), spark.createDataFrame(list(catalog), CATALOG), spark.createDataFrame(list(audits), AUDITS), spark.createDataFrame(list(kinds), KINDS))
    return sorted(tuple(r) for r in f.collect())


CAT = [("db.t", 0, "a", None, None, D(1), D(3)), ("db.t", 0, "a", None, None, D(6), None)]


def test_reasons_and_spellings(spark):
    edges = [
        edge(1, ("ROOT", "x"), ("lake.`DB`.T ", " A"), D(2)),
        edge(2, ("ROOT", "x"), ("db.t", "a"), D(3)),
        edge(3, ("ROOT", "x"), ("db.t", "a"), D(6)),
        edge(4, ("ROOT", "x"), ("db.t", "a"), datetime(2024, 12, 1)),
        edge(5, ("ROOT", "x"), ("db.t", "gone"), D(2)),
        edge(6, ("ROOT", "x"), ("db.t", "`*`"), D(2)),
        edge(7, ("ROOT", "x"), ("CONSTANT", "1"), D(2)),
        edge(8, ("ROOT", "x"), (None, None), D(2)),
        edge(9, ("ROOT", "y"), ("cte:a", "k"), D(2)),
        edge(10, ("cte:a", "K"), ("ROOT", "x"), D(2)),
        edge(11, ("ROOT", "y"), ("db.t", None), None),
        edge(12, ("ROOT", "x"), ("db.t", "*"), D(2)),
        edge(13, ("ROOT", "x"), ("`System`", "now"), D(2)),
        edge(14, ("ROOT", "x"), (" ROOT", "x"), D(2)),
    ]
    assert found(spark, edges * 2, CAT) == [
        ("column_edges", 2, "db.t|a", "deleted", "2025-03"),
        ("column_edges", 4, "db.t|a", "late", "2024-12"),
        ("column_edges", 5, "db.t|gone", "missing", "2025-02"),
        ("column_edges", 6, "db.t|*", "missing", "2025-02"),
        ("column_edges", 9, "cte:a|k", "missing", "2025-02"),
        ("column_edges", 11, "db.t|", "missing", None),
        ("column_edges", 13, "system|now", "missing", "2025-02"),
        ("column_edges", 14, "root|x", "missing", "2025-02"),
    ]


def test_issue_codes(spark):
    audits = [(1, {"A": 1, " `a`": 2, "b": 1}, D(2)), (1, {"A": 1, " `a`": 2, "b": 1}, D(2)), (2, None, D(2)), (3, {}, D(2))]
    assert found(spark, [], [], audits, [("a", None, D(3), None)]) == [("audit_records", 1, "a", "late", "2025-02"), ("audit_records", 1, "b", "missing", "2025-02")]


def test_empty(spark):
    assert found(spark, []) == []


def test_cascade_matches_in_both_ways(spark):
    chain = [edge(0, ("s:0", "c"), ("db.none", "c"), D(1))] + [edge(i, (f"s:{i}", "c"), (f"s:{i - 1}", "c"), D(1)) for i in range(1, 9)]
    loop = [edge(20, ("p:1", "c"), ("p:2", "c"), D(1), 2), edge(21, ("p:2", "c"), ("p:1", "c"), D(1), 2), edge(22, ("p:1", "c"), ("no.t", "c"), D(1), 2), edge(23, ("q:1", "c"), ("db.t", "a"), D(2), 2)]
    e, c = spark.createDataFrame(chain + loop, EDGES), spark.createDataFrame(CAT, CATALOG)
    want = sorted([(i, i) for i in range(9)] + [(22, 0), (20, 2), (21, 1)])
    for limit in (orphans.GROUP_EDGES, 3):
        got = orphans.cascade(e, c, limit).collect()
        assert sorted((r["edge_id"], r["round"]) for r in got) == want
        assert {r["reason"] for r in got if r["round"] > 0} == {"inherited"}


def test_cascade_of_random_graphs_in_both_ways(spark):
    r = random.Random(4)
    edges = []
    for i in range(220):
        source = ("no.t", "c") if r.random() < 0.06 else (None, None) if r.random() < 0.05 else (f"s:{r.randrange(30)}", "c")
        edges.append(edge(i, (f"s:{r.randrange(30)}", "c"), source, D(1), r.choice([1, 2])))
    level = {e[0]: 0 for e in edges if e[5] == "no.t" or e[5] and not any(x[1] == e[1] and x[3] == e[5] for x in edges)}
    at = 0
    while True:
        reached = {(e[1], e[3]) for e in edges if level.get(e[0]) == at}
        new = [e[0] for e in edges if e[0] not in level and (e[1], e[5]) in reached]
        if not new:
            break
        at += 1
        level.update(dict.fromkeys(new, at))
    e, c = spark.createDataFrame(edges, EDGES), spark.createDataFrame(CAT, CATALOG)
    for limit in (orphans.GROUP_EDGES, 50):
        assert {r["edge_id"]: r["round"] for r in orphans.cascade(e, c, limit).collect()} == level


def test_cascade_of_a_very_long_chain_beyond_a_task(spark):
    n = 20_000
    i = F.col("id")
    rows = spark.range(n).select(
        i.alias("edge_id"), F.lit(1).cast("bigint").alias("stmt_id"), F.concat(F.lit("s:"), i).alias("to_scope"), F.lit("c").alias("to_column"),
        F.when(i == 0, "no.t").otherwise(F.concat(F.lit("s:"), i - 1)).alias("from_scope"), F.lit("c").alias("from_column"), F.lit(D(1)).cast("timestamp").alias("seen_at"),
    )
    got = [(r["edge_id"], r["round"]) for r in orphans.cascade(rows, spark.createDataFrame(CAT, CATALOG), 1_000).collect()]
    assert len(got) == n and all(a == b for a, b in got)


def test_clashing_columns(spark, sf_dir, clash):
    t = [clash(spark.read.parquet(f"{sf_dir}/{n}.parquet")) for n in ("column_edges", "catalog_columns", "audit_records", "issue_kinds")]
    assert orphans.found(*t).count() > 0
    assert orphans.report(*t).count() > 0
