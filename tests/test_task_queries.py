"""The fact tables of the whole task corpus against its nested rows, counted in plain Python."""

from collections import Counter

import pytest

from loomspan.operators import impact, lineage
from loomspan.operators.corpus_queries import QUERIES
from loomspan.runtime import table


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    a = lineage.analyze(table(spark, sf_dir, "tasks"), table(spark, sf_dir, "catalog_columns"))
    return [r.asDict(recursive=True) for r in a.collect()]


COUNTS = {
    "task_scopes": lambda s: 1,
    "task_graph": lambda s: len(s["depends_on"]),
    "task_edges": lambda s: sum(len(c["sources"]) for c in s["columns"]),
    "task_joins": lambda s: len(s["joins"]),
    "task_filters": lambda s: len(s["filters"]),
    "task_groupings": lambda s: len(s["group_by"]),
    "task_windows": lambda s: sum(c["window"] is not None for c in s["columns"]),
    "task_cases": lambda s: sum(len(c["case_branches"]) for c in s["columns"]),
    "task_generators": lambda s: len(s["generators"]),
}


@pytest.mark.parametrize("name", COUNTS)
def test_facts_of_every_task(name, rows, spark, sf_dir):
    want = Counter({r["stmt"]: n for r in rows if (n := sum(map(COUNTS[name], r["scopes"])))})
    assert Counter(r["stmt"] for r in QUERIES[name](spark, sf_dir).select("stmt").collect()) == want


def test_statements_of_every_task(rows, spark, sf_dir):
    ok = {r["stmt"] for r in rows if r["status"] == "ok"}
    assert {r["stmt"] for r in QUERIES["task_stats"](spark, sf_dir).collect()} == ok


def test_output_metadata_of_every_task(rows, spark, sf_dir):
    """Targets outside the catalogue give all the root's names; others only names the catalogue has."""
    keys = {r["t"] for r in table(spark, sf_dir, "catalog_columns").select(lineage.table_name("table_key").alias("t")).collect()}
    own = {(r["stmt"], c["name"]) for r in rows if ".".join((r["target_table"] or "").lower().split(".")[-2:]) not in keys for s in r["scopes"] if s["scope_id"] == "ROOT" for c in s["columns"]}
    got = {(r["stmt"], r["column_name"]) for r in QUERIES["task_output_metadata"](spark, sf_dir).where("not metadata_complete").collect()}
    assert got == own


def test_references_of_every_task_are_known(rows, spark, sf_dir):
    want = set()
    for r in rows:
        if r["status"] == "ok":
            known = {s["scope_id"] for s in r["scopes"]} | {*r["source_tables"], r["target_table"], "CONSTANT", "SYSTEM", "UNKNOWN"}
            want |= {(r["stmt"], s["scope_id"], x) for s in r["scopes"] for x in [*s["depends_on"], *(y["scope"] for c in s["columns"] for y in c["sources"])] if x not in known}
    assert {(r["stmt"], r["scope_id"], r["unknown_ref"]) for r in QUERIES["task_xref_errors"](spark, sf_dir).collect()} == want


def test_dangling_scopes_of_every_task(rows, spark, sf_dir):
    want = set()
    for r in rows:
        used = {x for s in r["scopes"] for x in s["depends_on"]}
        want |= {(r["stmt"], s["scope_id"]) for s in r["scopes"] if r["status"] == "ok" and s["scope_id"] not in used | {"ROOT"}}
    assert {(r["stmt"], r["scope_id"]) for r in QUERIES["task_dangling_scopes"](spark, sf_dir).collect()} == want


def links_of(rows):
    return {(x["scope"], x["column"], r["target_table"], l["name"]) for r in rows for l in r["lineage"] for x in l["sources"] if r["target_table"]}


def test_every_column_is_followed_downstream(rows, spark, sf_dir):
    want = {(x["scope"], x["column"], r["stmt"], l["name"]) for r in rows for l in r["lineage"] for x in l["sources"]}
    got = QUERIES["task_downstream"](spark, sf_dir).select("source_table", "source_column", "stmt", "name").collect()
    assert set(map(tuple, got)) == want


def test_reach_from_every_unwritten_table(spark):
    texts = ["insert into m.b select a.x, a.y from s.a a", "insert into m.c select b.x as p, 1 as q from m.b b", "insert into m.d select c.p, k.z from m.c c join s.k k on c.p = k.i", "insert into m.e select 1 as one", "insert into m.f select e.one from m.e e"]
    a = lineage.analyze(spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "task_name string, sql string"))
    got = {(r["table_name"], r["column_name"]): r["steps"] for r in impact.reach_of_sources(a).collect()}
    assert got == {("s.a", "x"): 0, ("s.a", "y"): 0, ("s.k", "z"): 0, ("m.b", "x"): 1, ("m.b", "y"): 1, ("m.d", "z"): 1, ("m.c", "p"): 2, ("m.d", "p"): 3}


def test_reach_of_the_tasks(rows, spark, sf_dir):
    plain = lambda t: ".".join(t.replace("`", "").lower().split(".")[-2:])
    links = {((plain(a), b), (plain(c), d)) for a, b, c, d in links_of(rows)}
    written = {plain(r["target_table"]) for r in rows if r["target_table"] and r["lineage"]}
    steps = {a: 0 for a, _ in links if a[0] not in written}
    wave, at = set(steps), 0
    while wave:
        at += 1
        wave = {b for a, b in links if a in wave and b not in steps}
        steps.update(dict.fromkeys(wave, at))
    got = {(r["table_name"], r["column_name"]): r["steps"] for r in QUERIES["task_impact_reach"](spark, sf_dir).collect()}
    assert got == steps
    assert len({t for t, _ in steps}) > 1
