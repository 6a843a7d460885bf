"""Parsing and resolution of single statements."""

import pytest

from loomspan.plans import scopes, sqlparse, trace


def one(sql, lookup=None):
    return scopes.facts("t", sql, lookup)[0]


def scope(record, name):
    return next(s for s in record["scopes"] if s["scope_id"] == name)


def sources(record, name, column, branch=None):
    c = next(c for c in scope(record, name)["columns"] if c["name"] == column and c["merge_branch"] == branch)
    return [(r["scope"], r["column"]) for r in c["sources"]]


def warned(record):
    return {w["type"] for w in record["warnings"]}


def test_split_keeps_strings_and_comments():
    text = "insert into a select ';' ; -- x;\n insert into b select 1; /* ; */ "
    assert [text[a:b].strip().split()[0] for a, b in sqlparse.split(text)] == ["insert", "--"]


@pytest.mark.parametrize("sql", ["insert into", "insert into a selec b", "insert into a select (b from c", "insert into a select b from c where", "merge into a using b on", "insert into a select 'x"])
def test_errors_are_records(sql):
    r = one(sql)
    assert r["status"] == "error"
    assert warned(r) == {"PARSE_ERROR"}


def test_empty_and_other_statements():
    assert one("")["status"] == "empty"
    assert one(" ; -- nothing")["status"] == "empty"
    assert one("select 1")["status"] == "other"


def test_very_deep_statement_is_a_record():
    assert one("insert into a select " + "(" * 5000 + "1" + ")" * 5000)["status"] in ("error", "ok")


def test_union_chain_is_flat():
    r = one("insert into d.t with c as (select a.id from s.a a union all select b.id from s.b b union all select e.id from s.e e) select c.id from c")
    assert scope(r, "union:c")["branches"] == ["union:c:b01", "union:c:b02", "union:c:b03"]
    assert sources(r, "cte:c", "id") == [("union:c", "id")]


def test_unnamed_branch_column_takes_the_first_name():
    r = one("insert into d.t select a.id, a.name from s.a a union all select b.id, to_date(b.x) from s.b b")
    assert [c["name"] for c in scope(r, "union:main:b02")["columns"]] == ["id", "name"]


def test_outer_select_over_union_is_dropped():
    r = one("insert into d.t select u.id from (select id from s.a union all select id from s.b) u")
    assert [s["scope_id"] for s in r["scopes"]] == ["union:main:b01", "union:main:b02", "union:main", "ROOT"]


def test_struct_field_is_its_base_column():
    r = one("insert into d.t with j as (select a.g from s.a a) select j.g.open as open from j")
    assert sources(r, "ROOT", "open") == [("cte:j", "g")]


def test_star_over_schema_keeps_named_partition_column():
    r = one("insert into d.t select * from s.a where dt = '1'", {"s.a": ["id"]}.get)
    assert [c["name"] for c in scope(r, "ROOT")["columns"]] == ["id", "dt"]


def test_star_is_all_or_nothing():
    r = one("insert into d.t select * from s.a a join s.b b on a.id = b.id", {"s.a": ["id"]}.get)
    assert "star_not_expanded" in warned(r)
    assert ("s.b", "*") in sources(r, "ROOT", "*")


def test_unqualified_prefers_scope_that_has_it_then_table():
    r = one("insert into d.t with c as (select x from s.a) select x, y from c join s.b on c.x = s.b.k")
    assert sources(r, "ROOT", "x") == [("cte:c", "x")]
    assert sources(r, "ROOT", "y") == [("s.b", "y")]


def test_window_names_do_not_bind_to_a_generator():
    r = one("insert into d.t select k, first_value(i.m) over (partition by k order by w) as f from s.a t lateral view inline(from_json(t.p, 'array<struct<M:string,v:int>>')) i")
    assert sources(r, "ROOT", "f") == [("udtf:i", "m"), ("s.a", "k"), ("s.a", "w")]


def test_duplicate_alias_is_settled_by_columns():
    r = one("insert into d.t with c as (select m, v from s.c) select b.u, b.v from s.a a join s.b b on a.k = b.k left join c b on a.k = b.m")
    assert sources(r, "ROOT", "u") == [("s.b", "u")]
    assert sources(r, "ROOT", "v") == [("cte:c", "v")]
    assert "duplicate_alias" in warned(r)


def test_merge_branches_and_delete():
    r = one("merge into d.t using s.x x on t.id = x.id when matched and x.f = 'D' then delete when matched then update set f = x.f when not matched then insert (id, f) values (x.id, '0')")
    assert sources(r, "ROOT", "f", "matched") == [("s.x", "f")]
    assert sources(r, "ROOT", "f", "not_matched") == [("CONSTANT", "'0'")]
    assert "merge_delete_ignored" in warned(r)


def test_join_kinds():
    r = one("insert into d.t select a.x from s.a a cross join s.b b right join s.c c on a.i = c.i full outer join s.e e using (i) left anti join s.f f on f.i = a.i")
    assert [j["join_type"] for j in scope(r, "ROOT")["joins"]] == ["CROSS", "RIGHT_OUTER", "FULL_OUTER", "LEFT_ANTI"]
    assert {j["left_scope"] for j in scope(r, "ROOT")["joins"]} == {"s.a"}


def test_magic_number_and_case_in_aggregate():
    r = one("insert into d.t select sum(case when a.x > -7 then 1 end) as s, a.y + 100 as y from s.a a group by a.y")
    by = {c["name"]: c for c in scope(r, "ROOT")["columns"]}
    assert by["s"]["magic_number"] == "-7"
    assert by["s"]["case_in_aggregate"]
    assert by["y"]["magic_number"] is None


def test_multi_insert_and_order_direction():
    r = scopes.facts("t", "from s.a insert into d.x select a.i order by i desc insert into d.y select a.j where j > 1")
    assert [x["stmt"] for x in r] == ["t#0", "t#1"]
    assert scope(r[0], "ROOT")["order_by"] == [{"scope": "ROOT", "column": "i", "direction": "DESC"}]


def test_trace_rules():
    columns = [("ROOT", "a", "DIRECT", None, [("c", "a")]), ("c", "a", "AGGREGATE", None, [("t", "x"), ("CONSTANT", "1")]), ("ROOT", "b", "DIRECT", None, [("c", "gone")]), ("ROOT", "l", "DIRECT", None, [("ROOT", "l")]), ("ROOT", "u", "DIRECT", None, [("UNKNOWN", "u")])]
    by = {r["name"]: r for r in trace.end_to_end(columns, {"ROOT", "c"})}
    assert by["a"]["sources"] == [{"scope": "t", "column": "x", "transform": "AGGREGATE"}]
    assert (by["b"]["reasons"], by["l"]["reasons"], by["u"]["reasons"]) == (["missing_scope_column"], ["cycle_detected"], ["unknown_source"])
    assert trace.to_physical(columns, {"ROOT", "c"}, "ROOT", "a") == [("t", "x", "AGGREGATE"), ("CONSTANT", "1", "AGGREGATE")]
    assert trace.upstream(columns, {"ROOT", "c"}, "ROOT", "a")["path_length"] == 4
    wild = [("ROOT", "k", "DIRECT", None, [("c", "k")]), ("c", "*", "EXPAND_ALL", None, [("t", "*")])]
    assert trace.to_physical(wild, {"ROOT", "c"}, "ROOT", "k") == [("t", "k", "EXPAND_ALL")]
