"""What conditions say, walks over columns, and faults of records."""

import random

import pytest

from loomspan.operators import contract
from loomspan.plans import conditions as c
from loomspan.plans import trace


@pytest.mark.parametrize(
    ("text", "shape", "kind", "operators"),
    [
        ("a = 1", "SINGLE_CONDITION", "other_filter", ["="]),
        ("x between 1 and 2", "SINGLE_CONDITION", "other_filter", ["BETWEEN"]),
        ("(a = 1 and (b <> 2))", "AND_GROUP", "other_filter", ["=", "<>"]),
        ("not (a is null or b in (1))", "OR_GROUP", "other_filter", ["IS_NULL", "IN"]),
        ("case when a = 1 and b = 2 then 1 end = 1", "SINGLE_CONDITION", "other_filter", ["="]),
        ("t.dt >= '1' and width = 3", "AND_GROUP", "partition_filter", [">=", "="]),
        ("width = 3", "SINGLE_CONDITION", "other_filter", ["="]),
        ("dt is null", "SINGLE_CONDITION", "other_filter", ["IS_NULL"]),
        ("coalesce(t.is_deleted, 0) = 0", "SINGLE_CONDITION", "soft_delete_filter", ["=", "COALESCE"]),
        ("s = 'a and b or dt = 1'", "SINGLE_CONDITION", "other_filter", ["="]),
        ("a not like 'x' or datediff(b, c) > 3", "OR_GROUP", "other_filter", ["NOT_LIKE", ">", "DATEDIFF"]),
    ],
)
def test_conditions(text, shape, kind, operators):
    e = c.expression(text)
    assert c.told(e) == {"shape": shape, "filter_kind": kind, "operators": operators}


def test_equalities_must_hold():
    pairs = lambda t: [(a.parts, b.parts) for a, b in c.equalities(c.expression(t))]
    assert pairs("a.x = b.y and (a.z = b.z) and a.q = 'b.w = c.w'") == [(["a", "x"], ["b", "y"]), (["a", "z"], ["b", "z"])]
    assert pairs("a.x = b.y or a.z = b.z") == []
    assert pairs("a.x = b.y and (a.z = b.z or a.w = b.w)") == [(["a", "x"], ["b", "y"])]


def test_unreadable_texts_tell_nothing():
    for t in (None, "", "a =", "a = 1 b", "a in ("):
        assert c.expression(t) is None
    assert c.told(None) == {"shape": None, "filter_kind": None, "operators": []}
    assert [c.is_constant(c.expression(t)) for t in ("-1", "'x'", "null", "now()", "current_date", "(1)", "f()", "a", "now(1)", None)] == [True] * 6 + [False] * 4


def test_order_of_scopes():
    assert trace.ordered(["b", "a", "r"], [("a", "r"), ("b", "r"), ("t", "a"), ("r", "r")]) == ["a", "b", "r"]
    assert trace.ordered(["a", "b", "c", "d"], [("a", "b"), ("b", "a"), ("b", "c")]) == ["d", "a", "b", "c"]
    assert trace.feeding_tables({"r": ["a", "t1"], "a": ["r", "t2"]}, "r") == ["t1", "t2"]


def test_walks_do_not_grow_with_the_number_of_ways():
    n = 200
    columns = [("ROOT", x, "DIRECT", None, [("s0", "a"), ("s0", "b")]) for x in "ab"]
    columns += [(f"s{i}", x, "DIRECT", None, [(f"s{i + 1}", "a"), (f"s{i + 1}", "b")] if i < n else [("t", x)]) for i in range(n + 1) for x in "ab"]
    ids = {at for at, *_ in columns}
    assert trace.to_physical(columns, ids, "ROOT", "a") == [("t", "a", "DIRECT"), ("t", "b", "DIRECT")]
    assert [len(r["sources"]) for r in trace.end_to_end(columns, ids)] == [2, 2]


def test_leaves_match_a_plain_walk():
    r = random.Random(7)
    for _ in range(60):
        columns = [(f"s{i}", f"c{j}", r.choice(["DIRECT", "AGGREGATE", "EXPRESSION"]), None, [(r.choice(["t", "CONSTANT", "UNKNOWN", *(f"s{k}" for k in range(6))]), f"c{r.randrange(3)}") for _ in range(r.randrange(3))]) for i in range(6) for j in range(3)]
        ids = {f"s{i}" for i in range(6)}
        by = {(a, b): (t, s) for a, b, t, _, s in columns}
        want, seen, todo = set(), set(), [("s0", "c0", 0)]
        while todo:
            at, name, rank = x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            if at not in ids:
                if at != "UNKNOWN":
                    want.add((at, name, trace.ORDER[rank]))
                continue
            t, sources = by[at, name]
            todo += [(s, n, max(rank, trace.RANK[t])) for s, n in sources]
        assert set(trace.to_physical(columns, ids, "s0", "c0")) <= want
        assert {x[:2] for x in trace.to_physical(columns, ids, "s0", "c0")} == {x[:2] for x in want}


def test_contract():
    top = contract.rules()
    good = {"task_id": "t", "target_table": "m.t", "stmt_kind": "MERGE", "scopes": {"ROOT": {"kind": "root", "columns": [], "depends_on": []}}, "scope_graph": {"nodes": [], "edges": []}}
    assert list(contract.breaks(good, top)) == []
    assert list(contract.breaks([], top)) == [("", "object")]
    assert ("scopes{}.columns", "list") in set(contract.breaks({**good, "scopes": {"a": {"kind": "cte", "columns": None, "depends_on": []}}}, top))
