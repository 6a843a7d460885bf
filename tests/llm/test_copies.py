import json

from loomspan.llm import copies


def body(name, sql, **more):
    return json.dumps({"task_name": name, "sql": sql, **more})


ROWS = [
    (5, body("A_b", "SELECT x,y  FROM t")),
    (2, json.dumps({"sql": "select X Y\nfrom `T`;", "other": 1, "task_name": "a B"}, indent=2)),
    (2, json.dumps({"sql": "select X Y\nfrom `T`;", "other": 1, "task_name": "a B"}, indent=2)),
    (9, body("a b", "select x y from t -- z")),
    (3, body("a", "b select x y from t")),
    (4, None), (6, ""), (7, '{"task_name": "a b"'), (8, "[1]"), (10, body("a b", "select x y from t") + " "), (11, body("a b", "select x y from t") + "x"),
    (12, body(None, None)), (13, "{}"),
]


def test_copies(spark, clash):
    df = clash(spark.createDataFrame([(*r, "f") for r in ROWS], "file_id bigint, body string, feed string"))
    want = [(2, 5), (2, 10), (12, 13)]
    assert sorted(map(tuple, copies.found(df).collect())) == want
    assert sorted(map(tuple, copies.found(df, hot=1).collect())) == want
    assert {tuple(r) for r in copies.records(df).collect()} == {(2, 3), (3, 1), (9, 1), (12, 2)}
    assert copies.collision_check(df).first()[1:] == (4, 0)
    assert copies.feed_report(df).first()["n_copies"] == 3
    assert copies.found(df.limit(0)).count() == 0


def test_collisions_are_kept_apart_and_told(spark):
    rows = spark.createDataFrame([(1, 7, 7, 1), (2, 7, 7, 1), (3, 7, 7, 2), (4, 8, 7, 2)], "file_id bigint, h1 bigint, h2 bigint, check bigint")
    assert {tuple(r)[3:] for r in copies.groups(rows).collect()} == {(1, 2), (3, 1), (4, 1)}
    assert [tuple(r) for r in copies.colliding(rows).collect()] == [(7, 7, 2)]


def test_two_bodies_under_one_id_count_as_one_of_them(spark):
    df = spark.createDataFrame([(1, body("a", "x")), (1, body("b", "y")), (2, body("a", "x")), (3, body("b", "y"))], "file_id bigint, body string")
    assert sorted(r["n_files"] for r in copies.records(df).collect()) == [1, 2]
    assert len(copies.found(df).collect()) == 1


def test_words_of_any_script():
    assert copies.canonical({"task_name": "É_ß 日本２", "sql": None}) == "é\x1fß\x1f日本２\x1e".encode()


def test_very_long_body(spark):
    df = spark.createDataFrame([(i, body("a", "x " * 300_000 + " " * i)) for i in (1, 2)], "file_id bigint, body string")
    assert [tuple(r) for r in copies.found(df).collect()] == [(1, 2)]
