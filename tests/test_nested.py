import json
from datetime import datetime

from loomspan.operators import nested

COLUMNS = "stmt_id bigint, received_at timestamp, payload string"
T = [datetime(2025, 1, d) for d in (1, 2, 3)]


def rows(spark, data):
    df = spark.createDataFrame(data, COLUMNS)
    return sorted(tuple(r) for r in nested.child_objects(df).collect())


def doc(columns):
    return json.dumps({"scopes": {"ROOT": {"columns": columns}}})


def test_shapes_and_values(spark):
    payload = doc([None, {"sources": {"scope": "a", "column": None}, "case_branches": [None, {"when_expr": "x", "then_value": 1.50}, {"then_value": True}], "window": {"partition_by": [{"scope": "t", "column": "c"}], "order_by": None}}, {"sources": ["text", 3], "branches": "no"}])
    payload = payload.replace("1.5}", "1.50}")
    assert rows(spark, [(1, T[0], payload)]) == [
        (1, "ROOT", 1, "case_branch", 1, "x", "1.50"),
        (1, "ROOT", 1, "case_branch", 2, "", "true"),
        (1, "ROOT", 1, "partition_by", 0, "t", "c"),
        (1, "ROOT", 1, "source", 0, "a", ""),
    ]


def test_unreadable_null_and_empty(spark):
    bad = ["", "  ", "{", '{"scopes": {}} x', '{"a": NaN}', "[]", "null", "3", None]
    assert rows(spark, [(i, T[0], p) for i, p in enumerate(bad)] + [(None, T[0], doc([{"sources": {"scope": "a"}}]))]) == []
    assert rows(spark, []) == []


def test_latest_readable_delivery_counts(spark):
    a, b = doc([{"sources": [{"scope": "old"}]}]), doc([{"sources": [{"scope": "new"}]}])
    assert [r[5] for r in rows(spark, [(1, T[0], a), (1, T[1], b), (1, T[1], b), (1, T[2], b[:-3])])] == ["new"]


def test_surrogates_and_clashing_columns(spark, clash):
    payload = '{"scopes": {"s\\ud800": {"columns": [{"sources": [{"scope": "\\udfff", "column": "c"}]}]}}}'
    df = clash(spark.createDataFrame([(1, T[0], payload)], COLUMNS))
    assert nested.child_objects(df).count() == 1


def test_of_texts_at_one_time_the_greatest_counts(spark):
    a, b = doc([{"sources": [{"scope": "a"}]}]), doc([{"sources": [{"scope": "b"}]}])
    data = [(1, T[1], b), (1, T[1], a), (1, T[1], b), (1, T[0], a), (2, None, a), (2, None, b), (3, T[0], a)]
    assert [r[:1] + r[5:6] for r in rows(spark, data)] == [(1, "b"), (2, "b"), (3, "a")]


def test_written_tables_link_up(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/lineage_docs.parquet")
    t = nested.tables(docs, str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").glob("tag=*")) == sorted(f"tag={tag}" for tag in nested.SCHEMAS)
    assert t["column"].count() > t["scope"].count() > 0
    assert "resolved_by" in t["source"].columns and dict(t["scope"].dtypes)["distinct"] == "boolean"
    assert all(r["n_rows"] == r["n_linked"] > 0 for r in nested.links(docs).collect())
    assert nested.table_sizes(docs.limit(0)).count() == 0
