from datetime import datetime

from loomspan.operators import diff

COLUMNS = "statement string, path string, severity string, root_cols int, body string, written_at timestamp"
AT = datetime(2025, 1, 1)


def row(s, p, severity="RED", cols=1, body="{}", at=AT):
    return (s, p, severity, cols, body, at)


def run(spark, left, right):
    return sorted((tuple(r) for r in diff.compare(spark.createDataFrame(left, COLUMNS), spark.createDataFrame(right, COLUMNS)).collect()), key=repr)


def test_missing_statements_and_files(spark):
    left = [row("a", "x"), row("a", "y"), row("b", "x"), row("b", "x")]
    right = [row("a", "x"), row("a", "z"), row("c", "x")]
    assert run(spark, left, right) == [("a", "y", "missing_right_file", ""), ("a", "z", "missing_left_file", ""), ("b", "", "missing_right", ""), ("c", "", "missing_left", "")]


def test_fields(spark):
    cases = [
        ('{"a": 1, "b": [1, 2]}', '{ "b":[1,2],"a":1.0 }', False),
        ('{"a": 1}', '{"a": true}', True),
        ('{"a": null}', "{}", True),
        ("[1, 2]", "[2, 1]", True),
        ("{bad", "{bad ", True),
        ('{"a": 1}', None, True),
        (None, None, False),
        ('"\\u00e9"', '"é"', False),
    ]
    for i, (a, b, differs) in enumerate(cases):
        want = [("s", "f.json", "content_diff", "body")] if differs else []
        assert run(spark, [row("s", "f.json", body=a)], [row("s", "f.json", body=b)]) == want, i
    assert run(spark, [row("s", "f.md", body="{} ")], [row("s", "f.md", body="{}")]) == [("s", "f.md", "content_diff", "body")]
    assert run(spark, [row("s", "f", None, None)], [row("s", "f", "RED", 1)]) == [("s", "f", "content_diff", "root_cols"), ("s", "f", "content_diff", "severity")]


def test_null_keys_empty_sides_and_clashing_columns(spark, clash):
    assert run(spark, [row(None, "p"), row("", None)], [row(None, "p", "GREEN"), row("", None)]) == [(None, "p", "content_diff", "severity")]
    assert run(spark, [row("a", "x")], []) == [("a", "", "missing_right", "")]
    assert run(spark, [], []) == []
    one = clash(spark.createDataFrame([row("a", "x")], COLUMNS))
    assert diff.compare(one, one).count() == 0


def test_latest_version_counts(spark):
    later = datetime(2025, 2, 1)
    assert run(spark, [row("a", "x", "RED"), row("a", "x", "GREEN", at=later)], [row("a", "x", "GREEN")]) == []
