import pytest

from loomspan.llm import queries


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_matches_sql(name, agree):
    agree(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_runs(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
