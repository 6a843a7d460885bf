"""Every query with SQL against that SQL; the others run and give rows of a stable schema."""

import pytest

from loomspan.operators import corpus_queries, queries
from loomspan.plans import executed, golden, golden_more

PARTS = (queries, golden, golden_more, corpus_queries, executed)
SQL = [(p, n) for p in PARTS for n in p.QUERIES if n in p.SQL]
ROWS = [(p, n) for p in PARTS for n in p.QUERIES if n not in p.SQL]


@pytest.mark.parametrize(("part", "name"), SQL, ids=[n for _, n in SQL])
def test_matches_sql(part, name, agree):
    agree(part.QUERIES[name], part.SQL[name])


@pytest.mark.parametrize(("part", "name"), ROWS, ids=[n for _, n in ROWS])
def test_runs(part, name, spark, sf_dir):
    df = part.QUERIES[name](spark, sf_dir)
    assert df.columns
    df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
