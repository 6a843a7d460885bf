import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.fixture(scope="session")
def agree(spark, sf_dir, duck):
    """Runs a query and its SQL and compares rows and column names."""

    def check(query, sql):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
        r = duck.execute(sql)
        at = {d[0]: i for i, d in enumerate(r.description)}
        assert sorted(at) == names
        assert got == sorted((tuple(norm(x[at[c]]) for c in names) for x in r.fetchall()), key=repr)

    return check


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def add(df):
        for c in ("bucket", "count", "key", "id", "n", "v", "class", "round", "parent", "child", "target", "reason", "size", "at", "look", "slice", "rank"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        return df

    return add
