import random

from loomspan.operators.components import components


def test_random_graph(spark):
    r = random.Random(4)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 5), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {x: find(x) for x in parent}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    assert got == want


def test_empty(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
