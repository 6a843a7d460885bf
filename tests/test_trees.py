import random

from pyspark.sql import functions as F

from loomspan.operators import trees

COLUMNS = "g bigint, child string, parent string"


def brute(links):
    """root and depth by walking up from every node; any parent that leads into a cycle counts."""
    up = {}
    for g, c, p in links:
        for x in (c, p):
            if x is not None:
                up.setdefault((g, x), set())
        if c is not None and p is not None:
            up[g, c].add(p)

    def cyclic(g, x):
        seen, todo = set(), list(up[g, x])
        reach = set()
        while todo:
            y = todo.pop()
            if y not in reach:
                reach.add(y)
                todo += up[g, y]
        for y in reach | {x}:
            seen, todo = set(), list(up[g, y])
            while todo:
                z = todo.pop()
                if z == y:
                    return True
                if z not in seen:
                    seen.add(z)
                    todo += up[g, z]
        return False

    out = {}
    for g, x in up:
        if cyclic(g, x):
            out[g, x] = ("", -1, ())
            continue
        path = [x]
        while up[g, path[-1]]:
            path.append(min(up[g, path[-1]]))
        out[g, x] = (path[-1], len(path) - 1, tuple(reversed(path)))
    return out


def run(spark, links, **options):
    df = spark.createDataFrame(links, COLUMNS)
    return {(r["g"], r["node"]): (r["root"], r["depth"], tuple(r["path"]), tuple(r["descendants"]), r["n_descendants"]) for r in trees.hierarchy(df, ["g"], lists=True, **options).collect()}


def check(got, links):
    want = brute(links)
    assert {k: v[:3] for k, v in got.items()} == want
    for (g, x), v in got.items():
        below = sorted(n for (h, n), w in want.items() if h == g and x in w[2][:-1]) if v[1] >= 0 else []
        assert list(v[3]) == below
        assert v[4] == len(below)


def random_links(seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(12)] + ["", None]
    return [(r.choice([1, 2, None]), r.choice(names), r.choice(names)) for _ in range(30)] + [(3, f"c{i}", f"c{i + 1}") for i in range(40)]


def test_packed_and_spread_match_brute_force(spark):
    for seed in range(3):
        links = random_links(seed)
        check(run(spark, links), links)
    for seed, several in ((9, True), (10, False)):
        links = random_links(seed)
        if not several:
            links = list({(g, c): (g, c, p) for g, c, p in links}.values())
        check(run(spark, links, group_links=25), links)


def test_chain_and_star_beyond_a_task(spark):
    # 250,000 links of one group each: more than a task may hold.
    i, n = F.col("id"), 250_000
    name = lambda c: F.concat(F.lit("n"), c)
    chain = spark.range(n).select(F.lit(1).alias("g"), name(i + 1).alias("child"), name(i).alias("parent"))
    star = spark.range(n).select(F.lit(2).alias("g"), name(i + 1).alias("child"), F.lit("hub").alias("parent"))
    loop = spark.range(9).select(F.lit(1).alias("g"), F.concat(F.lit("c"), i).alias("child"), F.concat(F.lit("c"), (i + 1) % 9).alias("parent"))
    got = {(r["g"], r["node"]): (r["root"], r["depth"], r["n_descendants"]) for r in trees.hierarchy(chain.unionByName(star).unionByName(loop), ["g"]).collect()}
    assert len(got) == 2 * (n + 1) + 9
    assert all(got[1, f"n{k}"] == ("n0", k, n - k) for k in range(n + 1))
    assert got[2, "hub"] == ("hub", 0, n) and all(got[2, f"n{k}"] == ("hub", 1, 0) for k in range(1, n + 1))
    assert all(got[1, f"c{k}"] == ("", -1, 0) for k in range(9))


def test_repeats_of_one_link_do_not_make_a_group_large(spark):
    rows = spark.range(60).select(F.lit(1).alias("g"), F.lit("a").alias("child"), F.lit("b").alias("parent"))
    assert sorted((r["node"], r["depth"]) for r in trees.hierarchy(rows, ["g"], group_links=20).collect()) == [("a", 1), ("b", 0)]


def test_cycles_nulls_and_repeats(spark):
    links = [(1, "a", "b"), (1, "a", "b"), (1, "b", "a"), (1, "c", "a"), (1, "x", "x"), (1, "d", None), (1, None, "e"), (1, None, None)]
    got = {k[1]: v[:2] for k, v in run(spark, links).items()}
    assert got == {"a": ("", -1), "b": ("", -1), "c": ("", -1), "x": ("", -1), "d": ("d", 0), "e": ("e", 0)}


def test_empty_and_clashing_columns(spark, sf_dir, clash):
    assert run(spark, []) == {}
    e, j = (clash(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in ("column_edges", "scope_joins"))
    assert trees.found(e, j).count() > 0
    assert trees.found(e.limit(0), j.limit(0)).count() == 0
