"""Connected components of an undirected graph given as pairs.

Alternating large-star and small-star rounds: every node hands its larger neighbours, then its
smaller ones, to the smallest node it knows, which halves distances; a graph needs about as many
rounds as the logarithm of its size.  Each round is two grouped minima and joins spread by node, and
ends in a written table; nothing but a count reaches the driver.  A round that gives the same pairs is the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import stored


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node of a pair; loops and repeated
    pairs do not matter, null ends are left out."""
    p = pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    edges = stored(p)
    n = edges.count()
    while True:
        last, before = edges, n
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        small_of = large.select(F.col("v").alias("x"), F.col("u").alias("y"))
        low = small_of.groupBy("x").agg(F.min("y").alias("m"))
        small = small_of.join(low, "x").select(F.col("m").alias("u"), F.explode(F.array("x", "y")).alias("v")).where("u <> v").distinct()
        edges = stored(small)
        n = edges.count()
        if n == before and edges.join(last, ["u", "v"], "left_anti").isEmpty():
            break
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
