"""Pairs of rows that share a key, however many share it.

A key's rows are dealt by hash into blocks of about BLOCK rows; a task meets one pair of blocks at a
time, so a key with a third of all rows is spread like any other, and no pair is lost or made twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import broadcast_if_small

BLOCK = 1024


def hot(rows: DataFrame, key: str) -> DataFrame:
    """key, n_blocks of the keys with more than a block of rows; there are at most rows / BLOCK of them, and
    they are broadcast where a count finds them few."""
    counts = rows.groupBy(key).count().where(F.col("count") > BLOCK)
    return broadcast_if_small(counts.select(key, F.ceil(F.col("count") / BLOCK).cast("int").alias("n_blocks")))


def blocked(rows: DataFrame, key: str, id_: str, large: DataFrame) -> DataFrame:
    """rows(key, id) with `block`, from 0, and `n_blocks`; distinct rows, no nulls."""
    n = F.coalesce("n_blocks", F.lit(1))
    return rows.select(key, id_).join(large, key, "left").select(key, id_, n.alias("n_blocks"), F.pmod(F.xxhash64(id_), n).cast("int").alias("block"))


def within(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """key, x, y: every two rows of a key once, x < y."""
    b = blocked(rows, key, id_, hot(rows, key))
    left = b.select(key, F.col(id_).alias("left_id"), F.col("block").alias("i"), F.explode(F.expr("sequence(block, n_blocks - 1)")).alias("j"))
    right = b.select(key, F.col(id_).alias("right_id"), F.col("block").alias("j"), F.explode(F.expr("sequence(0, block)")).alias("i"))
    met = left.join(right, [key, "i", "j"]).where("i < j or left_id < right_id")
    return met.select(key, F.least("left_id", "right_id").alias("x"), F.greatest("left_id", "right_id").alias("y"))


def between(links: DataFrame, a: str, b: str, rows: DataFrame, key: str, id_: str) -> DataFrame:
    """x, y: for each link of two different keys, every row of the one with every row of the other."""
    large = hot(rows, key)
    own = blocked(rows, key, id_, large)
    size = lambda c: large.select(F.col(key).alias(c), F.col("n_blocks").alias(f"n_{c}"))
    cells = links.select(F.col(a).alias("a"), F.col(b).alias("b")).join(size("a"), "a", "left").join(size("b"), "b", "left")
    cells = cells.select("a", "b", F.explode(F.expr("sequence(0, coalesce(n_a, 1) - 1)")).alias("i"), "n_b").select("a", "b", "i", F.explode(F.expr("sequence(0, coalesce(n_b, 1) - 1)")).alias("j"))
    side = lambda c, at, name: own.select(F.col(key).alias(c), F.col("block").alias(at), F.col(id_).alias(name))
    met = cells.join(side("a", "i", "left_id"), ["a", "i"]).join(side("b", "j", "right_id"), ["b", "j"])
    return met.select(F.least("left_id", "right_id").alias("x"), F.greatest("left_id", "right_id").alias("y"))
