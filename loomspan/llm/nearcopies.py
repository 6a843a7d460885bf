"""Problem 5: groups of tasks that share most of their text.

The likeness of two tasks is the Jaccard likeness of their sets of three-word sequences; tasks with
the same set are one class, so copies enter the join once.

Chosen-path join: in each of RUNS independent runs a set starts on one path and, step by step, goes
on along each of its tokens t for which a hash of (path, t) is below 1 / (LIKENESS * size).  Two sets
with the likeness asked for take at least one common step per path on average, so their common paths
do not die out, while those of unlike sets shrink by a constant factor per step.  Paths of START
steps are the buckets.  Buckets of up to BRUTE classes are compared within; those of larger ones are
compared too, block by block, so every pair that meets in a bucket of any size is seen.  Splitting
large buckets further would lose the pairs whose common path ends on the way, those of one template
together.  A run finds a pair at the threshold with probability 0.50 if the sets
are of equal size and 0.37 if one contains the other, so all runs miss it with probability 0.00002
and 0.0006, and pairs above it far less often; tests measure recall against brute force.  Every
candidate is then checked exactly on the sets.

The texts are read once to give each task its paths and a sketch (about half a kilobyte); the sets
themselves are made again only for the tasks of a candidate pair that passes the sketches.

Defined results: null names and texts count as empty; tasks with fewer than three words have no
sequences and are like nothing.  Repeated rows of a task_id count once (of different texts under one
task_id the one with the greatest set hash).  Any likeness is exact; equal sets have likeness 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm import blocks
from loomspan.operators.components import components
from loomspan.runtime import broadcast_if_small, cut, spread

WORDS = 3
LIKENESS = 0.65
RUNS = 16
START = 3
BRUTE = 64
#: Bits of the sketch that screens candidates, and the least that must agree: at the threshold
#: 105.6 of 128 are expected to, with a deviation of 4.3, so the screen stands 5.4 deviations below.
SKETCH_BITS = 128
SKETCH_LEAST = 82
BLOCK = 256
#: Tokens of a set worked on at once, so that a very long text needs no more memory than others.
CHUNK = 8192

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on arrays."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def sequences(text: str, known: dict[str, int], words: int = WORDS) -> np.ndarray:
    """The distinct word sequences of a text as sorted 64-bit hashes."""
    # Lowering may add characters that end a word, so only ASCII is lowered as a whole.
    found = re.findall(r"\w+", text.lower()) if text.isascii() else [w.lower() for w in re.findall(r"\w+", text)]
    if len(found) < words:
        return np.empty(0, dtype=_U)
    if len(known) > 200_000:
        known.clear()
    for w in found:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w.encode())
    codes = np.fromiter(map(known.__getitem__, found), dtype=_U, count=len(found))
    n = len(found) - words + 1
    h = np.zeros(n, dtype=_U)
    for k in range(words):
        h = mix(h + codes[k : k + n])
    return np.unique(h)


def start_paths(runs: int = RUNS) -> np.ndarray:
    return mix(np.arange(1, runs + 1, dtype=_U) * _U(0xD6E8FEB86659FD93))


def step(paths: np.ndarray, tokens: np.ndarray, likeness: float = LIKENESS) -> np.ndarray:
    """One step of a set from its paths along its tokens.  Both are mixed already, so one product and
    shift makes a hash of the two."""
    if not len(paths) or not len(tokens):
        return np.empty(0, dtype=_U)
    bound = _U(min(2**64 - 1, int(2**64 / (likeness * len(tokens)))))
    kept = []
    for at in range(0, len(tokens), CHUNK):
        hashes = (paths[:, None] ^ tokens[None, at : at + CHUNK]) * _U(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> _U(32)
        kept.append(hashes[hashes < bound])
    return np.unique(mix(np.concatenate(kept) + _U(0x632BE59BD9B4E019)))


def _seeds() -> np.ndarray:
    return mix(np.arange(1, SKETCH_BITS + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def sketch(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One bit of the least product per seed, packed into signed 64-bit words."""
    least = np.min([(tokens[at : at + CHUNK, None] * seeds[None, :]).min(axis=0) for at in range(0, len(tokens), CHUNK)], axis=0)
    return np.packbits((mix(least) & _U(1)).astype(np.uint8)).view(np.int64)


def _texts(tasks: DataFrame, key: str) -> DataFrame:
    text = F.concat(F.coalesce("task_name", F.lit("")), F.lit(" "), F.coalesce("sql", F.lit("")))
    return tasks.where("task_id is not null").select(F.col("task_id").alias(key), text.alias("text"))


def _list(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in parts])], pa.int32()), pa.array(flat, pa.int64()))


def signatures(tasks: DataFrame) -> DataFrame:
    """task_id, set_hash (128 bits), size, sketch and start paths; tasks without sequences left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seeds, starts = {}, _seeds(), start_paths()
        for batch in batches:
            rows = []
            for task, text in zip(batch["task_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                t = sequences(text, known)
                if len(t):
                    paths = starts
                    for _ in range(START):
                        paths = step(paths, t)
                    rows.append((task, xxhash.xxh3_128_digest(t.tobytes()), len(t), *sketch(t, seeds).tolist(), paths))
            ids, hashes, sizes, s1, s2, paths = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), _list(list(paths))], names=["task_id", "set_hash", "size", "s1", "s2", "paths"])

    return spread(_texts(tasks, "task_id")).mapInArrow(run, "task_id bigint, set_hash binary, size int, s1 bigint, s2 bigint, paths array<bigint>")


def token_sets(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """id, tokens of the tasks in `ids`, as often as the task is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            sets = [sequences(t, known) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], _list(sets)], names=["id", "tokens"])

    return _texts(tasks, "id").join(broadcast_if_small(ids.distinct()), "id", "left_semi").mapInArrow(run, "id bigint, tokens array<bigint>")


def _pairs_of(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All pairs within groups of a flat array, groups of one size at a time."""
    out = []
    for g in np.unique(sizes[(sizes > 1) & (sizes <= BRUTE)]).tolist():
        block = np.sort(ids[starts[sizes == g][:, None] + np.arange(g)[None, :]], axis=1)
        i, j = np.triu_indices(g, 1)
        out.append(np.stack([block[:, i].ravel(), block[:, j].ravel()], axis=1))
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
    return pairs[pairs[:, 0] < pairs[:, 1]]  # a repeated task is no pair


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, id) sorted by path -> (path null, a, b) for each pair of a small bucket, (path, a, null)
    for each member of a large one.  A large bucket is passed on as it streams by, never held."""
    held_p, held_i = np.empty(0, np.int64), np.empty(0, np.int64)
    large: int | None = None

    def out(pairs: np.ndarray, paths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        n, m = len(pairs), len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(paths, pa.int64())]), pa.array(np.r_[pairs[:, 0], ids], pa.int64()), pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(m, pa.int64())])], names=["path", "a", "b"]
        )

    def close(p: np.ndarray, i: np.ndarray, last: bool) -> pa.RecordBatch:
        nonlocal held_p, held_i, large
        if not len(p):
            return out(np.empty((0, 2), np.int64), p, i)
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        sizes = np.diff(np.r_[first, len(p)])
        big = (sizes > BRUTE) | (p[first] == large if large is not None else False)
        keep = not last and not big[-1]
        large = int(p[-1]) if big[-1] else None
        if keep:
            held_p, held_i = p[first[-1] :], i[first[-1] :]
            first, sizes, big = first[:-1], sizes[:-1], big[:-1]
        else:
            held_p, held_i = np.empty(0, np.int64), np.empty(0, np.int64)
        member = np.repeat(big, sizes)
        n = len(member)
        return out(_pairs_of(i, first[~big], sizes[~big]), p[:n][member], i[:n][member])

    for batch in batches:
        yield close(np.r_[held_p, batch["path"].to_numpy()], np.r_[held_i, batch["id"].to_numpy()], False)
    yield close(held_p, held_i, True)


def _agree(likeness: float) -> Column:
    """Whether the sizes and sketches of a and b leave it open that they are alike by `likeness`."""
    bits = SKETCH_BITS - F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) - F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b")))
    return (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * (likeness - 1e-9)) & (bits >= SKETCH_LEAST)


def _side(classes: DataFrame, n: str, *others: str) -> DataFrame:
    return classes.select(*others, F.col("id").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("size", "s1", "s2")))


def _blocks(large: DataFrame, classes: DataFrame, likeness: float) -> DataFrame:
    """The pairs of the large buckets that pass the screen of size and sketch, block against block."""
    counts = large.groupBy("path").count()
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    placed = large.join(counts, "path").select("path", "id", blocks.alias("n"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    big = classes.select("id", "size", "s1", "s2").join(broadcast_if_small(placed), "id")
    pairs = big.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    left = _side(pairs, "a", "path", F.col("block").alias("i"), F.col("other").alias("j"))
    right = _side(pairs, "b", "path", F.col("other").alias("i"), F.col("block").alias("j"))
    return left.join(right, ["path", "i", "j"]).where((F.col("a") < F.col("b")) & _agree(likeness)).select("a", "b")


def candidates(classes: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """Distinct pairs of ids of classes(id, size, sketch, paths) that meet in a bucket; those of large buckets are
    screened already."""
    frontier = classes.select(F.explode("paths").alias("path"), "id")
    met = cut(frontier.repartition("path").sortWithinPartitions("path").mapInArrow(_buckets, "path bigint, a bigint, b bigint"))
    small = met.where("path is null").select("a", "b")
    large = met.where("path is not null").select("path", F.col("a").alias("id"))
    return (small if large.isEmpty() else small.unionByName(_blocks(large, classes, likeness))).distinct()


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    common = np.fromiter((len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)), dtype=np.float64, count=len(a))
    size = a.map(len).to_numpy() + b.map(len).to_numpy() - common
    return pd.Series(common / np.maximum(size, 1))


def links(classes: DataFrame, tasks: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """a, b, likeness of classes alike by at least `likeness`: candidates screened by size and sketch,
    then checked exactly on their sets."""
    near = cut(candidates(classes, likeness).join(_side(classes, "a"), "a").join(_side(classes, "b"), "b").where(_agree(likeness)).select("a", "b"))
    sets = token_sets(tasks, near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))))
    full = lambda n: sets.select(F.col("id").alias(n), F.col("tokens").alias(f"t_{n}"))
    scored = full("a").join(broadcast_if_small(near), "a").join(full("b"), "b").select("a", "b", F.pandas_udf(_jaccard, "double")("t_a", "t_b").alias("likeness"))
    return scored.where(F.col("likeness") >= likeness - 1e-9).distinct()


def classed(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task_id, class, n) and one (id, size, sketch, paths) per class; the class is its smallest task."""
    every = cut(signatures(tasks))
    once = every.groupBy("task_id").agg(F.max("set_hash").alias("set_hash"))
    first = once.groupBy("set_hash").agg(F.min("task_id").alias("class"), F.count("*").alias("n"))
    several = first.where("n > 1")
    member = cut(once.join(several, "set_hash", "left").select("task_id", F.coalesce("class", "task_id").alias("class"), F.coalesce("n", F.lit(1)).alias("n")))
    own = every.join(first.select("set_hash", F.col("class").alias("task_id")), ["task_id", "set_hash"], "left_semi").dropDuplicates(["task_id"])
    return member, own.withColumnRenamed("task_id", "id")


def found(tasks: DataFrame) -> DataFrame:
    """p5_found: task_a, task_b, every pair of tasks alike by at least LIKENESS.  The tasks of a class meet
    block by block, so a class with a third of all tasks is no single task's work."""
    member, sets = classed(tasks)
    l = links(sets, tasks).select("a", "b")
    across = blocks.between(l, "a", "b", member, "class", "task_id")
    same = blocks.within(member.where("n > 1"), "class", "task_id").select("x", "y")
    return across.unionByName(same).select(F.col("x").alias("task_a"), F.col("y").alias("task_b"))


def groups(tasks: DataFrame) -> DataFrame:
    """One row per task: its class, the class's links to other classes, and its group (the smallest
    task reachable over links)."""
    member, sets = classed(tasks)
    l = cut(links(sets, tasks).select("a", "b"))
    degree = l.select(F.col("a").alias("class")).unionByName(l.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("n_links"))
    joined = components(l, "a", "b").withColumnRenamed("node", "class")
    return member.join(degree, "class", "left").join(joined, "class", "left").select("task_id", F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "class").alias("group_id"))
