"""Problem 8: items of varying length into containers of fixed capacity.

An item longer than the capacity is cut into full pieces, each filling a container, and a rest; no
other item is cut.  How items are combined depends on their lengths alone, and there are at most
`capacity` of those, so the plan is made from the histogram of lengths - one small table however many
items there are - by minimum bin slack: a container is opened with the longest length left, a
subset-sum over the lengths still available (bitsets, each length used at most as often as it is
left) finds the fullest feasible combination, and that combination is taken as many times as the
stock allows, after which less of one of its lengths is left than the combination needs.  The lengths of the
largest items are used up from above, and tests bound the patterns by twice the lengths.

Items are then matched with the plan by their rank among the items of their length.  Ranks need no
task to see all items of a length (a third of all items may have the same): items are ranked inside
slices of their ids, and slices are offset by the counts of those before.  The plan is broadcast; its
size is bounded by the capacity, not by the data.

Defined results: items without tokens (null or empty texts) are left out.  Repeated rows are packed
as items of their own.  Equal lengths are interchangeable and ranked by id, so the result is the same
in every run.  No items give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.tokens import token_counts
from loomspan.runtime import cut

CAPACITY = 2048
#: Items per slice when ranking.
SLICE_ITEMS = 50_000

ASSIGNMENT = "doc_id bigint, piece_no int, start bigint, n_tokens int, container_id bigint, offset_in_container int"


def fullest(available: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of lengths (with counts) that leaves least of `room`; among equally full ones
    the one with the longest parts.  Subset-sum with counted parts on bitsets: bit s of a layer is
    set if sum s can be reached with the lengths up to that layer."""
    mask = (1 << (room + 1)) - 1
    layers: list[tuple[int, int, int, int]] = []
    reach = 1
    for length in sorted((k for k in available if k <= room), reverse=True):
        left = min(available[length], room // length)
        part = 1
        while left > 0 and not reach >> room & 1:
            n = min(part, left)
            layers.append((length, n, reach, 0))
            reach |= reach << length * n & mask
            left -= n
            part *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, n, before, _ in reversed(layers):
        if before >> at & 1:
            continue
        at -= length * n
        used[length] = used.get(length, 0) + n
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, count), ...]) patterns that use up the histogram exactly."""
    stock = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while stock:
        first = max(stock)
        rest = {k: v - (k == first) for k, v in stock.items() if v - (k == first) > 0}
        pattern: dict[int, int] = {first: 1}
        for length, n in fullest(rest, capacity - first):
            pattern[length] = pattern.get(length, 0) + n
        times = min(stock[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            stock[k] -= n * times
            if not stock[k]:
                del stock[k]
        out.append((times, sorted(pattern.items(), reverse=True)))
    return out


def plan_table(patterns: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """One row per pattern and length: ranks [first_rank, ...) of that length go, `per` to each, to
    the containers from `container` on, at `offset` within them."""
    rows, taken, container = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for length, per in pattern:
            rows.append((length, taken.get(length, 0), per, container, offset))
            taken[length] = taken.get(length, 0) + per * times
            offset += length * per
        container += times
    return pd.DataFrame(rows, columns=["length", "first_rank", "per", "container", "offset"], dtype=np.int64).sort_values(["length", "first_rank"], kind="stable")


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """Items cut where longer than the capacity: doc_id, piece_no, start, n_tokens."""
    full = F.expr(f"n_tokens div {capacity}")
    rest = F.col("n_tokens") % capacity
    cuts = F.sequence(F.lit(0).cast("bigint"), full - F.when(rest == 0, 1).otherwise(0))
    p = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(cuts).alias("piece_no"))
    return p.select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece_no") * capacity).cast("int").alias("n_tokens"))


def ranked(items: DataFrame, n_items: int) -> DataFrame:
    """Items with their rank among the items of the same length, without a task per length."""
    slices = max(8, n_items // SLICE_ITEMS)
    sliced = items.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(slices)).cast("int"))
    counts = sliced.groupBy("n_tokens", "slice").count()
    before = counts.select(F.col("n_tokens").alias("b_len"), F.col("slice").alias("b_slice"), (F.sum("count").over(Window.partitionBy("n_tokens").orderBy("slice")) - F.col("count")).alias("before"))  # one row a slice
    inside = sliced.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens", "slice").orderBy("doc_id", "piece_no")) - 1)
    return inside.join(before, (F.col("n_tokens") == F.col("b_len")) & (F.col("slice") == F.col("b_slice"))).select("doc_id", "piece_no", "start", "n_tokens", (F.col("r") + F.col("before")).alias("rank"))


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sizes(doc_id, n_tokens) -> the container and offsets of each item or piece."""
    items = cut(pieces(sizes, capacity))
    histogram = {r["n_tokens"]: r["count"] for r in items.groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    steps = plan_table(plan(histogram, capacity))
    shared = items.sparkSession.sparkContext.broadcast({c: steps[c].to_numpy(np.int64) for c in steps.columns})
    span = max(1, sum(histogram.values()))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        start_of = s["length"] * span + s["first_rank"]
        for pdf in batches:
            rank, length = pdf["rank"].to_numpy(np.int64), pdf["n_tokens"].to_numpy(np.int64)
            at = np.searchsorted(start_of, length * span + rank, side="right") - 1
            nth = rank - s["first_rank"][at]
            out = pdf[["doc_id", "piece_no", "start", "n_tokens"]].copy()
            out["container_id"] = s["container"][at] + nth // s["per"][at]
            out["offset_in_container"] = (s["offset"][at] + nth % s["per"][at] * length).astype(np.int32)
            yield out

    return ranked(items, sum(histogram.values())).mapInPandas(place, ASSIGNMENT)


def assignments(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_counts(documents), capacity)


def containers(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The fill of each container."""
    per = assignments(documents, capacity).groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used"))
    return per.withColumn("unused", F.lit(capacity) - F.col("used"))


def invariants(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What must not be in a packing, counted, as rows (broken, n): containers above the capacity, containers
    with gaps or overlaps between items, numbers without container, documents whose pieces are not exactly
    their tokens, and cuts of items that would have fitted whole."""
    sizes = cut(token_counts(documents).where("n_tokens > 0"))
    placed = cut(pack(sizes, capacity))
    per = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.max(F.col("offset_in_container") + F.col("n_tokens")).alias("end"), F.count_distinct("offset_in_container").alias("places"), F.count("*").alias("items"))
    boxes = per.agg(
        F.count_if(F.col("used") > capacity).alias("overfull"), F.count_if((F.col("used") != F.col("end")) | (F.col("places") != F.col("items"))).alias("with_gaps"),
        (F.coalesce(F.max("container_id") + 1, F.lit(0)) - F.count("*")).alias("unnumbered"),
    )
    whole = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("n_pieces"))
    size = sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows"), F.max("n_tokens").alias("longest"))
    items = size.join(whole, "doc_id", "full").agg(F.count_if(~F.col("tokens").eqNullSafe(F.col("placed"))).alias("misplaced"), F.count_if((F.col("longest") <= capacity) & (F.col("n_pieces") > F.col("n_rows"))).alias("needlessly_cut"))
    return boxes.unpivot([], boxes.columns, "broken", "n").unionByName(items.unpivot([], items.columns, "broken", "n"))


def summary(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers used, the least number that could hold the tokens, and the share filled."""
    c = containers(documents, capacity).agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"))
    return c.select("*", F.ceil(F.col("n_tokens") / capacity).alias("least_possible"), F.try_divide("n_tokens", F.col("n_containers") * capacity).alias("fill"))
