"""Problem 6: differences between two copies of a data set.

Where a row lies, its body is reduced to two 128-bit digests, of the text and, for .json paths that hold
JSON, of the value; no body crosses the network.  Both sides are then reduced to one row per key
(repeated rows count once; of differing versions the one written last, then the greatest, counts), hashed into
buckets of bounded size and cogrouped as Arrow tables.  In a bucket the keys are sorted and aligned
by binary search, each compared column gives a vectorised null-aware mask, and only masked cells are
emitted.  Buckets are by the whole key (statement, path), so a statement with a third of all rows is
spread like any other.

Which statements exist on a side is a map-side combined aggregate over (statement); a statement
missing as a whole is one row, and its files are not reported again.

Defined results: two nulls are equal, a null and a value differ.  Null statements and paths are keys
like any other (null meets null).  Bodies of .json paths that are JSON on both sides are compared as
values (member order and layout ignored; list order, types and absent members kept; 1 equals 1.0);
all other values exactly.  Extra columns are ignored.  Empty sides make everything missing there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import jsontext
from loomspan.runtime import buckets_for, spread

KEY = ("statement", "path")
FIELDS = ("severity", "root_cols", "body")
#: Rows of both sides that share a bucket, on average; one task holds one bucket.
BUCKET_ROWS = 20_000
CELLS = "statement string, path string, kind string, field string"


def digests(side: DataFrame) -> DataFrame:
    """The rows with `raw`, the digest of the body, and `value`, that of its JSON value or null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            yield pd.Series([jsontext.digest(body) if path is not None and path.endswith(".json") else None for path, body in zip(pdf["path"], pdf["body"], strict=True)], dtype=object)

    value = F.pandas_udf(run, "binary")(F.struct("path", "body"))
    rows = spread(side.select(*KEY, "written_at", "severity", "root_cols", "body"))
    return rows.select(*(F.col(k).alias(k) for k in KEY), "written_at", "severity", "root_cols", F.unhex(F.md5("body")).alias("raw"), value.alias("value"))


def one_row_per_key(side: DataFrame) -> DataFrame:
    version = F.struct("written_at", "severity", "root_cols", "raw", "value")
    named = digests(side).groupBy(*KEY).agg(F.max(version).alias("v"))
    return named.select(*KEY, F.xxhash64(*KEY).alias("at"), "v.severity", "v.root_cols", "v.raw", "v.value")


def _keys(t: pa.Table) -> np.ndarray:
    """The key as one string, null apart from every text."""
    part = lambda c: pc.if_else(pc.is_null(t[c]), pa.scalar("0"), pc.binary_join_element_wise(pa.scalar("1"), t[c], ""))
    return np.array(pc.binary_join_element_wise(part("statement"), part("path"), "\x00").to_pylist(), dtype=object)


def aligned(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_align on the hashes of the keys; should two keys of a bucket share one, on the keys themselves."""
    a, b = left["at"].to_numpy(), right["at"].to_numpy()
    if len(np.unique(a)) == len(a) and len(np.unique(b)) == len(b):
        la, ra, lonly, ronly = _align(a, b)
        x, y = left.select(list(KEY)).take(pa.array(la)), right.select(list(KEY)).take(pa.array(ra))
        if not any(differing(x[k], y[k]).any() for k in KEY):
            return la, ra, lonly, ronly
    return _align(_keys(left), _keys(right))


def _align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of equal keys in a and b, and of those without partner, by sorted search."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[oa], b[ob]
    at = np.searchsorted(sb, sa)
    hit = np.zeros(len(sa), dtype=bool)
    inside = at < len(sb)
    hit[inside] = sb[at[inside]] == sa[inside]
    only_b = np.ones(len(sb), dtype=bool)
    only_b[at[hit]] = False
    return oa[hit], ob[at[hit]], oa[~hit], ob[only_b]


def differing(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Null-aware inequality of two aligned columns."""
    na, nb = pc.is_null(a).to_numpy(zero_copy_only=False), pc.is_null(b).to_numpy(zero_copy_only=False)
    unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return (na != nb) | unequal


_SIDE = pa.schema([("statement", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("severity", pa.string()), ("root_cols", pa.int32()), ("raw", pa.binary()), ("value", pa.binary())])


def compare_bucket(left: pa.Table, right: pa.Table) -> pa.Table:
    # A side without rows in a bucket comes without these columns.
    left, right = (t if "statement" in t.column_names else _SIDE.empty_table() for t in (left, right))
    la, ra, lonly, ronly = aligned(left, right)
    rows: list[pa.Table] = []

    def emit(t: pa.Table, at: np.ndarray, kind: str, field: str) -> None:
        if len(at):
            own = t.select(list(KEY)).take(pa.array(at))
            rows.append(pa.table([own["statement"].cast(pa.string()), own["path"].cast(pa.string()), pa.array([kind] * len(at)), pa.array([field] * len(at))], names=["statement", "path", "kind", "field"]))

    emit(left, lonly, "missing_right_file", "")
    emit(right, ronly, "missing_left_file", "")
    both_l, both_r = left.take(pa.array(la)), right.take(pa.array(ra))
    for c in FIELDS:
        mask = differing(both_l["raw" if c == "body" else c], both_r["raw" if c == "body" else c])
        if c == "body":
            mask &= ~pc.fill_null(pc.equal(both_l["value"], both_r["value"]), False).to_numpy(zero_copy_only=False)
        emit(left, la[mask], "content_diff", c)
    if rows:
        return pa.concat_tables(rows)
    return pa.table({n: pa.array([], pa.string()) for n in ("statement", "path", "kind", "field")})


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """p6_found: statement, path, kind, field."""
    n = left.count() + right.count()
    buckets = buckets_for(n, BUCKET_ROWS, 8)
    slot = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).alias("bucket")
    cells = one_row_per_key(left).groupBy(slot).cogroup(one_row_per_key(right).groupBy(slot)).applyInArrow(lambda a, b: compare_bucket(a, b), CELLS)
    sides = presence(left, right).select("statement", "in_left", "in_right")
    whole = sides.where("not (in_left and in_right)").select(
        "statement", F.lit("").alias("path"), F.when(F.col("in_left"), "missing_right").otherwise("missing_left").alias("kind"), F.lit("").alias("field")
    )
    alone = whole.select(F.col("statement").alias("gone"))
    return whole.unionByName(cells.join(alone, cells["statement"].eqNullSafe(alone["gone"]), "left_anti"))


def presence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per statement, its rows on either side."""
    one = left.select("statement", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("statement", F.lit(0).alias("l"), F.lit(1).alias("r")))
    return one.groupBy("statement").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).withColumns({"in_left": F.col("n_left") > 0, "in_right": F.col("n_right") > 0})


def summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences per kind and field."""
    return compare(left, right).groupBy("kind", "field").agg(F.count("*").alias("n_cells"), F.count_distinct("statement").alias("n_statements"))
