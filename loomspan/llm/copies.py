"""Problem 3: records that differ only in layout.

Each body is read as JSON, and of its task_name and sql only the words count: runs of letters and
digits of any script, in lower case.  Member order, white space, punctuation, case and all other
members drop out.  The canonical form is hashed to 128 bits, with an independent 64-bit check beside
it; copies are counted by a hash aggregate that combines in the mappers, so a group with a third of
all rows costs each mapper one row.  Two forms that meet in 128 bits but not in the check would be
kept apart and are reported by `colliding`.

Defined results: null bodies and bodies that are not one complete JSON object belong to no group.
An absent or null member has no words; a member that is no text counts as its JSON text.  Repeated
rows of a file_id count once; of different bodies under one file_id the one with the least hash counts.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import jsontext
from loomspan.runtime import broadcast_if_small, cut, spread

#: Groups of more copies than this are matched by broadcast; there are at most rows / HOT of them.
HOT = 100_000

_HASHED = "file_id bigint, h1 bigint, h2 bigint, check bigint"


def canonical(document: dict) -> bytes:
    """The words of both members, the members apart."""
    words = re.compile(r"[^\W_]+").findall
    return "\x1e".join("\x1f".join(w.lower() for w in words(jsontext.as_text(document.get(m)))) for m in ("task_name", "sql")).encode()


def hashed(files: DataFrame) -> DataFrame:
    """file_id with the 128-bit hash and the check of its canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for file_id, body in zip(batch["file_id"].to_pylist(), batch["body"].to_pylist(), strict=True):
                ok, document = jsontext.parse(body)
                if ok and isinstance(document, dict):
                    form = canonical(document)
                    a = hashlib.blake2b(form, digest_size=16).digest()
                    b = hashlib.sha256(form).digest()
                    ids.append(file_id)
                    digests.append([int.from_bytes(x, "little", signed=True) for x in (a[:8], a[8:], b[:8])])
            columns = list(zip(*digests, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["file_id", "h1", "h2", "check"])

    return spread(files.select("file_id", "body")).where("file_id is not null and body is not null").mapInArrow(run, _HASHED)


def groups(rows: DataFrame) -> DataFrame:
    """h1, h2, check, keep_id, n_files."""
    once = rows.groupBy("file_id").agg(F.min(F.struct("h1", "h2", "check")).alias("f")).select("file_id", "f.*")
    return once.groupBy("h1", "h2", "check").agg(F.min("file_id").alias("keep_id"), F.count("*").alias("n_files"))


def records(files: DataFrame) -> DataFrame:
    """One row per task: the file kept and how many copies it had."""
    return groups(hashed(files)).select("keep_id", "n_files")


def colliding(rows: DataFrame) -> DataFrame:
    """128-bit hashes that stand for more than one canonical form; expected to be empty."""
    return groups(rows).groupBy("h1", "h2").agg(F.count("*").alias("n_forms")).where("n_forms > 1")


def collision_check(files: DataFrame) -> DataFrame:
    """One row: canonical forms, their 128-bit hashes, and hashes that stand for several forms."""
    per = groups(hashed(files)).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_forms"), F.count("*").alias("n_hashes"), F.count_if(F.col("n") > 1).alias("n_collisions"))


def found(files: DataFrame, hot: int = HOT) -> DataFrame:
    """p3_found: keep_id, copy_id.  Files of very large groups meet their group by broadcast, so no
    task receives such a group; the others by a shuffle join on the hash."""
    rows = cut(hashed(files).groupBy("file_id").agg(F.min(F.struct("h1", "h2", "check")).alias("f")).select("file_id", "f.*"))
    several = cut(groups(rows).where("n_files > 1"))
    key = ["h1", "h2", "check"]
    large = broadcast_if_small(several.where(F.col("n_files") > hot).select(*key, F.col("keep_id").alias("hot_id")))
    told = rows.join(large, key, "left")
    a = told.where("hot_id is not null").select(F.col("hot_id").alias("keep_id"), F.col("file_id").alias("copy_id"))
    rest = several.where(F.col("n_files") <= hot).select(*key, "keep_id")
    b = told.where("hot_id is null").join(rest, key).select("keep_id", F.col("file_id").alias("copy_id"))
    return a.unionByName(b).where("keep_id <> copy_id")


def feed_report(files: DataFrame) -> DataFrame:
    """Per feed: files that are kept and files that are copies of another."""
    pairs = found(files).select(F.col("copy_id").alias("file_id"), F.lit(1).alias("is_copy"))
    named = files.select("file_id", "feed").distinct().join(pairs, "file_id", "left")
    return named.groupBy("feed").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("is_copy"), F.lit(0)).alias("n_copies"))
