"""Session-level helpers: checkpoints in the shared folder, size checks, partition counts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast only below this many rows (checked with a count of that side).
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.  A session that names none gets one of its own on a local master, as in
    tests; on a cluster that is an error, for a folder of one machine would not survive the loss of it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomspan-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut, by a table written under the shared checkpoint folder.  For loops of many rounds: what
    the optimiser knows of a checkpointed frame (constraints) is carried on and grows with every round, so
    planning alone would come to take minutes; a table read back starts afresh."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when a count proves that ``df`` has at most ``limit`` rows; otherwise ``df``
    as it is, for a shuffle join that adaptive execution can split where a key is hot."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def buckets_for(rows: int, per_bucket: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_bucket))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once_per_row(df: DataFrame, name: str, value) -> DataFrame:
    """Adds a column that is computed once for each row.  Behind a generator the optimiser cannot
    paste the expression into every place that reads it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


#: Below this many bytes a core, an input of few files is dealt out before costly Python stages.
SPREAD_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input, often one file of one row group, dealt out over all cores; others as they are.
    Decided from the plan's size alone, so nothing is run and no large input is ever shuffled."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df
