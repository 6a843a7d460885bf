"""Structured Streaming: a watched task folder into the fact store, and a running audit.

Analysis is a narrow stage, so it is the same on a stream; there is no state to keep for it, and the
file source with a checkpoint gives each file exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.functions.names import plain_name, table_name
from loomspan.operators import audit, lineage, orphans
from loomspan.sources import readers


def task_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Task JSON files as they arrive."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).schema("value string").load(folder)
    return readers.task_bodies(raw.select(F.col("value").alias("body"), F.input_file_name().alias("path")))


def analysed_stream(spark: SparkSession, folder: str, catalog: DataFrame | None = None) -> DataFrame:
    return lineage.analyze(task_stream(spark, folder).where("status = 'ok'"), catalog)


def store(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Analysed statements appended to a Parquet folder."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def orphan_references(edges: DataFrame, catalog: DataFrame, delay: str = "1 day", window: str = "1 hour") -> DataFrame:
    """References to catalogue columns that were missing, deleted or not yet there, on a stream of edges
    against a static catalogue: per window of sight, source table and reason.  An edge delivered again
    within `delay` counts once; a window is given out when the watermark, `delay` behind the newest edge,
    has passed it."""
    once = edges.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["edge_id"])
    refs = once.where(F.col("from_scope").isNotNull() & ~F.col("from_scope").isin("ROOT", *orphans.PSEUDO) & ~F.contains("from_scope", F.lit(":")) & (F.coalesce("from_column", F.lit("")) != "*"))
    refs = refs.select(F.col("seen_at").alias("at"), table_name("from_scope").alias("table_name"), F.concat_ws("|", table_name("from_scope"), F.coalesce(plain_name("from_column"), F.lit(""))).alias("key"))
    spans = orphans.lives(catalog, F.concat_ws("|", table_name("table_key"), plain_name("name")), "created_at", "deleted_at")
    found = orphans.reason_at(refs, spans).where("reason is not null")
    return found.groupBy(F.window("at", window), "table_name", "reason").agg(F.count("*").alias("n_edges")).select(F.col("window.start").alias("window_start"), "table_name", "reason", "n_edges")


def running_severity(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts by severity of all that has arrived, kept as one small table at `path`."""
    counts = audit.severity_counts(audit.audit(stream))
    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
