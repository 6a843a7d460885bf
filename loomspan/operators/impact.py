"""Questions asked of the lineage of a whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.names import plain_name, table_name
from loomspan.operators import lineage
from loomspan.plans import trace as walk
from loomspan.runtime import broadcast_if_small, buckets_for, stored

BUCKET_EDGES = 100_000
#: Edges of a statement that one task may hold.
GROUP_EDGES = 200_000


def column_usage(a: DataFrame) -> DataFrame:
    """Physical columns and what they feed: statements and result columns, over all statements."""
    e = lineage.end_to_end(a).where("source_table is not null")
    return e.groupBy("source_table", "source_column").agg(F.count_distinct("stmt").alias("n_statements"), F.count_distinct("stmt", "ordinal").alias("n_outputs"))


def feeds(a: DataFrame) -> DataFrame:
    """Every physical column with the result columns it feeds directly, in any statement."""
    return lineage.end_to_end(a).where("source_table is not null").select("source_table", "source_column", "stmt", "target_table", "name", "transform").distinct()


def downstream(a: DataFrame, table: str, column: str) -> DataFrame:
    """Result columns that the given physical column feeds directly, in any statement."""
    return feeds(a).where((F.col("source_table") == table) & (F.col("source_column") == column)).select("stmt", "target_table", "name", "transform")


def task_links(a: DataFrame) -> DataFrame:
    """Column links between tables across statements: what is written feeds what reads it."""
    e = lineage.end_to_end(a).where("source_table is not null and target_table is not null")
    return e.select(table_name("source_table").alias("from_table"), plain_name("source_column").alias("from_column"), table_name("target_table").alias("to_table"), plain_name("name").alias("to_column")).distinct()


def reachable(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Columns reached from `starts` (table_name, column_name) over links of any length, with the least number of
    steps.  Breadth first over the corpus: a round joins what was reached last with the links and
    drops what was reached before; it ends when a round finds nothing."""
    links = stored(links.select("from_table", "from_column", "to_table", "to_column").distinct())
    wave = starts.select("table_name", "column_name").distinct().withColumn("steps", F.lit(0))
    seen, at = stored(wave), 0
    wave = seen
    while True:
        at += 1
        near = broadcast_if_small(wave)
        step = links.join(near, (F.col("from_table") == F.col("table_name")) & (F.col("from_column") == F.col("column_name"))).select(F.col("to_table").alias("table_name"), F.col("to_column").alias("column_name")).distinct()
        wave = stored(step.join(seen.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti").withColumn("steps", F.lit(at)))
        if wave.isEmpty():
            return seen
        seen = stored(seen.unionByName(wave))


def reach_of_sources(a: DataFrame) -> DataFrame:
    """Columns reached from the columns of every table that is read but written by no statement, with the least
    number of steps from any of them.  Statements are analysed once."""
    e = lineage.end_to_end(a).where("target_table is not null").select(table_name("source_table").alias("from_table"), plain_name("source_column").alias("from_column"), table_name("target_table").alias("to_table"), plain_name("name").alias("to_column"))
    e = stored(e.distinct())
    links = e.where("from_table is not null")
    written = e.select(F.col("to_table").alias("from_table")).distinct()
    starts = links.select("from_table", "from_column").join(written, "from_table", "left_anti").select(F.col("from_table").alias("table_name"), F.col("from_column").alias("column_name"))
    return reachable(links, starts)


def traces(a: DataFrame, scope: str | None = None) -> DataFrame:
    """The leaves of every column of every scope (or of one scope), constants and system values
    kept, and how many columns were visited on the way: stmt, scope_id, name, leaf_scope, leaf_column,
    transform, n_visited.  Narrow: each statement is walked where it lies."""
    names = ("stmt", "scope_id", "name", "leaf_scope", "leaf_column", "transform", "n_visited")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int32()]
        for batch in batches:
            rows = []
            for stmt, own in zip(batch["stmt"].to_pylist(), batch["scopes"].to_pylist(), strict=True):
                columns = lineage.flat_columns({"scopes": own})
                ids = {s["scope_id"] for s in own}
                leaves = walk.Leaves(columns, ids)
                for at, name in dict.fromkeys((c[0], c[1]) for c in columns if scope is None or c[0] == scope):
                    visited = walk.upstream(columns, ids, at, name)["path_length"]
                    rows += [(stmt, at, name, *leaf, visited) for leaf in leaves.of(at, name)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=list(names))

    slim = F.transform("scopes", lambda s: F.struct(s["scope_id"].alias("scope_id"), F.transform(s["columns"], lambda c: F.struct(*(c[m].alias(m) for m in ("name", "transform", "merge_branch", "sources")))).alias("columns")))
    return a.where("status = 'ok'").select("stmt", slim.alias("scopes")).mapInArrow(run, "stmt string, scope_id string, name string, leaf_scope string, leaf_column string, transform string, n_visited int")


def upstream(a: DataFrame) -> DataFrame:
    """The way up of every result column: stmt, name, the links walked, from a source to what it feeds, once
    each, and whether the source is a physical column.  Narrow: each statement is walked where it lies."""
    fields = ("stmt", "name", "from_scope", "from_column", "to_scope", "to_column", "is_physical")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.bool_()]
        for batch in batches:
            rows = []
            for stmt, own in zip(batch["stmt"].to_pylist(), batch["scopes"].to_pylist(), strict=True):
                columns = lineage.flat_columns({"scopes": own})
                ids = {s["scope_id"] for s in own}
                for name in dict.fromkeys(c[1] for c in columns if c[0] == "ROOT"):
                    found = walk.upstream(columns, ids, "ROOT", name)
                    physical = set(found["physical"])
                    rows += [(stmt, name, *a, *b, a in physical) for a, b in dict.fromkeys(found["links"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=list(fields))

    slim = F.transform("scopes", lambda s: F.struct(s["scope_id"].alias("scope_id"), F.transform(s["columns"], lambda c: F.struct(*(c[m].alias(m) for m in ("name", "transform", "merge_branch", "sources")))).alias("columns")))
    return a.where("status = 'ok'").select("stmt", slim.alias("scopes")).mapInArrow(run, "stmt string, name string, from_scope string, from_column string, to_scope string, to_column string, is_physical boolean")


def table_impact(a: DataFrame) -> DataFrame:
    """Per source table: statements and targets it feeds."""
    t = a.where("status = 'ok'").select("stmt", "target_table", F.explode("source_tables").alias("source_table"))
    return t.groupBy("source_table").agg(F.count_distinct("stmt").alias("n_statements"), F.count_distinct("target_table").alias("n_targets"))


def stored_lineage(edges: DataFrame, group_edges: int = GROUP_EDGES) -> DataFrame:
    """End-to-end lineage over a stored edge table: for every ROOT column of a statement its physical
    sources.  Whole statements are packed into buckets of bounded size by hash and walked there; one with
    more than `group_edges` edges is spread over tasks, a round for each level."""
    once = edges.select("edge_id", "stmt_id", "to_scope", "to_column", "from_scope", "from_column", "edge_ordinal", "transform").distinct()
    once = once.where("stmt_id is not null")
    sizes = edges.groupBy("stmt_id").count()
    total, widest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    buckets = buckets_for(total, BUCKET_EDGES, 8)
    large = broadcast_if_small(sizes.where(F.col("count") > group_edges).select(F.col("stmt_id").alias("big")))
    small = once if widest <= group_edges else once.join(large, F.col("stmt_id") == F.col("big"), "left_anti")

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        # statement -> (scope, column, transform) -> sources, in order
        found: dict[int, dict[tuple, list]] = {}
        pdf = pdf.sort_values(["stmt_id", "to_scope", "to_column", "edge_ordinal"], kind="stable")
        for stmt, scope, name, transform, s, c in zip(*(pdf[x].tolist() for x in ("stmt_id", "to_scope", "to_column", "transform", "from_scope", "from_column")), strict=True):
            sources = found.setdefault(stmt, {}).setdefault((scope, name, transform or "DIRECT"), [])
            if s is not None:
                sources.append((s, c or ""))
        out: dict[tuple, None] = {}
        for stmt, own in found.items():
            columns = [(scope, name, transform, None, sources) for (scope, name, transform), sources in own.items()]
            roots = list(dict.fromkeys(("ROOT", c[1], None) for c in columns if c[0] == "ROOT"))
            for r in walk.end_to_end(columns, {c[0] for c in columns}, roots) if roots else []:
                out.update(dict.fromkeys((stmt, r["name"], s["scope"], s["column"]) for s in r["sources"]))
        return pd.DataFrame(list(out), columns=["stmt_id", "name", "source_table", "source_column"])

    out = small.groupBy(F.pmod(F.xxhash64("stmt_id"), F.lit(buckets)).alias("bucket")).applyInPandas(trace, "stmt_id bigint, name string, source_table string, source_column string")
    return out if widest <= group_edges else out.unionByName(_spread(once.join(large, F.col("stmt_id") == F.col("big"), "left_semi")))


def _spread(edges: DataFrame) -> DataFrame:
    """The same for statements beyond a task: all result columns go up a step a round, spread by column."""
    e = stored(edges.where("from_scope is not null").select(F.col("stmt_id").alias("e_stmt"), F.col("to_scope").alias("e_scope"), F.coalesce("to_column", F.lit("")).alias("e_column"), F.col("from_scope").alias("up_scope"), F.coalesce("from_column", F.lit("")).alias("up_column")).distinct())
    own = stored(edges.select(F.col("stmt_id").alias("o_stmt"), F.col("to_scope").alias("o_scope")).distinct())
    key = ["stmt_id", "name", "scope", "column"]
    wave = stored(edges.where("to_scope = 'ROOT'").select("stmt_id", F.coalesce("to_column", F.lit("")).alias("name"), F.col("to_scope").alias("scope"), F.coalesce("to_column", F.lit("")).alias("column")).distinct())
    seen = wave
    while not wave.isEmpty():
        met = wave.join(e, (F.col("stmt_id") == F.col("e_stmt")) & (F.col("scope") == F.col("e_scope")) & (F.col("column") == F.col("e_column")))
        wave = stored(met.select("stmt_id", "name", F.col("up_scope").alias("scope"), F.col("up_column").alias("column")).distinct().join(seen, key, "left_anti"))
        seen = stored(seen.unionByName(wave))
    ends = seen.where(~F.col("scope").isin(*walk.LEAVES)).join(own, (F.col("stmt_id") == F.col("o_stmt")) & (F.col("scope") == F.col("o_scope")), "left_anti")
    return ends.select("stmt_id", "name", F.col("scope").alias("source_table"), F.col("column").alias("source_column"))


def stored_usage(edges: DataFrame) -> DataFrame:
    """Physical tables by the statements and result columns they feed, over a stored edge table."""
    return stored_lineage(edges).groupBy("source_table").agg(F.count_distinct("stmt_id").alias("n_statements"), F.count_distinct("stmt_id", "name").alias("n_outputs"))
