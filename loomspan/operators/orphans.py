"""Problem 4: references to records that do not exist.

References are resolved against three targets: the columns of the same statement's scopes, the
catalogue's columns alive at the reference's time, and the issue codes alive then.  What meets no
target is a direct orphan; its reason says whether the target never existed, was gone or came later.

The fixpoint cascade then follows the foreign keys down: a column fed by an orphaned edge is itself
orphaned, so every edge that reads it inherits the fault, and so on until a round adds nothing.  A
round is a semi-join of the edges not yet reached with the columns reached last.  Edges of a statement
never feed another statement, so statements are packed by hash into buckets and a bucket's rounds are
run in one task on sorted keys.  A statement with more than GROUP_EDGES edges is spread over tasks
by column instead.  There a round for every step of a long chain would never end, so columns with a
single source are first tied to the column their chain starts from (pointer doubling, a round for
every doubling of the chain's length), and the semi-joins run between those anchors only.

Defined results: repeated rows count once.  The pseudo sources and `*` are recognised as they are
written, so a quoted `*` is a reference like any other; names are compared trimmed, without backticks,
in lower case, tables by their last two parts.  A null from_scope is no reference; a null from_column
is the name ''.  A null time is never within a span of life.  Null and empty maps give no references.
Empty targets make every reference missing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.names import plain_name, table_name
from loomspan.runtime import broadcast_if_small, buckets_for, cut, stored

GROUP_EDGES = 200_000
BUCKET_EDGES = 100_000
PSEUDO = ("CONSTANT", "SYSTEM", "UNKNOWN")


def lives(spans: DataFrame, key: Column, start: str, end: str) -> DataFrame:
    """Per key, its spans of life.  One row per key however often it was declared."""
    return spans.select(key.alias("key"), F.struct(F.col(start).alias("s"), F.col(end).alias("e")).alias("span")).groupBy("key").agg(F.collect_set("span").alias("spans"))


def reason_at(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """refs(key, at, ...) with `reason`: null where the target is alive at `at` or key is null.  The
    target side is broadcast only if a count finds it small; else it is a shuffle join on the key."""
    t = broadcast_if_small(targets.withColumnRenamed("key", "target_key"))
    at = F.col("at")
    alive = F.exists("spans", lambda x: F.coalesce((x["s"] <= at) & (x["e"].isNull() | (at < x["e"])), F.lit(False)))
    gone = F.exists("spans", lambda x: F.coalesce(x["e"] <= at, F.lit(False)))
    why = F.when(F.col("key").isNull(), None).when(F.col("target_key").isNull(), "missing").when(alive, None).when(gone, "deleted").otherwise("late")
    return refs.join(t, F.col("key") == F.col("target_key"), "left").withColumn("reason", why).drop("target_key", "spans")


def marked_edges(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """The edges, repeated rows once, each with its target's kind, and for a source that does not
    exist the reason and the key."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    column = F.coalesce(plain_name("from_column"), F.lit(""))
    is_ref = F.col("from_scope").isNotNull() & ~F.col("from_scope").isin(*PSEUDO) & (text("from_column") != "*")
    inner = (F.col("from_scope") == "ROOT") | F.contains("from_scope", F.lit(":"))
    rows = edges.select("edge_id", "stmt_id", "to_scope", text("to_column").alias("to_column"), "from_scope", text("from_column").alias("from_column"), F.col("seen_at").alias("at")).distinct()
    rows = rows.withColumn("target", F.when(~is_ref, "none").when(inner, "scope").otherwise("catalog"))
    rows = rows.withColumn("key", F.when(F.col("target") == "catalog", F.concat_ws("|", table_name("from_scope"), column)))
    rows = cut(reason_at(rows, lives(catalog, F.concat_ws("|", table_name("table_key"), plain_name("name")), "created_at", "deleted_at")))
    given = rows.where("to_scope is not null").select(F.col("stmt_id").alias("t_stmt"), F.col("to_scope").alias("t_s"), F.col("to_column").alias("t_c"), F.lit(True).alias("there")).distinct()
    same = F.col("stmt_id").eqNullSafe(F.col("t_stmt")) & (F.col("from_scope") == F.col("t_s")) & (F.col("from_column") == F.col("t_c"))
    inside = rows.where("target = 'scope'").join(given, same, "left").withColumns({"reason": F.when(F.col("there").isNull(), "missing"), "key": F.concat_ws("|", "from_scope", "from_column")})
    return rows.where("target <> 'scope'").unionByName(inside.drop("t_stmt", "t_s", "t_c", "there"))


def direct_codes(audits: DataFrame, kinds: DataFrame) -> DataFrame:
    """Issue codes of audit records that no kind alive then has."""
    refs = audits.select("audit_id", "audited_at", F.explode(F.map_keys("issues")).alias("code")).select("audit_id", F.col("audited_at").alias("at"), plain_name("code").alias("key")).distinct()
    return reason_at(refs, lives(kinds, plain_name("issue_code"), "added_at", "retired_at")).where("reason is not null")


def found(edges: DataFrame, catalog: DataFrame, audits: DataFrame, kinds: DataFrame) -> DataFrame:
    """p4_found: the orphans of the cascade's round 0 and the issue codes, which nothing hangs under."""
    a = cascade(edges, catalog).where("round = 0").select(F.lit("column_edges").alias("ref_table"), F.col("edge_id").alias("ref_id"), "ref_key", "reason", "period")
    b = direct_codes(audits, kinds).select(F.lit("audit_records").alias("ref_table"), F.col("audit_id").alias("ref_id"), F.col("key").alias("ref_key"), "reason", F.date_format("at", "yyyy-MM").alias("period"))
    return a.unionByName(b)


# -- cascade ----------------------------------------------------------------------------------------


def spread_fault(to: np.ndarray, source: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Rounds over the edges of a bucket: `to` and `source` are codes of columns, `level` 0 for
    directly orphaned edges, else -1.  Gives each edge's round, -1 where the fault never comes."""
    level = level.copy()
    faulty = np.zeros(int(max(to.max(initial=-1), source.max(initial=-1))) + 1, dtype=bool)
    wave, at = np.flatnonzero(level == 0), 0
    by_source = np.argsort(source, kind="stable")
    start = np.searchsorted(source[by_source], np.arange(len(faulty) + 1))
    while len(wave):
        reached = np.unique(to[wave])
        reached = reached[~faulty[reached]]
        faulty[reached] = True
        counts = start[reached + 1] - start[reached]
        ix = np.repeat(start[reached], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        readers = by_source[ix]
        wave = readers[level[readers] < 0]
        at += 1
        level[wave] = at
    return level


def cascade(edges: DataFrame, catalog: DataFrame, group_edges: int = GROUP_EDGES) -> DataFrame:
    """Every orphaned edge: edge_id, stmt_id, ref_key, reason, period, round (0: direct, with the
    target's reason; later rounds: reason 'inherited')."""
    name = lambda s, c: F.concat_ws("|", F.col(s), F.col(c))
    columns = ["edge_id", "stmt_id", "ref_key", "reason", "period", "round"]
    marked = cut(
        marked_edges(edges, catalog).select(
            "edge_id", "stmt_id", name("to_scope", "to_column").alias("to_key"), F.when(F.col("from_scope").isNotNull(), name("from_scope", "from_column")).alias("from_key"),
            F.col("key").alias("ref_key"), "reason", F.date_format("at", "yyyy-MM").alias("period"), F.when(F.col("reason").isNull(), -1).otherwise(0).alias("round"),
        )
    )
    sizes = marked.groupBy("stmt_id").count()
    large = sizes.where(F.col("count") > group_edges).select(F.col("stmt_id").alias("big"))
    n, widest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    small = marked if widest <= group_edges else marked.join(large, F.col("stmt_id").eqNullSafe(F.col("big")), "left_anti")

    def rounds(pdf: pd.DataFrame) -> pd.DataFrame:
        # One more code for the readers of nothing: null sources share it, and no edge leads to it.
        group = pdf["stmt_id"].astype("Int64").factorize(use_na_sentinel=False)[0]
        key = pd.MultiIndex.from_arrays([np.r_[group, group], np.r_[pdf["to_key"].to_numpy(), pdf["from_key"].fillna("\x00").to_numpy()]])
        codes = key.factorize()[0]
        pdf["round"] = spread_fault(codes[: len(pdf)], codes[len(pdf) :], pdf["round"].to_numpy()).astype("int32")
        pdf.loc[pdf["round"] > 0, "reason"] = "inherited"
        return pdf.loc[pdf["round"] >= 0, columns]

    schema = "edge_id bigint, stmt_id bigint, ref_key string, reason string, period string, round int"
    out = small.groupBy(F.pmod(F.xxhash64("stmt_id"), F.lit(buckets_for(n, BUCKET_EDGES, 8))).alias("bucket")).applyInPandas(rounds, schema)
    if widest <= group_edges:
        return out
    rest = marked.join(large, F.col("stmt_id").eqNullSafe(F.col("big")), "left_semi")
    return out.unionByName(_spread(stored(rest), columns))


def _spread(edges: DataFrame, columns: list[str]) -> DataFrame:
    """The cascade of statements beyond a task: levels of columns by anchors, then of edges."""
    here = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # A column is an anchor if it is directly orphaned (level 0) or has several sources.
    cols = edges.groupBy("stmt_id", F.col("to_key").alias("col")).agg(F.count("*").alias("n"), F.min("from_key").alias("src"), F.max("round").alias("direct"))
    single = (F.col("n") == 1) & (F.col("direct") < 0) & F.col("src").isNotNull()
    state = stored(cols.select("stmt_id", "col", F.when(single, F.col("src")).otherwise(F.col("col")).alias("up"), F.when(single, 1).otherwise(0).cast("bigint").alias("dist"), (~single).alias("done"), F.when(F.col("direct") == 0, F.lit(0).cast("bigint")).alias("level")))
    n, reach = state.count(), 1
    while reach <= n and not state.where("not done").isEmpty():
        above = state.select(F.col("stmt_id").alias("a_stmt"), F.col("col").alias("a_col"), F.col("up").alias("a_up"), F.col("dist").alias("a_dist"), F.col("done").alias("a_done"))
        step = state.where("not done").join(above, here("stmt_id", "a_stmt") & (F.col("up") == F.col("a_col")), "left")
        # What no edge leads to ends a chain; its anchor has no level, so nothing is inherited from it.
        moved = step.select("stmt_id", "col", F.coalesce("a_up", "up").alias("up"), (F.col("dist") + F.coalesce("a_dist", F.lit(0))).alias("dist"), F.coalesce("a_done", F.lit(True)).alias("done"), "level")
        state = stored(state.where("done").unionByName(moved))
        reach *= 2
    tied = state.where("done").select(F.col("stmt_id").alias("t_stmt"), F.col("col").alias("t_col"), "up", "dist")
    join = state.where("dist = 0 and done").select(F.col("stmt_id").alias("j_stmt"), F.col("col").alias("j_col"))
    into = edges.where("round < 0 and from_key is not null").join(join, here("stmt_id", "j_stmt") & (F.col("to_key") == F.col("j_col")), "left_semi")
    hops = stored(into.join(tied, here("stmt_id", "t_stmt") & (F.col("from_key") == F.col("t_col"))).groupBy("stmt_id", F.col("up").alias("h_from"), F.col("to_key").alias("h_to")).agg((F.min("dist") + 1).alias("far")))
    levels = stored(state.where("level = 0").select("stmt_id", F.col("col").alias("anchor"), "level"))
    wave = levels
    while not wave.isEmpty():
        w = wave.select(F.col("stmt_id").alias("w_stmt"), F.col("anchor").alias("w_col"), F.col("level").alias("w_level"))
        met = hops.join(w, here("stmt_id", "w_stmt") & (F.col("h_from") == F.col("w_col"))).groupBy("stmt_id", F.col("h_to").alias("anchor")).agg(F.min(F.col("w_level") + F.col("far")).alias("level"))
        old = levels.select(F.col("stmt_id").alias("o_stmt"), F.col("anchor").alias("o_col"), F.col("level").alias("o_level"))
        wave = stored(met.join(old, here("stmt_id", "o_stmt") & (F.col("anchor") == F.col("o_col")), "left").where("o_level is null or level < o_level").select("stmt_id", "anchor", "level"))
        levels = stored(levels.unionByName(wave).groupBy("stmt_id", "anchor").agg(F.min("level").alias("level")))
    of = levels.select(F.col("stmt_id").alias("l_stmt"), "anchor", F.col("level").alias("base"))
    faulty = tied.join(broadcast_if_small(of), here("t_stmt", "l_stmt") & (F.col("up") == F.col("anchor"))).select("t_stmt", "t_col", (F.col("base") + F.col("dist")).alias("fault"))
    heirs = edges.where("round < 0").join(faulty, here("stmt_id", "t_stmt") & (F.col("from_key") == F.col("t_col"))).withColumns({"round": (F.col("fault") + 1).cast("int"), "reason": F.lit("inherited")})
    return edges.where("round = 0").select(*columns).unionByName(heirs.select(*columns))


def report(edges: DataFrame, catalog: DataFrame, audits: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per table and month: direct orphans by reason, and inherited ones."""
    per = lambda df: df.groupBy("ref_table", "period").agg(*(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "deleted", "late", "inherited")))
    spread = cascade(edges, catalog).select(F.lit("column_edges").alias("ref_table"), "period", "reason")
    codes = direct_codes(audits, kinds).select(F.lit("audit_records").alias("ref_table"), F.date_format("at", "yyyy-MM").alias("period"), "reason")
    return per(spread.unionByName(codes))
