"""Objects and links of a statement for exploring it, validators over them, and the flat view.

Objects and links are arrays of the statement row, so a corpus is read and analysed once however many
kinds of them are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import lineage, profile
from loomspan.runtime import once_per_row

_KEY = ("task_id", "stmt_no", "stmt")

# What a column seems to be for, by pieces of its name; the first that has one counts.
ROLES = {
    "time_or_partition": ("dt", "date", "time", "begin", "start", "end"),
    "identifier": ("id", "key", "code", "no", "nbr"),
    "metric": ("amt", "amount", "cnt", "count", "num", "score", "rate", "days"),
    "classification": ("status", "state", "type", "flag", "ind", "channel", "result"),
}
OTHER_ROLE = "business_field"


def _id(kind: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws(".", *parts))


def field_role(name: Column) -> Column:
    """What a column seems to be for, from its name."""
    n = F.lower(F.coalesce(name, F.lit("")))
    has = lambda pieces: reduce(lambda a, b: a | b, (n.contains(p) for p in pieces))
    return F.coalesce(*(F.when(has(pieces), role) for role, pieces in ROLES.items()), F.lit(OTHER_ROLE))


def _root_columns() -> Column:
    return F.coalesce(F.filter("scopes", lambda s: s["scope_id"] == "ROOT")[0]["columns"], F.array())


def _sources() -> Column:
    """(result column, source) of the end-to-end lineage."""
    return F.flatten(F.transform("lineage", lambda l: F.transform(l["sources"], lambda x: F.struct(l["name"].alias("name"), x["scope"].alias("table"), x["column"].alias("column")))))


def _parts(a: DataFrame) -> DataFrame:
    """The analysed statements with what objects, links and findings share, made once a row."""
    out = a.where("status = 'ok'")
    doing = F.transform(_doing(), lambda s: F.struct(s["scope_id"].alias("scope_id"), F.concat_ws(",", profile.operations(s)).alias("operations")))
    for name, value in (("p_conditions", profile.condition_items()), ("p_sources", _sources()), ("p_root", _root_columns()), ("p_doing", doing), ("p_named", F.transform("scopes", lambda s: s["scope_id"]))):
        out = once_per_row(out, name, value)
    return out


def _object(object_id: Column, kind: str, name: Column, detail: Column) -> Column:
    return F.struct(object_id.alias("object_id"), F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail"))


def _object_items() -> Column:
    c = F.col
    condition = lambda x, i: _object(_id("rule", x["scope_id"], i.cast("string")), "rule", x["expression"], x["shape"])
    physical = F.array_distinct(F.concat(F.transform("p_sources", lambda x: F.struct(x["table"].alias("scope"), x["column"].alias("column"))), F.flatten(F.transform("p_conditions", lambda x: x["physical"]))))
    every = F.concat(
        F.transform("scopes", lambda s: _object(_id("scope", s["scope_id"]), "scope", s["scope_id"], lineage.role(s))),
        F.transform("p_root", lambda x: _object(_id("column", x["name"]), "column", x["name"], field_role(x["name"]))),
        F.transform(c("source_tables"), lambda t: _object(_id("table", t), "table", t, F.lit("input"))),
        F.array(_object(_id("table", "target_table"), "table", c("target_table"), F.lit("output"))),
        F.transform(physical, lambda x: _object(_id("physical_column", x["scope"], x["column"]), "physical_column", F.concat_ws(".", x["scope"], x["column"]), field_role(x["column"]))),
        F.transform("p_conditions", condition),
        # A section for each scope that does something, in the order of the scopes.
        F.transform("p_doing", lambda s: _object(_id("section", s["scope_id"]), "section", s["scope_id"], s["operations"])),
        F.transform("warnings", lambda w: _object(_id("diagnostic", w["type"], w["scope_id"]), "diagnostic", w["type"], w["scope_id"])),
    )
    return F.array_distinct(every)


def _doing() -> Column:
    return F.filter("scopes", lambda s: (s["scope_id"] == "ROOT") | (F.size(F.array_except(profile.operations(s), F.array(F.lit("pass_through"), F.lit("rename")))) > 0))


def _link(a: Column, b: Column, kind: str) -> Column:
    return F.struct(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("kind"))


def _link_items() -> Column:
    named = F.col("p_named")
    node = lambda n: F.when(F.array_contains(named, n), _id("scope", n)).otherwise(_id("table", n))
    rule = lambda x, i: _id("rule", x["scope_id"], i.cast("string"))
    items = F.col("p_conditions")
    fed = F.filter("graph_edges", lambda e: e["from_node"].isNotNull() & e["to_node"].isNotNull())
    every = F.concat(
        F.transform(fed, lambda e: _link(node(e["from_node"]), node(e["to_node"]), "feeds")),
        F.transform("p_root", lambda c: _link(F.lit("scope:ROOT"), _id("column", c["name"]), "produces")),
        F.transform("p_sources", lambda x: _link(_id("column", x["name"]), _id("table", x["table"]), "derived_from")),
        F.transform("p_sources", lambda x: _link(_id("column", x["name"]), _id("physical_column", x["table"], x["column"]), "derived_from_column")),
        F.flatten(F.transform(items, lambda x, i: F.transform(x["physical"], lambda r: _link(rule(x, i), _id("physical_column", r["scope"], r["column"]), "uses_field")))),
        F.transform(items, lambda x, i: _link(rule(x, i), _id("scope", x["scope_id"]), "implemented_by")),
        F.transform("p_doing", lambda s: _link(_id("section", s["scope_id"]), _id("scope", s["scope_id"]), "references")),
        F.transform(F.transform(items, lambda x, i: F.struct(x["scope_id"].alias("s"), rule(x, i).alias("r"))), lambda x: _link(_id("section", x["s"]), x["r"], "references")),
        F.transform(F.filter("warnings", lambda w: F.array_contains(named, w["scope_id"])), lambda w: _link(_id("diagnostic", w["type"], w["scope_id"]), _id("scope", w["scope_id"]), "affects")),
    )
    return F.array_distinct(every)


def objects(a: DataFrame) -> DataFrame:
    """stmt, object_id, kind, name, detail: scopes, result columns, tables, physical columns,
    conditions, sections and diagnostics."""
    return _parts(a).select("stmt", F.explode(_object_items()).alias("o")).select("stmt", "o.*")


def links(a: DataFrame) -> DataFrame:
    """stmt, from_id, to_id, kind: feeds, produces, derived_from, derived_from_column, uses_field,
    implemented_by, references, affects."""
    return _parts(a).select("stmt", F.explode(_link_items()).alias("l")).select("stmt", "l.*")


def link_counts(a: DataFrame) -> DataFrame:
    return links(a).groupBy("kind").agg(F.count("*").alias("n_links"), F.count_distinct("stmt").alias("n_statements"))


def dangling_scopes(a: DataFrame) -> DataFrame:
    """Scopes other than ROOT that feed nothing, such as those of EXISTS and IN."""
    used = F.array_distinct(F.flatten(F.transform("scopes", lambda s: s["depends_on"])))
    inner = F.array_distinct(F.flatten(F.transform("scopes", lambda s: s["inner_scopes"])))
    s = a.where("status = 'ok'").select(*_KEY, F.explode(F.filter("scopes", lambda s: (s["scope_id"] != "ROOT") & ~F.array_contains(used, s["scope_id"]))).alias("s"), inner.alias("inner"))
    return s.select(*_KEY, F.col("s.scope_id").alias("scope_id"), F.array_contains("inner", F.col("s.scope_id")).alias("is_subquery_of"))


def task_risk(a: DataFrame) -> DataFrame:
    """RED if any result column is incomplete, YELLOW if there are warnings, else GREEN."""
    incomplete = F.size(F.filter("lineage", lambda l: ~l["complete"]))
    return a.where("status = 'ok'").select(*_KEY, F.size("lineage").alias("n_columns"), incomplete.alias("n_incomplete"), F.size("warnings").alias("n_warnings"), F.when(incomplete > 0, "RED").when(F.size("warnings") > 0, "YELLOW").otherwise("GREEN").alias("risk"))


def findings(a: DataFrame) -> DataFrame:
    """One row per failed check of a statement and its objects and links: stmt, code, subject."""
    ok = once_per_row(once_per_row(_parts(a), "objects", _object_items()), "links", _link_items())
    ok = once_per_row(ok, "ids", F.transform("objects", lambda o: o["object_id"]))
    ids, named = F.col("ids"), F.col("p_named")
    root = F.transform("p_root", lambda c: F.concat_ws("|", c["name"], c["merge_branch"]))
    fed = F.transform("scopes", lambda s: F.array_except(s["direct_tables"], s["tables"]))
    ends = lambda x: x["from_id"].rlike("^(table|scope):") & x["to_id"].rlike("^scope:")
    used = F.array_distinct(F.flatten(F.transform("scopes", lambda s: s["depends_on"])))
    first = lambda xs: F.transform(xs, lambda l: l["from_id"])
    last = lambda xs: F.transform(xs, lambda l: l["to_id"])
    kind = lambda k: F.filter("links", lambda l: l["kind"] == k)
    checks = {
        "duplicate_scope_id": F.filter(F.array_distinct(named), lambda n: F.size(F.filter(named, lambda m: m == n)) > 1),
        "missing_root": F.when(~F.array_contains(named, "ROOT"), F.array(F.lit("ROOT"))),
        "branch_without_scope": F.array_except(F.flatten(F.transform("scopes", lambda s: s["branches"])), named),
        "edge_from_nowhere": F.array_except(F.transform("graph_edges", lambda e: e["from_node"]), F.col("graph_nodes")),
        "edge_to_nowhere": F.array_except(F.transform("graph_edges", lambda e: e["to_node"]), F.col("graph_nodes")),
        "column_without_name": F.transform(F.filter("scopes", lambda s: F.exists(s["columns"], lambda c: F.coalesce(c["name"], F.lit("")) == "")), lambda s: s["scope_id"]),
        "join_without_right": F.transform(F.filter("scopes", lambda s: F.exists(s["joins"], lambda j: j["right_scope"].isNull())), lambda s: s["scope_id"]),
        "unknown_transform": F.array_distinct(F.filter(F.flatten(F.transform("scopes", lambda s: F.transform(s["columns"], lambda c: c["transform"]))), lambda t: ~F.coalesce(t.isin(*lineage.walk.ORDER), F.lit(False)))),
        "lineage_without_column": F.array_except(F.transform("lineage", lambda l: l["name"]), F.transform("p_root", lambda c: F.coalesce(c["name"], F.lit("")))),
        "output_column_count_mismatch": F.when(F.size(F.array_distinct(F.transform("lineage", lambda l: l["name"]))) != F.size(F.filter("objects", lambda o: o["kind"] == "column")), F.array(F.lit("ROOT"))),
        "duplicate_output_column_assignment": F.filter(F.array_distinct(root), lambda n: F.size(F.filter(root, lambda m: m == n)) > 1),
        "scope_object_count_mismatch": F.when(F.size(F.array_distinct(named)) != F.size(F.filter("objects", lambda o: o["kind"] == "scope")), F.array(F.lit("scopes"))),
        "invalid_link": F.transform(F.filter("links", lambda l: l["from_id"].isNull() | l["to_id"].isNull()), lambda l: l["kind"]),
        "link_source_missing": F.array_except(first(F.col("links")), ids),
        "link_target_missing": F.array_except(last(F.col("links")), ids),
        "invalid_feeds_link": F.transform(F.filter(kind("feeds"), lambda l: ~F.coalesce(ends(l), F.lit(False))), lambda l: F.concat_ws(" -> ", l["from_id"], l["to_id"])),
        "rule_scope_missing": F.array_except(last(kind("implemented_by")), ids),
        "rule_field_missing": F.array_except(last(kind("uses_field")), ids),
        "rule_condition_missing": F.transform(F.filter("p_conditions", lambda x: F.coalesce(x["expression"], F.lit("")) == ""), lambda x: x["scope_id"]),
        "section_reference_missing": F.array_except(last(kind("references")), ids),
        "column_table_link_missing": F.array_except(F.transform("p_sources", lambda x: _id("column", x["name"])), first(kind("derived_from"))),
        "column_source_link_missing": F.array_except(F.transform("p_sources", lambda x: _id("physical_column", x["table"], x["column"])), last(kind("derived_from_column"))),
        "trace_incomplete_reason_missing": F.transform(F.filter("lineage", lambda l: ~l["complete"] & (F.size(l["reasons"]) == 0)), lambda l: l["name"]),
        "direct_table_not_physical_source": F.flatten(fed),
        "scope_table_metadata_missing": F.array_except(F.array_distinct(F.flatten(F.transform("scopes", lambda s: s["tables"]))), F.concat("source_tables", F.array(F.coalesce("target_table", F.lit(""))))),
        "dangling_lineage_scope": F.filter(F.array_except(named, F.concat(used, F.array(F.lit("ROOT")))), lambda n: ~F.array_contains(F.flatten(F.transform("scopes", lambda s: s["inner_scopes"])), n)),
        "target_table_missing": F.when(F.coalesce("target_table", F.lit("")) == "", F.array(F.lit("target_table"))),
    }
    none = F.array().cast("array<string>")
    every = [F.transform(F.coalesce(F.array_compact(subjects), none), lambda x, code=code: F.struct(F.lit(code).alias("code"), x.alias("subject"))) for code, subjects in checks.items()]
    return ok.select("stmt", F.explode(F.concat(*every)).alias("f")).select("stmt", "f.*")


def flat_lineage(a: DataFrame) -> DataFrame:
    """Source column to target column, one row each, without scopes in between."""
    e = lineage.end_to_end(a).where("source_table is not null")
    return e.select(*_KEY, "target_table", F.col("name").alias("target_column"), "source_table", "source_column", "transform")


def document_findings(profiles: DataFrame, documents: DataFrame) -> DataFrame:
    """Checks of written descriptions, documents(stmt, text), against their profiles: the five section headings, the
    target and its columns named, and incompleteness told: stmt, code."""
    p = profiles.select("stmt", "profile").join(documents.select("stmt", F.col("text").alias("doc")), "stmt")
    names = F.from_json(F.get_json_object("profile", "$.end_to_end_lineage[*].column"), "array<string>")
    warned = F.get_json_object("profile", "$.warning_count").cast("int") > 0
    doc = F.lower(F.coalesce("doc", F.lit("")))
    checks = [F.when(~F.coalesce(F.col("doc").rlike(rf"(?m)^#+\s*L{i}\b"), F.lit(False)), F.lit(f"missing_heading_L{i}")) for i in range(1, 6)]
    checks += [
        F.when(~F.contains(doc, F.lower(F.get_json_object("profile", "$.target_table"))), F.lit("target_not_named")),
        F.when(F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: ~F.contains(doc, F.lower(n))), F.lit("column_not_named")),
        F.when(F.contains(doc, F.lit("primary key")), F.lit("grain_called_primary_key")),
        F.when(warned & ~doc.rlike("incomplete|warning|schema"), F.lit("warnings_not_told")),
    ]
    return p.select("stmt", F.explode(F.array_compact(F.array(*checks))).alias("code"))
