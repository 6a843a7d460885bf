"""Problem 1: deeply nested lineage documents into related flat tables.

One depth-first visitor walks each delivered document once and emits tagged rows: the table's tag, the
row's own key, its parent's key, its place among its siblings, and its scalar members as payload.  The
tagged rows are one narrow stage, written partitioned by tag under the shared folder; `typed` reads a
tag's folder and applies its schema.  No payload is ever shuffled: which delivery of a statement counts
is settled on the small table of documents, and the other tables keep the rows of those deliveries.

Keys are paths: a scope is ``<scope name>``, its column 3 is ``<scope name>/3``, that column's second
source ``<scope name>/3/source/1``; together with stmt_id they are unique, so each row's parent_key
joins to exactly one row of its parent's table.

Defined results: null, empty, broken or incomplete payloads give no rows.  An object in place of a
list is a list of one.  Null entries, and entries that are not objects, keep their position and give
no row.  Absent and null members are null in the payload, and so is what does not fit the member's
type.  Extra columns of the input are ignored.
Of several deliveries of a statement the readable one received last counts (then the greatest text);
of equal ones any, for they give the same rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomspan.functions import jsontext
from loomspan.runtime import broadcast_if_small, cut, ensure_checkpoint_dir, spread

#: tag -> scalar members kept in the payload, in order, with their types.
SCHEMAS = {
    "document": "hash string",
    "scope": "kind string, role string, alias_in_parent string, writes_to string, set_op string, distinct boolean",
    "column": "name string, transform string, expression string, agg_function string, merge_branch string",
    "source": "scope string, column string, resolved_by string",
    "case_branch": "when_expr string, then_value string",
    "branch": "branch string, from_column string",
    "partition_by": "scope string, column string, resolved_by string",
    "order_by": "scope string, column string, direction string, resolved_by string",
}
TABLES = {tag: tuple(m.split()[0] for m in members.split(", ")) for tag, members in SCHEMAS.items() if tag != "document"}
#: tag -> tag of the parent.
PARENTS = {"column": "scope", **dict.fromkeys(("source", "case_branch", "branch", "partition_by", "order_by"), "column")}
_CHILDREN = (("source", "sources"), ("case_branch", "case_branches"), ("branch", "branches"))
_WINDOW = ("partition_by", "order_by")
TAGGED = "tag string, delivery bigint, received bigint, stmt_id bigint, row_key string, parent_key string, scope_id string, column_no int, position int, payload array<string>"


def _entries(value) -> Iterator[tuple[int, dict]]:
    if isinstance(value, dict):
        value = [value]
    if isinstance(value, list):
        for i, x in enumerate(value):
            if isinstance(x, dict):
                yield i, x


def visit(document) -> Iterator[tuple]:
    """Depth first: (tag, row key, parent key, scope, column number, position, members)."""

    def row(tag, key, parent, scope, column, place, node):
        return tag, key, parent, scope, column, place, [None if node.get(m) is None else jsontext.as_text(node[m]) for m in TABLES[tag]]

    scopes = document.get("scopes") if isinstance(document, dict) else None
    for place, (name, scope) in enumerate(scopes.items() if isinstance(scopes, dict) else ()):
        if not isinstance(scope, dict):
            continue
        name = jsontext.clean(name)
        yield row("scope", name, None, name, None, place, scope)
        for c, column in _entries(scope.get("columns")):
            at = f"{name}/{c}"
            yield row("column", at, name, name, c, c, column)
            for tag, member in _CHILDREN:
                for i, x in _entries(column.get(member)):
                    yield row(tag, f"{at}/{tag}/{i}", at, name, c, i, x)
            window = column.get("window")
            if isinstance(window, dict):
                for tag in _WINDOW:
                    for i, x in _entries(window.get(tag)):
                        yield row(tag, f"{at}/{tag}/{i}", at, name, c, i, x)


def _readable(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([jsontext.parse(x)[0] for x in s], dtype=bool)


def latest_readable(deliveries: DataFrame) -> DataFrame:
    """One payload per stmt_id; rows whose stmt_id is null or that cannot be read are left out."""
    readable = F.pandas_udf(_readable, "boolean")
    return (
        spread(deliveries.select("stmt_id", "received_at", "payload"))
        .where("stmt_id is not null and payload is not null")
        .where(readable("payload"))
        .groupBy("stmt_id")
        .agg(F.max_by("payload", F.struct("received_at", "payload")).alias("payload"))
    )


def tagged_rows(deliveries: DataFrame) -> DataFrame:
    """Tagged rows of every readable delivery; those of a delivery share its number."""
    schema = to_arrow_schema(T.StructType.fromDDL(TAGGED))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for stmt, number, at, payload in zip(*(batch[c].to_pylist() for c in ("stmt_id", "delivery", "received", "payload")), strict=True):
                ok, document = jsontext.parse(payload)
                if ok:
                    rows.append(("document", number, at, stmt, "", None, None, None, None, [hashlib.blake2b(payload.encode(), digest_size=16).hexdigest()]))
                    rows += [(r[0], number, None, stmt, *r[1:]) for r in visit(document)]
                if len(rows) > 20_000:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    numbered = spread(deliveries.select("stmt_id", _micros().alias("received"), "payload")).where("stmt_id is not null and payload is not null").withColumn("delivery", F.monotonically_increasing_id())
    return numbered.mapInArrow(emit, TAGGED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def write_tables(tagged: DataFrame, path: str) -> None:
    """All tables in one write, one folder per tag."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def typed(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """A written table with its tag's schema; only that folder is read."""
    members = [F.expr(f"try_cast(payload[{i}] AS {m.split()[1]})").alias(m.split()[0]) for i, m in enumerate(SCHEMAS[tag].split(", "))]
    own = spark.read.schema(T.StructType.fromDDL(TAGGED)).parquet(path).where(F.col("tag") == tag)
    return own.select("delivery", "received", "stmt_id", "row_key", "parent_key", "scope_id", "column_no", "position", *members)


def counting(documents: DataFrame, deliveries: DataFrame) -> DataFrame:
    """stmt_id, delivery: the delivery of each statement that counts."""
    times = documents.groupBy("stmt_id", "received").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.max("delivery").alias("delivery"))
    best = cut(times.groupBy("stmt_id").agg(F.max(F.struct("received", "lo", "hi", "delivery")).alias("b")).select("stmt_id", "b.*"))
    tied = best.where("lo <> hi").select(F.col("stmt_id").alias("t_stmt"), F.col("received").alias("t_at"))
    if tied.isEmpty():
        return best.select("stmt_id", "delivery")
    # Different texts at the same time: only here are texts compared.
    tied = broadcast_if_small(tied)
    own = deliveries.select("stmt_id", "received_at", "payload", _micros().alias("received"))
    same = (F.col("stmt_id") == F.col("t_stmt")) & F.col("received").eqNullSafe(F.col("t_at"))
    texts = latest_readable(own.join(tied, same, "left_semi")).select("stmt_id", _hash("payload").alias("hash"))
    won = documents.join(tied, same, "left_semi").join(texts, ["stmt_id", "hash"], "left_semi").groupBy("stmt_id").agg(F.max("delivery").alias("delivery"))
    return best.where("lo = hi").select("stmt_id", "delivery").unionByName(won)


def _micros() -> Column:
    return F.unix_micros(F.col("received_at").cast("timestamp"))


def _hash(text: str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: hashlib.blake2b(x.encode(), digest_size=16).hexdigest()), "string")(text)


def tables(deliveries: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """The flat tables, written partitioned by tag to `path` (else to the shared checkpoint folder) and
    read back: tag -> table of the deliveries that count."""
    spark = deliveries.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/nested-{uuid.uuid4().hex}"
    write_tables(tagged_rows(deliveries), path)
    own = broadcast_if_small(cut(counting(typed(spark, path, "document"), deliveries).select("delivery")))
    return {tag: typed(spark, path, tag).join(own, "delivery", "left_semi").drop("delivery", "received") for tag in TABLES}


def child_objects(deliveries: DataFrame) -> DataFrame:
    """p1_found: every object in the lists of a column, with its two leading values ('' if absent)."""
    value = lambda tag, i: F.coalesce(F.col(TABLES[tag][i]), F.lit("")).alias(("first_value", "second_value")[i])
    t = tables(deliveries)
    kinds = [t[tag].select("stmt_id", "scope_id", "column_no", F.lit(tag).alias("child_kind"), F.col("position").alias("child_no"), value(tag, 0), value(tag, 1)) for tag in ("source", "case_branch", "branch", "partition_by", "order_by")]
    return reduce(DataFrame.unionByName, kinds)


def columns(deliveries: DataFrame) -> DataFrame:
    """The flat table of columns, each with its own key and its scope's."""
    return tables(deliveries)["column"].select("stmt_id", "parent_key", "row_key", "position", "name", "transform", "agg_function", "merge_branch")


def scopes(deliveries: DataFrame) -> DataFrame:
    """The flat table of scopes."""
    return tables(deliveries)["scope"].select("stmt_id", "row_key", "kind", "role", "set_op", "distinct")


def links(deliveries: DataFrame) -> DataFrame:
    """Per child table: rows, rows whose parent_key meets exactly one row of the parent table, and parents
    that have children there."""
    t = tables(deliveries)
    out = []
    for tag, parent in PARENTS.items():
        up = t[parent].groupBy("stmt_id", F.col("row_key").alias("parent_key")).agg(F.count("*").alias("n"))
        met = t[tag].groupBy("stmt_id", "parent_key").agg(F.count("*").alias("rows")).join(up, ["stmt_id", "parent_key"], "left")
        out.append(met.agg(F.lit(tag).alias("tag"), F.lit(parent).alias("parent_tag"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("rows"))), F.lit(0)).alias("n_linked"), F.count("n").alias("n_parents")))
    return reduce(DataFrame.unionByName, out)


def table_sizes(deliveries: DataFrame) -> DataFrame:
    """Rows and statements per flat table that has rows."""
    t = tables(deliveries)
    return reduce(DataFrame.unionByName, [t[tag].groupBy(F.lit(tag).alias("tag")).agg(F.count("*").alias("n_rows"), F.count_distinct("stmt_id").alias("n_statements")) for tag in TABLES])
