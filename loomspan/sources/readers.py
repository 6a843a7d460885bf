"""Sources: SQL files, task JSON, column and table metadata in their several shapes, stored artifacts.

Files are read by Spark; metadata whose shape is not fixed is normalised per file in a narrow stage.
What cannot be read keeps its row with a status, so one bad file never ends a run.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import jsontext
from loomspan.functions.names import table_name

TASKS = "task_name string, sql string, path string, status string, error string"
CATALOG = "table_key string, ordinal int, name string, type string, comment string"
TABLES = "table_key string, table_name_cn string, table_desc string, table_label_layer string"

# The names under which metadata files give each field, in order of preference.
_TABLE = ("table_name", "table", "tablename")
_NAME = ("column_name", "column", "name")
_TYPE = ("type", "data_type", "column_type")
_COMMENT = ("comment", "column_comment")
_CN = ("table_name_cn", "name_cn", "table_comment", "cn_name", "comment")
_DESC = ("table_desc", "description", "desc", "comment")
_LAYER = ("table_label_layer", "layer", "data_layer", "label_layer")


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))


def _stem(path: str = "path"):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def sql_files(spark: SparkSession, path: str) -> DataFrame:
    """*.sql under a folder, or one file: a task per file, named by its stem."""
    f = _files(spark, path, ".sql")
    blank = F.trim(F.regexp_replace("text", "^\ufeff", "")) == ""
    return f.select(_stem().alias("task_name"), F.regexp_replace("text", "^\ufeff", "").alias("sql"), "path", F.when(blank, "empty").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("error"))


def task_bodies(bodies: DataFrame, body: str = "body", path: str = "path") -> DataFrame:
    """Tasks from raw JSON texts; status is ok, empty (no sql text) or error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, at in zip(pdf["body"], pdf["path"], strict=True):
                ok, d = jsontext.parse(text.lstrip("\ufeff") if text else text)
                if not ok or not isinstance(d, dict):
                    rows.append((None, None, at, "error", "not a JSON object"))
                elif d.get("sql") is None or not jsontext.as_text(d["sql"]).strip():
                    rows.append((jsontext.as_text(d.get("task_name")) or None, "", at, "empty", None))
                else:
                    rows.append((jsontext.as_text(d.get("task_name")) or None, jsontext.as_text(d["sql"]), at, "ok", None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TASKS.split(", ")])

    return bodies.select(F.col(body).alias("body"), F.col(path).alias("path")).mapInPandas(run, TASKS)


def task_directory(spark: SparkSession, path: str) -> DataFrame:
    """*.json under a folder; a task without name is named by its file."""
    t = task_bodies(_files(spark, path, ".json"), "text", "path")
    return t.withColumn("task_name", F.coalesce("task_name", _stem()))


def corpus_status(tasks: DataFrame) -> DataFrame:
    """Tasks by status, and the share of the ok among those that are not empty."""
    c = tasks.agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error"), F.count_if(F.col("status") == "empty").alias("n_empty"))
    return c.withColumn("success_rate", F.round(F.col("n_ok") / F.nullif(F.col("n_ok") + F.col("n_error"), F.lit(0)), 6))


# -- metadata -----------------------------------------------------------------------------------------


def _pick(row: dict, names: Iterable[str]) -> str | None:
    low = {str(k).strip().lower(): v for k, v in row.items()}
    for n in names:
        v = low.get(n)
        if v is not None and jsontext.as_text(v).strip():
            return jsontext.as_text(v).strip()
    return None


def column_entries(value, table: str | None = None) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(table, column, type, comment) of any of the accepted JSON shapes."""
    if isinstance(value, list):
        for x in value:
            if isinstance(x, dict):
                t = table or _pick(x, _TABLE)
                if isinstance(x.get("columns"), list) and t:
                    yield from column_entries(x["columns"], t)
                elif t and (name := _pick(x, _NAME)):
                    yield t, name, _pick(x, _TYPE), _pick(x, _COMMENT)
            elif x is not None and table:
                yield table, jsontext.as_text(x), None, None
    elif isinstance(value, dict):
        if table is not None:
            for member in ("column_details", "columns", "fields"):
                if member in value:
                    yield from column_entries(value[member], table)
                    return
        elif isinstance(value.get("tables"), list):
            yield from column_entries(value["tables"])
        else:
            for t, own in value.items():
                yield from column_entries(own, t)


def _csv_rows(text: str) -> list[dict]:
    return list(csv.DictReader(io.StringIO(text.lstrip("\ufeff"))))


def _metadata(files: DataFrame, entries: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for text in pdf["text"] for r in entries(text)], columns=names)

    return files.select("text").mapInPandas(run, schema)


def _columns_of(suffix: str) -> Callable[[str], Iterable[tuple]]:
    def entries(text: str) -> Iterator[tuple]:
        found = (column_entries(_csv_rows(text)) if suffix == ".csv" else column_entries(jsontext.parse(text.lstrip("\ufeff"))[1]))
        seen: dict[str, dict[str, list]] = {}
        for t, name, kind, comment in found:
            own = seen.setdefault(t, {}).setdefault(name, [None, None])
            # The first place of a name holds, the last type and comment do.
            own[0], own[1] = kind or own[0], comment or own[1]
        for t, columns in seen.items():
            for i, (name, (kind, comment)) in enumerate(columns.items()):
                yield t, i, name, kind, comment

    return entries


def column_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Column metadata by suffix, .csv or .json; table_key as written."""
    suffix = path[path.rfind(".") :].lower()
    if suffix not in (".csv", ".json"):
        raise ValueError(f"column metadata must be .csv or .json, not {path}")
    return _metadata(_files(spark, path, suffix), _columns_of(suffix), CATALOG)


def table_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Names, descriptions and layers of tables, from .csv or .json rows or a map by table."""
    suffix = path[path.rfind(".") :].lower()
    if suffix not in (".csv", ".json"):
        raise ValueError(f"table metadata must be .csv or .json, not {path}")

    def entries(text: str) -> Iterator[tuple]:
        value = _csv_rows(text) if suffix == ".csv" else jsontext.parse(text.lstrip("\ufeff"))[1]
        if isinstance(value, dict):
            value = value.get("tables") if isinstance(value.get("tables"), list) else [{"table_name": t, **x} for t, x in value.items() if isinstance(x, dict)]
        for x in value or []:
            if isinstance(x, dict) and (t := _pick(x, _TABLE)):
                yield t, _pick(x, _CN), _pick(x, _DESC), _pick(x, _LAYER)

    return _metadata(_files(spark, path, suffix), entries, TABLES)


def normalized_catalog(catalog: DataFrame) -> DataFrame:
    """One row per table and column in compared form: first place, last type and comment given."""
    c = catalog.select(table_name("table_key").alias("table_key"), F.lower(F.trim("name")).alias("name"), "ordinal", "type", "comment").where("table_key is not null and name is not null")
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col("ordinal")))
    return c.groupBy("table_key", "name").agg(F.min("ordinal").alias("ordinal"), last("type").alias("type"), last("comment").alias("comment"))


def attach_tables(catalog: DataFrame, tables: DataFrame) -> DataFrame:
    """Catalogue rows with their table's names; a table's last entry holds."""
    t = tables.select(table_name("table_key").alias("k"), "table_name_cn", "table_desc", "table_label_layer").groupBy("k").agg(*(F.last(c, True).alias(c) for c in ("table_name_cn", "table_desc", "table_label_layer")))
    return catalog.join(t, table_name("table_key") == F.col("k"), "left").drop("k")


def spark_catalog(spark: SparkSession, tables: Iterable[str]) -> DataFrame:
    """Column metadata of tables and views the session knows; unknown ones are skipped."""
    rows = []
    for t in tables:
        if spark.catalog.tableExists(t):
            rows += [(t, i, c.name, c.dataType, c.description) for i, c in enumerate(spark.catalog.listColumns(t))]
    return spark.createDataFrame(rows, CATALOG)


def parquet_schemas(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> DataFrame:
    """Column metadata read from Parquet footers."""
    rows = [(n, i, c, kind, None) for n in names for i, (c, kind) in enumerate(spark.read.parquet(f"{sf_dir}/{n}.parquet").dtypes)]
    return spark.createDataFrame(rows, CATALOG)


def lineage_files(spark: SparkSession, path: str) -> DataFrame:
    """lineage.json artifacts as deliveries: stmt_id is a hash of the folder."""
    f = _files(spark, path, "lineage.json")
    return f.select(F.xxhash64(F.regexp_replace("path", "/[^/]*$", "")).alias("stmt_id"), _stem("path").alias("task_id"), F.current_timestamp().alias("received_at"), F.col("text").alias("payload"))
