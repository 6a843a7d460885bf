"""The contract of a stored lineage document: which members it must have and of which kind.

Each document is checked where it lies and gives one row per break of a rule, with the rule and the
place of the member; scope names and list positions are left out of the place, so breaks can be counted.

Defined results: a payload that is null or not one complete JSON text breaks the rule `json`; one that
is no object breaks `object`.  Every delivery is checked, repeated ones included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import jsontext
from loomspan.runtime import spread

# Members by place ([] an entry of a list, {} a member of a map), whether they must be
# there, their kind, and the values a text may have.
MEMBERS = """
task_id                        required  text
target_table                   required  text
stmt_kind                      required  text      INSERT_OVERWRITE INSERT CTAS MERGE UPDATE DELETE UNKNOWN
source_tables                  optional  list
source_tables[]                optional  string
partition_columns              optional  list
partition_columns[]            optional  string
scope_graph                    required  object
scope_graph.nodes              required  list
scope_graph.edges              required  list
scope_graph.edges[]            optional  object
scope_graph.edges[].from       required  string
scope_graph.edges[].to         required  string
scopes                         required  object
scopes{}                       optional  object
scopes{}.kind                  required  text      physical_table cte subquery union union_branch root
scopes{}.distinct              optional  boolean
scopes{}.lateral_views         optional  list
scopes{}.depends_on            required  list
scopes{}.depends_on[]          optional  string
scopes{}.columns               required  list
scopes{}.columns[]             optional  object
scopes{}.columns[].name        required  text
scopes{}.columns[].transform   required  text      DIRECT EXPRESSION AGGREGATE WINDOW CONDITIONAL CONSTANT UNION EXPAND_ALL
scopes{}.columns[].sources     required  list
scopes{}.columns[].sources[]   optional  object
scopes{}.columns[].sources[].scope   required  string
scopes{}.columns[].sources[].column  required  string
diagnostics                    optional  object
diagnostics.fallback_used      optional  boolean
diagnostics.warnings           optional  list
diagnostics.warnings[]         optional  object
diagnostics.warnings[].type    required  string
diagnostics.warnings[].scope   required  string
diagnostics.warnings[].msg     required  string
"""
_KINDS = {"object": dict, "list": list, "boolean": bool}
BREAKS = "stmt_id bigint, place string, rule string"


class Rule:
    """A member's rule and those of what it holds."""

    def __init__(self):
        self.required, self.kind, self.values = False, None, ()
        self.members: dict[str, Rule] = {}
        self.every: Rule | None = None


def rules(text: str = MEMBERS) -> Rule:
    top = Rule()
    top.kind = "object"
    for line in text.strip().splitlines():
        place, need, kind, *values = line.split()
        at = top
        for step in place.replace("[]", ".[]").replace("{}", ".{}").split("."):
            if step in ("[]", "{}"):
                at.every = at.every or Rule()
                at = at.every
            else:
                at = at.members.setdefault(step, Rule())
        at.required, at.kind, at.values = need == "required", kind, tuple(values)
    return top


def breaks(value, rule: Rule, place: str = "") -> Iterator[tuple[str, str]]:
    """(place, rule broken) of a value and all it holds."""
    if rule.kind in ("string", "text"):
        if not isinstance(value, str) or isinstance(value, jsontext.RawNumber):
            yield place, "string"
        elif rule.kind == "text" and not value:
            yield place, "empty"
        elif rule.values and value not in rule.values:
            yield place, "value"
        return
    if not isinstance(value, _KINDS[rule.kind]):
        yield place, rule.kind
        return
    for name, own in rule.members.items():
        at = f"{place}.{name}" if place else name
        if name in value:
            yield from breaks(value[name], own, at)
        elif own.required:
            yield at, "missing"
    if rule.every is not None:
        at, entries = (place + "{}", value.values()) if isinstance(value, dict) else (place + "[]", value)
        for x in entries:
            yield from breaks(x, rule.every, at)


def document_breaks(deliveries: DataFrame) -> DataFrame:
    """stmt_id, place, rule: one row for every break."""
    top = rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for stmt, payload in zip(batch["stmt_id"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                ok, document = jsontext.parse(payload)
                rows += [(stmt, *b) for b in breaks(document, top)] if ok else [(stmt, "", "json")]
            ids, places, broken = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.string()), pa.array(broken, pa.string())], names=["stmt_id", "place", "rule"])

    return spread(deliveries.select("stmt_id", "payload")).mapInArrow(run, BREAKS)


def break_counts(deliveries: DataFrame) -> DataFrame:
    """Per place and rule: breaks, and statements that have any."""
    return document_breaks(deliveries).groupBy("place", "rule").agg(F.count("*").alias("n_breaks"), F.count_distinct("stmt_id").alias("n_statements"))
