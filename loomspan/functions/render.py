"""Statements as Mermaid graphs, Markdown and a self-contained page."""

from __future__ import annotations

import hashlib
import html as escape
import json
import re

from loomspan.plans import trace as walk


def safe_id(text: str) -> str:
    """An identifier for a graph node; one made of nothing but underscores gets a hash."""
    out = re.sub(r"\W", "_", text, flags=re.ASCII)
    return out if out.strip("_") else f"{out}_{hashlib.md5(text.encode()).hexdigest()[:8]}"


def label(text: str) -> str:
    return text.replace('"', "#quot;").replace("\n", " ")


def _columns(d: dict) -> list[tuple]:
    return [(s["scope_id"], c["name"], c["transform"], c["merge_branch"], [(r["scope"], r["column"]) for r in c["sources"]]) for s in d["scopes"] for c in s["columns"]]


def scope_overview(d: dict) -> str:
    """Scopes and tables and what feeds what."""
    ids = {s["scope_id"] for s in d["scopes"]}
    lines = ["flowchart LR"]
    for node in sorted({*d["graph_nodes"], *ids}):
        box = ('["', '"]') if node in ids else ('[("', '")]')
        lines.append(f"  {safe_id(node)}{box[0]}{label(node)}{box[1]}")
    lines += [f"  {safe_id(e['from_node'])} --> {safe_id(e['to_node'])}" for e in d["graph_edges"]]
    return "\n".join(lines) + "\n"


def physical_lineage(d: dict) -> str:
    """Physical columns to result columns, each link with its own transform."""
    lines, seen = ["flowchart LR"], set()
    for l in d["lineage"]:
        for s in l["sources"]:
            a, b = f"{s['scope']}.{s['column']}", f"{d['target_table']}.{l['name']}"
            if (a, b, s["transform"]) not in seen:
                seen.add((a, b, s["transform"]))
                lines.append(f'  {safe_id(a)}["{label(a)}"] -->|{s["transform"]}| {safe_id(b)}["{label(b)}"]')
    return "\n".join(lines) + "\n"


def field_lineage(d: dict) -> str:
    """Every column of every scope with its immediate sources."""
    lines, seen = ["flowchart LR"], set()
    for scope, name, transform, _, sources in _columns(d):
        for s, c in sources:
            a, b = f"{s}.{c}", f"{scope}.{name}"
            if (a, b) not in seen:
                seen.add((a, b))
                lines.append(f'  {safe_id(a)}["{label(a)}"] -->|{transform}| {safe_id(b)}["{label(b)}"]')
    return "\n".join(lines) + "\n"


def field_trace(d: dict, name: str) -> str:
    """The way up of one result column."""
    found = walk.upstream(_columns(d), {s["scope_id"] for s in d["scopes"]}, "ROOT", name)
    lines = ["flowchart LR", f'  {safe_id("ROOT." + name)}["{label("ROOT." + name)}"]']
    lines += [f'  {safe_id(".".join(a))}["{label(".".join(a))}"] --> {safe_id(".".join(b))}["{label(".".join(b))}"]' for a, b in dict.fromkeys(found["links"])]
    return "\n".join(lines) + "\n"


def markdown(d: dict) -> str:
    """A statement in eight sections."""
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    table = lambda head, rows: ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""] if rows else ["None.", ""]
    refs = lambda rs: ", ".join(f"{r['scope']}.{r['column']}" for r in rs)
    out = [f"# {d['stmt']}", "", f"Target: {d['target_table']} ({d['stmt_kind']})", ""]
    out += ["## Source tables", "", *table(["table"], [(t,) for t in d["source_tables"]])]
    out += ["## Scopes", "", *table(["scope", "kind", "depends on"], [(s["scope_id"], s["kind"], ", ".join(s["depends_on"])) for s in d["scopes"]])]
    out += ["## Columns", "", *table(["scope", "column", "transform", "sources"], [(s["scope_id"], c["name"], c["transform"], refs(c["sources"])) for s in d["scopes"] for c in s["columns"]])]
    out += ["## End to end", "", *table(["column", "sources", "complete"], [(l["name"], ", ".join(f"{x['scope']}.{x['column']} ({x['transform']})" for x in l["sources"]), l["complete"]) for l in d["lineage"]])]
    out += ["## Joins", "", *table(["scope", "type", "right", "condition"], [(s["scope_id"], j["join_type"], j["right_scope"], j["condition_expression"]) for s in d["scopes"] for j in s["joins"]])]
    out += ["## Filters", "", *table(["scope", "clause", "condition"], [(s["scope_id"], f["clause"], f["expression"]) for s in d["scopes"] for f in s["filters"]])]
    out += ["## Groups and order", "", *table(["scope", "group by", "order by"], [(s["scope_id"], refs(s["group_by"]), refs(s["order_by"])) for s in d["scopes"] if s["group_by"] or s["order_by"]])]
    out += ["## Warnings", "", *table(["type", "scope", "message"], [(w["type"], w["scope_id"], w["msg"]) for w in d["warnings"]])]
    return "\n".join(out)


def views(d: dict) -> dict[str, str]:
    out = {"scope_overview.mmd": scope_overview(d), "physical_lineage.mmd": physical_lineage(d), "field_lineage.mmd": field_lineage(d), "lineage.md": markdown(d)}
    for l in d["lineage"]:
        key = safe_id(l["name"] + (f"_{l['merge_branch']}" if l["merge_branch"] else ""))
        out.setdefault(f"per_column/{key}.mmd", field_trace(d, l["name"]))
    return out


def risk(d: dict, l: dict) -> str:
    """RED if a column reaches the unknown, YELLOW for stars and doubtful names, else GREEN."""
    if "unknown_source" in l["reasons"] or "missing_scope_column" in l["reasons"]:
        return "RED"
    doubtful = {"ambiguous_unqualified", "unresolved_unqualified_no_schema", "star_not_expanded"}
    return "YELLOW" if "star_not_expanded" in l["reasons"] or any(w["type"] in doubtful for w in d["warnings"]) else "GREEN"


_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title><style>
body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:4px 8px;text-align:left}}
.RED{{color:#b00}}.YELLOW{{color:#a60}}.GREEN{{color:#070}}input{{margin:1em 0;padding:4px;width:30em}}</style></head><body>
<h1>{title}</h1><p>{about}</p><input id="q" placeholder="column or table"><table id="t"><thead><tr><th>column</th><th>risk</th><th>sources</th></tr></thead><tbody></tbody></table>
<script type="application/json" id="data">{data}</script><script>
const rows=JSON.parse(document.getElementById('data').textContent),body=document.querySelector('#t tbody'),q=document.getElementById('q');
function show(){{body.textContent='';for(const r of rows){{const text=r.name+' '+r.sources.join(' ');if(!text.includes(q.value.toLowerCase()))continue;
const tr=body.insertRow();tr.insertCell().textContent=r.name;const c=tr.insertCell();c.textContent=r.risk;c.className=r.risk;tr.insertCell().textContent=r.sources.join(', ');}}}}
q.addEventListener('input',show);show();</script></body></html>"""


def html(d: dict) -> str:
    """A page with a searchable table of result columns; it loads nothing from elsewhere."""
    rows = [{"name": l["name"], "risk": risk(d, l), "sources": [f"{s['scope']}.{s['column']} ({s['transform']})" for s in l["sources"]]} for l in d["lineage"]]
    data = json.dumps(rows, ensure_ascii=False).replace("<", "\\u003c").replace("://", ":\\/\\/")
    return _PAGE.format(title=escape.escape(d["stmt"]), about=escape.escape(f"{d['stmt_kind']} into {d['target_table']} from {', '.join(d['source_tables'])}"), data=data)


def audit_markdown(title: str, severities: dict[str, int], issues: list[tuple], reds: list[tuple], risky: list[tuple]) -> str:
    """An audit's report: statements by severity, issues with their counts, the red statements with the class
    of their fault, and the yellow ones whose warnings put most in doubt."""
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    table = lambda head, rows: ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""] if rows else ["None.", ""]
    total = sum(severities.values())
    share = f"{severities.get('RED', 0) / total:.1%} of {total} statements are red." if total else "No statements."
    out = [f"# {title}", "", share, "", "## Severity", "", *table(["severity", "statements"], [(k, severities.get(k, 0)) for k in ("RED", "YELLOW", "GREEN")])]
    out += ["## Issues", "", *table(["issue", "statements", "times"], issues), "## Red", "", *table(["statement", "target", "class", "issues"], reds)]
    out += ["## Risky", "", *table(["statement", "weight", "kinds of warnings"], risky)]
    return "\n".join(out)
