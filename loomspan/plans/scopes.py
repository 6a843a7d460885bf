"""Scopes and column lineage of one write statement.

A statement becomes a graph of named scopes - root, CTEs, subqueries, set operations and their
branches, generators - and every output column of a scope points at its immediate upstream columns
only.  Scopes are built bottom-up, so what a scope reads is complete before it is read; a column asked
of a scope with an unexpanded star is added to that scope there and then, down to the table.

Works without any schema.  With one (`lookup(table)` -> column names or None), stars expand and bare
names find their table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from loomspan.plans import conditions
from loomspan.plans.conditions import RUNTIME
from loomspan.plans.sqlparse import COMPARISONS, Node, SqlError, parse, split

# Aggregate functions by name.
AGGREGATES = frozenset(
    """count sum avg mean max min collect_set collect_list percentile percentile_approx approx_percentile histogram_numeric approx_count_distinct stddev stddev_pop
    stddev_samp std variance var_pop var_samp corr covar_pop covar_samp first last first_value last_value any_value count_if bool_and bool_or every some bit_and bit_or
    bit_xor skewness kurtosis max_by min_by array_agg median mode regr_count regr_slope regr_intercept regr_r2 regr_avgx regr_avgy grouping grouping_id listagg string_agg try_sum try_avg""".split()
)
GENERATORS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
SUMMARIES = frozenset("sum count max min avg".split())
PLAIN_NUMBERS = frozenset(("0", "1", "-1", "100"))
STRENGTH = {t: i for i, t in enumerate(("CONSTANT", "DIRECT", "EXPAND_ALL", "UNION", "EXPRESSION", "CONDITIONAL", "WINDOW", "AGGREGATE"))}

Ref = tuple[str, str]


class Column:
    def __init__(self, name: str, transform: str, expression: str | None, sources: list[Ref], **extra):
        self.name, self.transform, self.expression, self.sources = name, transform, expression, sources
        self.agg_function = extra.get("agg_function")
        self.merge_branch = extra.get("merge_branch")
        self.case_branches = extra.get("case_branches", [])
        self.window = extra.get("window")
        self.magic = extra.get("magic")
        self.case_in_aggregate = extra.get("case_in_aggregate", False)
        self.constant = extra.get("constant", False)


class Scope:
    def __init__(self, kind: str):
        self.id, self.kind, self.distinct = "", kind, False
        self.columns: list[Column] = []
        self.joins, self.filters, self.orders, self.generators = [], [], [], []
        self.groups: list[Ref] = []
        self.branches: list[Scope] = []
        self.set_op = self.alias = self.limit = self.grouping = self.writes_to = None
        self.branch_index: int | None = None
        self.stars: list[Source] = []  # sources behind an unexpanded star
        self.inner: list[str] = []  # scopes of EXISTS and IN subqueries

    def names(self) -> list[str]:
        return [c.name for c in self.columns if c.transform != "EXPAND_ALL"]

    def has(self, name: str) -> bool:
        return any(c.name == name and c.transform != "EXPAND_ALL" for c in self.columns)


class Source:
    """What a FROM clause names: a table (scope None) or a scope."""

    def __init__(self, alias: str, table: str = "", scope: Scope | None = None, generated: bool = False, columns: list[str] | None = None):
        self.alias, self.table, self.scope, self.generated, self.columns = alias, table, scope, generated, columns

    @property
    def id(self) -> str:
        return self.scope.id if self.scope else self.table


class Context:
    """Where names of a SELECT are looked up; `parent` for correlated subqueries."""

    def __init__(self, scope: Scope, parent: Context | None):
        self.scope, self.parent = scope, parent
        self.sources: list[Source] = []
        self.windows: dict[str, Node] = {}


class Analysis:
    """One statement.  After `run`: scopes in bottom-up order, warnings and the statement's facts."""

    def __init__(self, text: str, statement: Node, lookup: Callable[[str], list[str] | None] | None):
        self.text, self.statement = text, statement
        self.lookup = lookup or (lambda _: None)
        self.has_schema = lookup is not None
        self.scopes: list[Scope] = []
        self.used: dict[str, int] = {}
        self.warnings: list[tuple[str, str, str]] = []
        self.tables: set[str] = set()
        self.derived = 0

    # -- building --
    def register(self, scope: Scope, base: str) -> Scope:
        n = self.used[base] = self.used.get(base, 0) + 1
        scope.id = base if n == 1 else f"{base}_{n}"
        self.scopes.append(scope)
        return scope

    def warn(self, kind: str, scope: Scope, message: str) -> None:
        self.warnings.append((kind, scope.id, message))

    def slice(self, e: Node) -> str:
        return self.text[e.start : e.end]

    def run(self) -> Analysis:
        s = self.statement
        if s.kind == "merge":
            self.merge(s)
        else:
            env = self.with_ctes(s.ctes, {}, None)
            root = self.query(self.unwrap(s.query), Scope("root"), "ROOT", "main", env, None)
            root.writes_to = s.target
            if s.columns and len(s.columns) == len(root.columns):
                for c, name in zip(root.columns, s.columns, strict=True):
                    c.name = name
        self.scopes = [sc for sc in self.scopes if sc.id != "ROOT"] + [sc for sc in self.scopes if sc.id == "ROOT"]
        return self

    def unwrap(self, q: Node) -> Node:
        """A SELECT of bare columns over nothing but one set operation is that set operation."""
        s = q.body
        if s.kind == "query" and not q.ctes:
            return self.unwrap(s)
        if s.kind != "select" or q.order or q.limit or not s.relations or len(s.relations) != 1:
            return q
        j = s.relations[0]
        plain = all(i.expr.kind == "star" and not i.expr.without or i.expr.kind == "column" and i.alias in (None, i.expr.parts[-1]) for i in s.items)
        if j.joins or s.laterals or s.where or s.group or s.grouping or s.having or s.distinct or s.qualify or not plain:
            return q
        r = j.kids[0]
        if r.what != "query" or r.columns or r.query.order or r.query.limit or r.query.body.kind != "setop":
            return q
        return Node("query", q.start, q.end, ctes=[*q.ctes, *r.query.ctes], body=r.query.body, order=[], limit=None)

    def with_ctes(self, ctes: list, env: dict[str, Scope], parent: Context | None) -> dict[str, Scope]:
        env = dict(env)
        for name, q, columns in ctes:
            scope = self.query(q, Scope("cte"), f"cte:{name}", name, env, parent)
            self.rename(scope, columns)
            env[name] = scope
        return env

    @staticmethod
    def rename(scope: Scope, columns: list[str]) -> None:
        if columns and len(columns) == len(scope.columns):
            for c, name in zip(scope.columns, columns, strict=True):
                c.name = name

    def query(self, q: Node, scope: Scope, base: str, owner: str, env: dict[str, Scope], parent: Context | None) -> Scope:
        if q.kind == "query":
            env = self.with_ctes(q.ctes, env, parent)
            scope.limit = q.limit or scope.limit
            body, order = q.body, q.order
        else:
            body, order = q, []
        if body.kind == "query":
            return self.query(body, scope, base, owner, env, parent)
        if body.kind == "setop":
            self.set_operation(body, scope, base, owner, env, parent)
            ctx = Context(scope, None)
        elif body.kind == "values":
            self.values(body, scope, base)
            ctx = Context(scope, None)
        else:
            ctx = self.select(body, scope, base, env, parent)
        for e, way in order:
            scope.orders += [(*r, way) for r in self.order_refs(e, ctx)]
        return scope

    def equal(self, e: Node, ctx: Context, env: dict[str, Scope]) -> list[tuple[Ref, Ref]]:
        """Pairs of columns a condition holds equal, resolved."""
        return [(self.refs(a, ctx, env)[0], self.refs(b, ctx, env)[0]) for a, b in conditions.equalities(e)]

    def order_refs(self, e: Node, ctx: Context) -> list[Ref]:
        if e.kind == "literal" and e.type == "number" and e.text.isdigit():
            at = int(e.text) - 1
            return [(ctx.scope.id, ctx.scope.columns[at].name)] if 0 <= at < len(ctx.scope.columns) else []
        if e.kind == "column" and len(e.parts) == 1 and ctx.scope.has(e.parts[0]):
            return [(ctx.scope.id, e.parts[0])]
        return self.refs(e, ctx)

    def set_operation(self, body: Node, scope: Scope, base: str, owner: str, env: dict[str, Scope], parent: Context | None) -> None:
        """One container with a branch per operand of a chain of the same operation."""
        operands: list[Node] = []

        def flatten(n: Node) -> None:
            if n.kind == "setop" and n.op == body.op and n.all == body.all and n.op != "except":
                flatten(n.left)
                flatten(n.right)
            elif n.kind == "setop" and n.op == "except" and body.op == "except" and n.all == body.all and n is body:
                flatten(n.left)
                operands.append(n.right)
            else:
                operands.append(n)

        flatten(body)
        box = Scope("union")
        box.set_op = body.op.upper() + ("_ALL" if body.all else "")
        name = f"union:{owner}"
        n = self.used.get(name, 0)
        if n:
            owner = f"{owner}_{n + 1}"
        for i, o in enumerate(operands):
            b = Scope("union_branch")
            b.branch_index = i
            self.query(o, b, f"union:{owner}:b{i + 1:02d}", f"{owner}:b{i + 1:02d}", env, parent)
            box.branches.append(b)
        self.register(box, name)
        lead = box.branches[0].columns
        for at, c in enumerate(lead):
            sources = []
            for b in box.branches:
                if at < len(b.columns):
                    own = b.columns[at]
                    if re.fullmatch(r"_col_\d+", own.name) and b is not box.branches[0]:
                        own.name = c.name
                    sources.append((b.id, own.name))
            box.columns.append(Column(c.name, "EXPAND_ALL" if c.transform == "EXPAND_ALL" else "UNION", None, sources))
        self.register(scope, base)
        scope.columns = [Column(c.name, "EXPAND_ALL" if c.transform == "EXPAND_ALL" else "UNION", None, [(box.id, c.name)]) for c in box.columns]
        scope.stars = [Source("", scope=box)] if any(c.transform == "EXPAND_ALL" for c in box.columns) else []
        if scope.stars:
            box.stars = [Source("", scope=b) for b in box.branches]

    def values(self, body: Node, scope: Scope, base: str) -> None:
        self.register(scope, base)
        if body.rows:
            for i, e in enumerate(body.rows[0]):
                scope.columns.append(Column(f"_col_{i}", "CONSTANT" if e.kind == "literal" else "EXPRESSION", self.slice(e), [("CONSTANT", self.slice(e))], constant=conditions.is_constant(e)))

    def relation(self, r: Node, ctx: Context, env: dict[str, Scope]) -> list[Source]:
        if r.what == "group":
            out = [x for j in r.inner for x in self.joined(j, ctx, env)]
            return out
        if r.what == "query" and r.query.body.kind == "values" and not (r.query.ctes or r.query.order or r.query.limit):
            r.what, r.values = "values", r.query.body
        if r.what == "query":
            alias = r.alias or f"derived_{self.derived}"
            if not r.alias:
                self.derived += 1
            scope = self.query(r.query, Scope("subquery"), f"subq:{alias}", alias, env, ctx if r.lateral else ctx.parent)
            self.rename(scope, r.columns)
            scope.alias = r.alias
            return [Source(r.alias or "", scope=scope)]
        if r.what == "values":
            alias = r.alias or "values"
            scope = Scope("subquery")
            self.values(r.values, scope, f"udtf:{alias}")
            self.rename(scope, r.columns)
            scope.alias = r.alias
            return [Source(alias, scope=scope)]
        if r.what == "function":
            alias = r.alias or r.function
            scope = self.generator(Node("function", r.start, r.end, name=r.function, kids=r.args, distinct=False), alias, r.columns, ctx)
            return [Source(alias, scope=scope, generated=True)]
        if len(r.parts) == 1 and r.parts[0] in env:
            return [Source(r.alias or r.parts[0], scope=env[r.parts[0]])]
        self.tables.add(r.name)
        return [Source(r.alias or r.parts[-1], table=r.name, columns=self.lookup(r.name))]

    def joined(self, j: Node, ctx: Context, env: dict[str, Scope]) -> list[Source]:
        own = self.relation(j.kids[0], ctx, env)
        ctx.sources += [s for s in own if s not in ctx.sources]
        for x in j.joins:
            if x.how == "LATERAL":
                self.lateral(x.right, ctx)
                continue
            right = self.relation(x.right, ctx, env)
            ctx.sources += [s for s in right if s not in ctx.sources]
            own += right
            ctx.scope.joins.append((x, right))
        return own

    def lateral(self, view: Node, ctx: Context) -> None:
        alias = view.alias or "derived"
        ctx.sources.append(Source(alias, scope=self.generator(view.expr, alias, view.columns, ctx), generated=True))

    def generator(self, e: Node, alias: str, columns: list[str], ctx: Context) -> Scope:
        scope = Scope("subquery")
        sources = self.leaf_refs(e, ctx, "EXPRESSION")
        names = columns or self.generated_names(e)
        self.register(scope, f"udtf:{alias}")
        scope.alias = alias
        scope.columns = [Column(n, "EXPRESSION", self.slice(e), list(sources)) for n in names]
        scope.generators.append((alias, e.name if e.kind == "function" else "", self.slice(e), names))
        return scope

    def generated_names(self, e: Node) -> list[str]:
        """Names a generator has without AS: of inline, the members of the struct its schema text ends in."""
        name = e.name.removesuffix("_outer") if e.kind == "function" else ""
        if name == "posexplode":
            return ["pos", "col"]
        if name == "inline":
            text = self.slice(e).lower()
            at = text.rfind("array<struct<")
            at = at + len("array<struct<") if at >= 0 else (text.find("struct<") + len("struct<") if "struct<" in text else -1)
            if at >= 0:
                return struct_members(text[at:])
        return ["col"]

    def select(self, s: Node, scope: Scope, base: str, env: dict[str, Scope], parent: Context | None) -> Context:
        ctx = Context(scope, parent)
        ctx.windows = s.windows
        scope.distinct = s.distinct
        scope.grouping = s.grouping or None
        scope.id = base  # for warnings raised before the scope is registered
        for j in s.relations or []:
            self.joined(j, ctx, env)
        for view in s.laterals:
            self.lateral(view, ctx)
        self.env = env
        clauses = [s.where, s.having, s.qualify, *s.group, *(x.on for x, _ in scope.joins)]
        items = s.items
        for i, item in enumerate(items):
            self.project(i, item, ctx, env, clauses)
        self.dedupe(scope)
        joins, scope.joins = scope.joins, []
        first = ctx.sources[0].id if ctx.sources else None
        for x, right in joins:
            refs = self.refs(x.on, ctx, env) if x.on else []
            for name in x.using:
                refs += [(y.id, name) for y in [ctx.sources[0], *right]]
            text = self.slice(x.on) if x.on else ("using(" + ", ".join(x.using) + ")" if x.using else None)
            scope.joins.append({"join_type": x.how, "left_scope": first, "right_scope": right[0].id if right else None, "alias": right[0].alias if right else None, "condition": text, "refs": refs, "literal": bool(x.on and compares_literal(x.on)), "said": conditions.told(x.on), "equal": self.equal(x.on, ctx, env) if x.on else [(r, (y.id, n)) for n in x.using for y in right for r in refs[:1] if r[1] == n]})
        for clause, e in (("WHERE", s.where), ("HAVING", s.having), ("QUALIFY", s.qualify)):
            if e is not None:
                scope.filters.append((clause, self.slice(e), self.refs(e, ctx, env), conditions.told(e)))
        for e in s.group:
            if e.kind == "literal" and e.type == "number" and e.text.isdigit() and 0 < int(e.text) <= len(items):
                e = items[int(e.text) - 1].expr
            elif e.kind == "column" and len(e.parts) == 1:
                own = next((i.expr for i in items if i.alias == e.parts[0] and i.expr.kind != "column"), None)
                if own is not None and not any(self.state(x, e.parts[0]) == "present" for x in ctx.sources):
                    e = own
            scope.groups += [r for r in self.refs(e, ctx, env) if r not in scope.groups]
        kept, scope.id = scope.id, ""
        self.register(scope, base)
        if scope.id != kept:
            self.warnings = [(k, scope.id if at == kept else at, m) if i >= 0 else (k, at, m) for i, (k, at, m) in enumerate(self.warnings)]
        return ctx

    # -- projections --
    def project(self, ordinal: int, item: Node, ctx: Context, env: dict[str, Scope], clauses: list) -> None:
        e, scope = item.expr, ctx.scope
        if item.aliases:
            sources = self.leaf_refs(e, ctx, "EXPRESSION", env)
            scope.columns += [Column(n, "EXPRESSION", self.slice(e), list(sources)) for n in item.aliases]
            return
        if e.kind == "function" and e.name in GENERATORS:
            names = [item.alias] if item.alias else self.generated_names(e)
            sources = self.leaf_refs(e, ctx, "EXPRESSION", env)
            scope.columns += [Column(n, "EXPRESSION", self.slice(e), list(sources)) for n in names]
            return
        if e.kind == "star":
            self.expand(e, ctx, clauses)
            return
        name = item.alias or (e.parts[-1] if e.kind == "column" else f"_col_{ordinal}")
        self.add(name, e, ctx, env)

    def add(self, name: str, e: Node, ctx: Context, env: dict[str, Scope], branch: str | None = None) -> None:
        core = e
        while core.kind == "group":
            core = core.kids[0]
        runtime = core.kind == "column" and len(core.parts) == 1 and core.parts[0] in RUNTIME and not any(self.state(s, core.parts[0]) == "present" for s in ctx.sources)
        transform = self.transform_of(core)
        if runtime:
            transform = "EXPRESSION"
        extra: dict = {"merge_branch": branch}
        if core.kind == "case":
            extra["case_branches"] = [(self.slice(w), self.slice(t)) for w, t in core.branches] + ([("ELSE", self.slice(core.otherwise))] if core.otherwise else [])
        elif core.kind == "function" and core.name == "if" and len(core.kids) > 1:
            extra["case_branches"] = [(self.slice(core.kids[0]), self.slice(core.kids[1]))] + ([("ELSE", self.slice(core.kids[2]))] if len(core.kids) > 2 else [])
        if transform == "AGGREGATE":
            extra["agg_function"] = core.name.upper()
            extra["case_in_aggregate"] = any(x.kind == "function" and x.name in SUMMARIES and any(y.kind == "case" for y in walk(x)) for x in walk(core))
        if core.kind == "window":
            spec = core.spec or ctx.windows.get(core.named) or Node("spec", 0, partition=[], order=[], frame="")
            extra["window"] = {
                "partition_by": [r for p in spec.partition for r in self.refs(p, ctx, env)],
                "order_by": [(*r, way) for p, way in spec.order for r in self.refs(p, ctx, env)],
                "function": core.call.name.upper(), "frame": spec.frame,
            }
        extra["magic"] = magic_number(e)
        extra["constant"] = conditions.is_constant(core)
        ctx.scope.columns.append(Column(name, transform, None if transform == "DIRECT" else self.slice(e), self.leaf_refs(core, ctx, transform, env), **extra))

    def transform_of(self, e: Node) -> str:
        if e.kind == "column":
            return "DIRECT"
        if e.kind == "literal" or e.kind == "unary" and e.kids[0].kind == "literal":
            return "CONSTANT"
        if e.kind == "window":
            return "WINDOW"
        if e.kind == "case" or e.kind == "function" and e.name == "if":
            return "CONDITIONAL"
        if e.kind == "function" and e.name in AGGREGATES:
            return "AGGREGATE"
        return "EXPRESSION"

    def leaf_refs(self, e: Node, ctx: Context, transform: str, env: dict[str, Scope] | None = None) -> list[Ref]:
        """Sources of an expression; if it names no column, the leaf that stands for it."""
        refs = self.refs(e, ctx, env)
        if refs:
            return refs
        if transform in ("AGGREGATE", "WINDOW") and ctx.sources:
            return [(s.id, "*") for s in ctx.sources]
        if any(x.kind == "function" and x.name in RUNTIME or x.kind == "column" and len(x.parts) == 1 and x.parts[0] in RUNTIME for x in walk(e)):
            return [("SYSTEM", self.slice(e))]
        return [("CONSTANT", self.slice(e))]

    def expand(self, e: Node, ctx: Context, clauses: list) -> None:
        scope = ctx.scope
        chosen = ctx.sources if e.of is None else [s for s in ctx.sources if s.alias == e.of or s.table == e.of]
        if e.of is not None and not chosen:
            self.warn("unresolved_alias", scope, f"{e.of} is not a source")
            scope.columns.append(Column(f"{e.of}.*", "EXPAND_ALL", f"{e.of}.*", [("UNKNOWN", "*")]))
            return
        if chosen and all(self.closed(s) for s in chosen):
            for s in chosen:
                names = list(dict.fromkeys(s.scope.names() if s.scope else s.columns))
                if not s.scope:
                    names += [n for n in self.named_in(clauses, s, ctx) if n not in names]
                scope.columns += [Column(n, "DIRECT", None, [(s.id, n)]) for n in names if n not in e.without]
            return
        for s in chosen:
            known = s.scope.names() if s.scope else (s.columns or [])
            scope.columns += [Column(n, "DIRECT", None, [(s.id, n)]) for n in dict.fromkeys(known) if n not in e.without]
        star = f"{e.of}.*" if e.of else "*"
        scope.columns.append(Column(star, "EXPAND_ALL", star, [(s.id, "*") for s in chosen if not self.closed(s)] or [("UNKNOWN", "*")]))
        scope.stars += [s for s in chosen if not self.closed(s)]
        self.warn("star_not_expanded", scope, f"{star} over {', '.join(s.id for s in chosen) or 'nothing'}")

    @staticmethod
    def closed(s: Source) -> bool:
        """All columns of the source are known."""
        return not s.scope.stars and not any(c.transform == "EXPAND_ALL" for c in s.scope.columns) if s.scope else s.columns is not None

    def named_in(self, clauses: list, s: Source, ctx: Context) -> list[str]:
        """Columns the clauses name of a table, listed in its schema or not (partition columns often are not)."""
        alone = len([x for x in ctx.sources if not x.generated]) == 1
        out = []
        for clause in clauses:
            for x in walk(clause) if clause is not None else ():
                if x.kind == "column" and (len(x.parts) == 2 and x.parts[0] == s.alias or len(x.parts) == 1 and alone and x.parts[0] not in RUNTIME):
                    name = x.parts[-1]
                    if not any(o.generated and o.scope.has(name) for o in ctx.sources):
                        out.append(name)
        return out

    def dedupe(self, scope: Scope) -> None:
        """One column per name and merge branch: sources united, strongest transform, first expression."""
        kept: dict[tuple, Column] = {}
        for c in scope.columns:
            first = kept.setdefault((c.name, c.merge_branch), c)
            if first is not c:
                first.sources += [r for r in c.sources if r not in first.sources]
                if STRENGTH[c.transform] > STRENGTH[first.transform]:
                    first.transform = c.transform
                first.expression = first.expression if first.expression is not None else c.expression
        scope.columns = list(kept.values())

    # -- names --
    def refs(self, e: Node, ctx: Context, env: dict[str, Scope] | None = None) -> list[Ref]:
        """Columns an expression names, in order, once each; nested queries become scopes of their own."""
        out: dict[Ref, None] = {}
        stack: list[tuple[Node, frozenset]] = [(e, frozenset())]
        env = env if env is not None else getattr(self, "env", {})
        while stack:
            x, hidden = stack.pop()
            if x.kind in ("scalar", "exists", "in_query"):
                self.nested(x, ctx, env, out)
            if x.kind == "column":
                if x.parts[0] in hidden:
                    continue
                if len(x.parts) == 1 and x.parts[0] in RUNTIME and not any(self.state(s, x.parts[0]) == "present" for s in ctx.sources):
                    continue
                out.setdefault(self.resolve(x.parts, ctx))
            elif x.kind == "star" and x is not e:
                for s in ctx.sources if x.of is None else [s for s in ctx.sources if s.alias == x.of]:
                    out.setdefault((s.id, "*"))
            if x.kind == "lambda":
                hidden = hidden | frozenset(x.names)
            kids = list(x.kids)
            if x.kind == "window":
                spec = x.spec or ctx.windows.get(x.named)
                kids = [x.call, *(spec.partition if spec else ()), *(o for o, _ in (spec.order if spec else ()))]
            stack += [(k, hidden) for k in reversed(kids)]
        return list(out)

    def nested(self, x: Node, ctx: Context, env: dict[str, Scope], out: dict[Ref, None]) -> None:
        if getattr(x, "scope", None) is None:
            alias = f"derived_{self.derived}"
            self.derived += 1
            x.scope = self.query(x.query, Scope("subquery"), f"subq:{alias}", alias, env, ctx)
        if x.kind == "scalar":
            for c in x.scope.columns[:1]:
                out.setdefault((x.scope.id, c.name))
        elif x.scope.id not in ctx.scope.inner:
            ctx.scope.inner.append(x.scope.id)

    @staticmethod
    def state(s: Source, name: str) -> str:
        if s.scope:
            if s.scope.has(name):
                return "present"
            return "unknown" if s.scope.stars else "absent"
        if s.columns is None:
            return "unknown"
        return "present" if name in s.columns else "absent"

    def take(self, s: Source, name: str) -> Ref:
        """The column of a source, put into its star if it has to come from there."""
        if s.scope and not s.scope.has(name):
            self.materialize(s.scope, name)
        return s.id, name

    def materialize(self, scope: Scope, name: str, seen: frozenset = frozenset()) -> bool:
        """Adds a column to a scope with an unexpanded star; a set operation passes it to every branch."""
        if scope.has(name):
            return True
        if not scope.stars or scope.id in seen:
            return False
        seen = seen | {scope.id}
        if scope.kind == "union":
            got = [s.id for s in scope.stars if self.materialize(s.scope, name, seen)]
            if got:
                scope.columns.append(Column(name, "UNION", None, [(i, name) for i in got]))
            return bool(got)
        known = [s for s in scope.stars if self.state(s, name) == "present"]
        for s in known or [s for s in scope.stars if not s.generated]:
            if s.scope is None and s.columns is not None and name not in s.columns:
                continue
            if s.scope is None or self.materialize(s.scope, name, seen):
                union = s.scope is not None and s.scope.kind == "union"
                scope.columns.append(Column(name, "UNION" if union else "DIRECT", None, [(s.id, name)]))
                return True
        return False

    def resolve(self, parts: list[str], ctx: Context) -> Ref:
        if len(parts) == 1:
            return self.unqualified(parts[0], ctx)
        level: Context | None = ctx
        while level is not None:
            for k in range(len(parts) - 1, 0, -1):
                prefix = ".".join(parts[:k])
                same = [s for s in level.sources if s.alias == prefix and k == 1 or s.table and (s.table == prefix or k > 1 and s.table.endswith("." + prefix))]
                if same:
                    name = parts[k]
                    if len(same) > 1:
                        return self.among(prefix, same, name, level)
                    return self.take(same[0], name)
            level = level.parent
        for s in ctx.sources:
            if self.state(s, parts[0]) == "present":
                return self.take(s, parts[0])
        self.warn("unresolved_alias", ctx.scope, f"{parts[0]} in {'.'.join(parts)} is not a source")
        return "UNKNOWN", parts[-1]

    def among(self, alias: str, same: list[Source], name: str, ctx: Context) -> Ref:
        """Sources that share an alias: the first known to have the column, else the only one that may."""
        self.warn("duplicate_alias", ctx.scope, f"{alias} names {len(same)} sources; column {name}")
        states = [self.state(s, name) for s in same]
        if "present" in states:
            return self.take(same[states.index("present")], name)
        if states.count("unknown") == 1:
            return self.take(same[states.index("unknown")], name)
        return "UNKNOWN", name

    def unqualified(self, name: str, ctx: Context) -> Ref:
        scoped = [s for s in ctx.sources if s.scope]
        chosen = [s for s in scoped if not s.generated]
        tables = [s for s in ctx.sources if not s.scope]
        for level in (chosen, scoped, [s for s in scoped if s.generated]):
            has = [s for s in level if s.scope.has(name)]
            if len(has) == 1:
                return self.take(has[0], name)
            if len(has) > 1 and level is chosen:
                self.warn("ambiguous_unqualified", ctx.scope, f"{name} is in {', '.join(s.id for s in has)}")
                return self.take(has[0], name)
        for s in tables:
            if s.columns is not None and name in s.columns:
                return s.id, name
        if ctx.parent is not None and not any(s.columns is None for s in tables) and not any(s.scope.stars for s in chosen):
            above: Context | None = ctx.parent
            while above is not None:
                for s in above.sources:
                    if self.state(s, name) == "present":
                        return self.take(s, name)
                above = above.parent
        for s in tables:
            if s.columns is None:
                self.warn("unresolved_unqualified_no_schema", ctx.scope, f"{name} is taken from {s.id}")
                return s.id, name
        open_ = [s for s in chosen if s.scope.stars]
        if open_:
            if len(open_) > 1:
                self.warn("ambiguous_unqualified", ctx.scope, f"{name} may be in {', '.join(s.id for s in open_)}")
            return self.take(open_[0], name)
        if len(scoped) == 1 and chosen:
            return self.take(chosen[0], name)
        self.warn("column_not_found", ctx.scope, f"{name} is in no source")
        return "UNKNOWN", name

    # -- MERGE --
    def merge(self, m: Node) -> None:
        root = Scope("root")
        ctx = Context(root, None)
        root.id = "ROOT"
        self.env = {}
        using = self.relation(m.using, ctx, {})
        target = Source(m.target_alias or m.target.rpartition(".")[2], table=m.target, columns=self.lookup(m.target))
        ctx.sources = [*using, target]
        for a in m.actions:
            if a.condition is not None:
                root.filters.append(("WHEN", self.slice(a.condition), self.refs(a.condition, ctx, {}), conditions.told(a.condition)))
            if a.what == "delete":
                self.warn("merge_delete_ignored", root, f"WHEN {a.branch.upper()} THEN DELETE gives no column")
            elif a.what.endswith("_star"):
                names = using[0].scope.names() if using[0].scope else using[0].columns or []
                if not names:
                    root.columns.append(Column("*", "EXPAND_ALL", "*", [(using[0].id, "*")], merge_branch=a.branch))
                    self.warn("star_not_expanded", root, f"* over {using[0].id}")
                root.columns += [Column(n, "DIRECT", None, [(using[0].id, n)], merge_branch=a.branch) for n in names]
            for name, e in a.pairs:
                self.add(name, e, ctx, {}, a.branch)
        self.dedupe(root)
        root.joins.append({"join_type": "MERGE", "left_scope": m.target, "right_scope": using[0].id, "alias": using[0].alias, "condition": self.slice(m.on), "refs": self.refs(m.on, ctx, {}), "literal": compares_literal(m.on), "said": conditions.told(m.on), "equal": self.equal(m.on, ctx, {})})
        root.writes_to = m.target
        self.register(root, "ROOT")


def walk(e: Node):
    """The node and all below it, nested queries left out."""
    stack = [e]
    while stack:
        x = stack.pop()
        yield x
        if x.kind == "window":
            stack += [x.call, *(x.spec.partition if x.spec else ()), *(o for o, _ in (x.spec.order if x.spec else ()))]
        stack += x.kids


def compares_literal(e: Node) -> bool:
    return any(x.kind == "binary" and x.op in COMPARISONS and any(k.kind == "literal" or k.kind == "unary" and k.kids[0].kind == "literal" for k in x.kids) for x in walk(e))


def magic_number(e: Node) -> str | None:
    """The first number of an expression that is not 0, 1, -1 or 100."""
    found: list[tuple[int, str]] = []
    stack = [(e, False)]
    while stack:
        x, minus = stack.pop()
        if x.kind == "literal" and x.type == "number":
            text = ("-" if minus else "") + x.text
            if text not in PLAIN_NUMBERS:
                found.append((x.start, text))
        kids = [x.call] if x.kind == "window" else x.kids
        stack += [(k, x.kind == "unary" and x.op == "-") for k in kids]
    return min(found)[1] if found else None


def struct_members(text: str) -> list[str]:
    """Names of the members of a struct type, from after its opening bracket."""
    names, depth, at = [], 0, 0
    for m in re.finditer(r"[<>(),:]|$", text):
        ch = m[0]
        if ch == ":" and depth == 0:
            names.append(text[at : m.start()].strip(" `'\""))
        if ch in "<(" and ch:
            depth += 1
        elif ch in ">)" and ch:
            if depth == 0:
                break
            depth -= 1
        elif ch == "," and depth == 0:
            at = m.end()
    return [n for n in names if n]


def facts(task_id: str, text: str, lookup: Callable[[str], list[str] | None] | None = None) -> list[dict]:
    """One record per statement of a task; what cannot be read is kept with its error."""
    parsed: list[tuple[str, Node | None, str, str]] = []
    for a, b in split(text or ""):
        own = text[a:b]
        try:
            found = parse(own)
            parsed += [(own, n, "ok", "") for n in found] or [(own, None, "other", "not an INSERT or MERGE")]
        except SqlError as e:
            parsed.append((own, None, "error", str(e)))
    if not parsed:
        return [record(task_id, 0, 1, "empty", "no statement")]
    several = sum(1 for _, _, status, _ in parsed if status != "other")
    out, no = [], 0
    for own, node, status, error in parsed:
        if status == "ok":
            try:
                out.append(describe(task_id, no, several, Analysis(own, node, lookup).run()))
            except (RecursionError, SqlError) as e:
                out.append(record(task_id, no, several, "error", str(e) or "nested too deeply"))
        else:
            out.append(record(task_id, no, several, status, error))
        no += status != "other"
    return out


def record(task_id: str, no: int, several: int, status: str, error: str) -> dict:
    kind = {"error": "PARSE_ERROR", "empty": "EMPTY"}.get(status, "OTHER")
    warnings = [{"ordinal": 0, "type": kind, "scope_id": "ROOT", "msg": error}] if status == "error" else []
    return {"task_id": task_id, "stmt_no": no, "stmt": f"{task_id}#{no}" if several > 1 else task_id, "status": status, "error": error or None, "target_table": None, "stmt_kind": None, "source_tables": [], "partition_columns": [], "warnings": warnings, "scopes": []}


def describe(task_id: str, no: int, several: int, a: Analysis) -> dict:
    out = record(task_id, no, several, "ok", "")
    s = a.statement
    ref = lambda r: {"scope": r[0], "column": r[1]}
    ids = {x.id for x in a.scopes}
    depends: dict[str, list[str]] = {}
    for x in a.scopes:
        used = [r for c in x.columns for r in c.sources]
        used += [r for c in x.columns if c.window for r in c.window["partition_by"]] + [r[:2] for c in x.columns if c.window for r in c.window["order_by"]]
        used += [r for j in x.joins for r in j["refs"]] + [(j["right_scope"], "") for j in x.joins] + [(j["left_scope"], "") for j in x.joins]
        used += [r for f in x.filters for r in f[2]] + x.groups + [r[:2] for r in x.orders]
        depends[x.id] = sorted({r[0] for r in used if r[0]} - {x.id, "CONSTANT", "SYSTEM", "UNKNOWN", *([x.writes_to] if s.kind == "merge" else [])})
    deep: dict[str, int] = {}
    for x in a.scopes:  # bottom-up, so what a scope reads is done
        deep[x.id] = 1 + max((deep.get(d, 0) for d in depends[x.id]), default=0)
    out.update(target_table=s.target, stmt_kind="MERGE" if s.kind == "merge" else "INSERT_OVERWRITE" if s.overwrite else "INSERT", source_tables=sorted(a.tables), partition_columns=[k for k, _ in s.partition] if s.kind == "insert" else [])
    out["warnings"] = [{"ordinal": i, "type": k, "scope_id": at, "msg": m} for i, (k, at, m) in enumerate(dict.fromkeys(a.warnings))]
    for x in a.scopes:
        out["scopes"].append(
            {
                "scope_id": x.id, "kind": x.kind, "is_distinct": x.distinct, "depth": deep[x.id], "writes_to": x.writes_to, "alias_in_parent": x.alias, "set_op": x.set_op, "limit_text": x.limit, "grouping": x.grouping,
                "branches": [b.id for b in x.branches], "branch_index": x.branch_index, "depends_on": depends[x.id], "reads_scopes": [d for d in depends[x.id] if d in ids], "inner_scopes": x.inner,
                "columns": [
                    {
                        "ordinal": i, "name": c.name, "transform": c.transform, "expression": c.expression, "agg_function": c.agg_function, "merge_branch": c.merge_branch,
                        "sources": [ref(r) for r in c.sources], "case_branches": [{"when_expr": w, "then_value": t} for w, t in c.case_branches],
                        "window": c.window and {"partition_by": [ref(r) for r in c.window["partition_by"]], "order_by": [{"scope": r[0], "column": r[1], "direction": r[2]} for r in c.window["order_by"]], "function": c.window["function"], "frame": c.window["frame"]},
                        "magic_number": c.magic, "case_in_aggregate": c.case_in_aggregate, "is_constant": c.constant,
                    }
                    for i, c in enumerate(x.columns)
                ],
                "joins": [{"join_no": i, "join_type": j["join_type"], "left_scope": j["left_scope"], "right_scope": j["right_scope"], "alias_in_parent": j["alias"], "condition_expression": j["condition"], "condition_columns": [ref(r) for r in j["refs"]], "compares_literal": j["literal"],
                    "shape": j["said"]["shape"], "operators": j["said"]["operators"], "equal": [{"left_scope": l[0], "left_column": l[1], "right_scope": r[0], "right_column": r[1]} for l, r in j["equal"]]} for i, j in enumerate(x.joins)],
                "filters": [{"clause": c, "expression": t, "columns": [ref(r) for r in rs], **said} for c, t, rs, said in x.filters],
                "group_by": [ref(r) for r in x.groups],
                "order_by": [{"scope": r[0], "column": r[1], "direction": r[2]} for r in x.orders],
                "generators": [{"alias": g[0], "function": g[1], "expression": g[2], "output_columns": g[3]} for g in x.generators],
            }
        )
    out["warnings"] += [{"ordinal": i, "type": k, "scope_id": at, "msg": m} for i, (k, at, m) in enumerate(detected(out), len(out["warnings"]))]
    return out


def detected(record: dict) -> list[tuple[str, str, str]]:
    """What the four detectors find in a statement: (type, scope, message)."""
    out = []
    by_id = {s["scope_id"]: s for s in record["scopes"]}
    for s in record["scopes"]:
        out += [("filter_in_join_on_clause", s["scope_id"], j["condition_expression"]) for j in s["joins"] if j["compares_literal"] and j["join_type"] != "MERGE"]
        out += [("magic_number", s["scope_id"], f"{c['name']}: {c['magic_number']}") for c in s["columns"] if c["magic_number"] is not None]
        out += [("complex_aggregate_with_case", s["scope_id"], c["name"]) for c in s["columns"] if c["case_in_aggregate"]]
        if s["kind"] == "union":
            times: dict[str, int] = {}
            for b in s["branches"]:
                own = by_id[b]
                for t in sorted(set(own["depends_on"]) - set(own["reads_scopes"])):
                    times[t] = times.get(t, 0) + 1
            out += [("duplicate_table_in_union", s["scope_id"], t) for t, n in times.items() if n > 1]
    return out
