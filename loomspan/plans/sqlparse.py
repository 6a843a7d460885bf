"""A parser for warehouse statements that runs on the executors.

Executors have no JVM gateway, and a corpus is too large to be parsed on the driver, so statements
are parsed in Python, one narrow task per batch of texts.  Operator precedence is climbed from one
table; every node keeps its place in the source, so expression text is a slice of what was written.
Statements that are not INSERT or MERGE parse to their leading keyword.  Errors raise SqlError.
"""

from __future__ import annotations

import re

from loomspan.functions.names import py_table_name

# Words that end a clause and so cannot be an alias without AS.
_STOP = frozenset(
    """from where group having order limit union except minus intersect on using join inner left right full cross natural lateral window
    sort distribute cluster when then else end as and or not select values insert with tablesample semi anti pivot unpivot qualify matched
    set by between in is like rlike regexp ilike asc desc nulls over filter offset""".split()
)
_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>[rR]?'(?:[^'\\]|\\.|'')*'|[rR]?"(?:[^"\\]|\\.|"")*")|(?P<quoted>`(?:[^`]|``)*`)
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:BD|[LSYDFlsydf])?(?![\w]))|(?P<word>[^\W\d]\w*|\d\w+|\$\{[^}]*\}|\$\w+)|(?P<op><=>|->|=>|<>|!=|<=|>=|==|\|\||::|<<|>>|[-+*/%=<>(),.;\[\]&|^~!?:@{}])""",
    re.VERBOSE | re.DOTALL,
)
#: Binary operators by how tightly they bind.
_BINDING = {"or": 1, "and": 2, "=": 4, "==": 4, "<=>": 4, "<>": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "||": 8, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9, "div": 9}
COMPARISONS = frozenset(("=", "==", "<=>", "<>", "!=", "<", ">", "<=", ">="))


class SqlError(ValueError):
    pass


class Node:
    """kind, place in the text, children and whatever the kind needs."""

    def __init__(self, kind: str, start: int, end: int = -1, **fields):
        self.kind, self.start, self.end = kind, start, end
        self.kids: list[Node] = fields.pop("kids", [])
        self.__dict__.update(fields)


def lex(text: str) -> list[tuple[str, str, int, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SqlError(f"unexpected character at {at}: {text[at : at + 20]!r}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0], m.start(), m.end()))
        at = m.end()
    out.append(("end", "", len(text), len(text)))
    return out


def split(text: str) -> list[tuple[int, int]]:
    """Spans of the statements of a text; semicolons in strings and comments do not count.  What
    cannot be read as tokens is one statement up to the end."""
    spans, start, at = [], 0, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        at = m.end() if m else len(text)
        if m and m[0] == ";":
            spans.append((start, m.start()))
            start = m.end()
    spans.append((start, len(text)))
    return [(a, b) for a, b in spans if re.sub(r"--[^\n]*|/\*.*?\*/", "", text[a:b], flags=re.DOTALL).strip()]


def names(text: str) -> set[str]:
    """Every name of a text that may be a table's, qualified or not, in compared form: the longest runs of names
    joined by dots, read from the tokens as the parser does."""
    out, parts, dot, at = set(), [], False, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, value, at = (m.lastgroup, m[0], m.end()) if m else ("", "", at + 1)
        if kind == "space":
            continue
        if kind in ("word", "quoted"):
            if not dot and parts:
                out.add(".".join(parts))
                parts = []
            parts.append(value.lower() if kind == "word" else value[1:-1].replace("``", "`").lower())
            dot = False
        elif value == "." and parts and not dot:
            dot = True
        else:
            if parts:
                out.add(".".join(parts))
            parts, dot = [], False
    if parts:
        out.add(".".join(parts))
    return out | {py_table_name(t) for t in out}


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, lex(text), 0
        self.words = [value.lower() if kind == "word" else value if kind == "op" else "" for kind, value, _, _ in self.tokens] + [""] * 4

    # -- tokens --
    def peek(self, k: int = 0) -> str:
        """The k-th token ahead: operators as they are, bare words in lower case, else ''."""
        return self.words[self.i + k]

    def here(self) -> int:
        return self.tokens[self.i][2]

    def back(self) -> int:
        return self.tokens[self.i - 1][3]

    def take(self, *words: str) -> bool:
        if self.words[self.i] != words[0]:
            return False
        if len(words) > 1 and any(self.words[self.i + k] != w for k, w in enumerate(words)):
            return False
        self.i += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.take(*words):
            kind, value, at, _ = self.tokens[self.i]
            raise SqlError(f"expected {' '.join(words)} at {at}, found {value or 'the end'!r}")

    def name(self) -> str:
        kind, value, at, _ = self.tokens[self.i]
        if kind == "word":
            self.i += 1
            return value.lower()
        if kind == "quoted":
            self.i += 1
            return value[1:-1].replace("``", "`").lower()
        raise SqlError(f"expected a name at {at}, found {value or 'the end'!r}")

    def is_name(self, k: int = 0) -> bool:
        kind, value, _, _ = self.tokens[min(self.i + k, len(self.tokens) - 1)]
        return kind == "quoted" or kind == "word" and value.lower() not in _STOP

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    def dotted(self) -> list[str]:
        parts = [self.name()]
        while self.peek() == "." and self.tokens[self.i + 1][0] in ("word", "quoted"):
            self.i += 1
            parts.append(self.name())
        return parts

    def done(self, node: Node) -> Node:
        node.end = self.back()
        return node

    # -- statements --
    def statement(self) -> list[Node]:
        """The write statements of one text: none for other kinds, several for a multi-insert."""
        ctes = self.ctes() if self.peek() == "with" else []
        word = self.peek()
        if word == "merge":
            out = [self.merge()]
        elif word == "insert":
            out = [self.insert(ctes, None)]
        elif word == "from":
            self.i += 1
            source = self.relations()
            out = []
            while self.peek() == "insert":
                out.append(self.insert(ctes, source))
        elif word in ("select", "(", "values", "create", "update", "delete", "drop", "alter", "set", "use", "cache", "truncate", "explain", "show", "describe", "refresh", "msck", "analyze", "add"):
            return []
        else:
            raise SqlError(f"unknown statement at {self.here()}: {self.tokens[self.i][1]!r}")
        if self.tokens[self.i][0] != "end":
            raise SqlError(f"unexpected {self.tokens[self.i][1]!r} at {self.here()}")
        return out

    def insert(self, ctes: list, source) -> Node:
        n = Node("insert", self.here(), overwrite=False, partition=[], columns=[], ctes=ctes)
        self.need("insert")
        n.overwrite = self.take("overwrite")
        if not n.overwrite:
            self.need("into")
        self.take("table")
        n.target = ".".join(self.dotted())
        if self.take("partition"):
            self.need("(")
            while True:
                key = self.name()
                value = self.expr() if self.take("=") else None
                n.partition.append((key, self.text[value.start : value.end] if value else None))
                if not self.take(","):
                    break
            self.need(")")
        if self.take("if"):
            self.need("not", "exists")
        if self.peek() == "(" and self.peek(1) not in ("select", "with", "(", "values", "from"):
            n.columns = self.names()
        if source is not None:
            n.query = Node("query", self.here(), ctes=[], order=[], limit=None)
            n.query.body = self.select(source)
            self.tail(n.query)
            self.done(n.query)
        else:
            n.query = self.query()
        return self.done(n)

    def merge(self) -> Node:
        n = Node("merge", self.here(), actions=[], target_alias=None)
        self.need("merge", "into")
        n.target = ".".join(self.dotted())
        self.take("as")
        if self.is_name():
            n.target_alias = self.name()
        self.need("using")
        n.using = self.relation()
        self.need("on")
        n.on = self.expr()
        while self.take("when"):
            negated = self.take("not")
            self.need("matched")
            by_source = self.take("by", "source")
            self.take("by", "target")
            branch = "matched" if not negated or by_source else "not_matched"
            condition = self.expr() if self.take("and") else None
            self.need("then")
            a = Node("action", self.here(), branch=branch, condition=condition, what="", pairs=[])
            if self.take("delete"):
                a.what = "delete"
            elif self.take("update"):
                self.need("set")
                a.what = "update"
                if self.take("*"):
                    a.what = "update_star"
                else:
                    while True:
                        column = self.dotted()[-1]
                        self.need("=")
                        a.pairs.append((column, self.expr()))
                        if not self.take(","):
                            break
            else:
                self.need("insert")
                a.what = "insert"
                if self.take("*"):
                    a.what = "insert_star"
                else:
                    columns = []
                    self.need("(")
                    while True:
                        columns.append(self.dotted()[-1])
                        if not self.take(","):
                            break
                    self.need(")")
                    self.need("values", "(")
                    values = [self.expr()]
                    while self.take(","):
                        values.append(self.expr())
                    self.need(")")
                    if len(columns) != len(values):
                        raise SqlError(f"{len(columns)} columns and {len(values)} values at {a.start}")
                    a.pairs = list(zip(columns, values, strict=True))
            n.actions.append(self.done(a))
        return self.done(n)

    # -- queries --
    def ctes(self) -> list[tuple[str, Node, list[str]]]:
        self.need("with")
        self.take("recursive")
        out = []
        while True:
            name = self.name()
            columns = self.names() if self.peek() == "(" else []
            self.take("as")
            self.need("(")
            out.append((name, self.query(), columns))
            self.need(")")
            if not self.take(","):
                return out

    def query(self) -> Node:
        q = Node("query", self.here(), ctes=[], order=[], limit=None)
        if self.peek() == "with":
            q.ctes = self.ctes()
        q.body = self.set_expr(0)
        self.tail(q)
        return self.done(q)

    def tail(self, q: Node) -> None:
        while True:
            if self.take("order", "by"):
                q.order = self.order_items()
            elif self.take("limit"):
                e = self.expr()
                q.limit = self.text[e.start : e.end]
            elif self.take("offset"):
                self.expr()
            elif self.take("sort", "by") or self.take("distribute", "by") or self.take("cluster", "by"):
                self.order_items()
            else:
                return

    def set_expr(self, least: int) -> Node:
        """UNION, EXCEPT and MINUS bind alike, INTERSECT tighter."""
        start = self.here()
        left = self.set_term()
        while True:
            word = self.peek()
            power = {"union": 1, "except": 1, "minus": 1, "intersect": 2}.get(word, 0)
            if power <= least:
                return left
            self.i += 1
            every = self.take("all")
            self.take("distinct")
            right = self.set_expr(power)
            left = Node("setop", start, self.back(), op="except" if word == "minus" else word, all=every, left=left, right=right)

    def set_term(self) -> Node:
        if self.peek() == "(":
            self.i += 1
            q = self.query()
            self.need(")")
            return q if q.ctes or q.order or q.limit else q.body
        if self.peek() == "values":
            return self.values()
        if self.peek() == "with":
            return self.query()
        if self.peek() == "from":
            self.i += 1
            return self.select(self.relations())
        return self.select(None)

    def values(self) -> Node:
        n = Node("values", self.here(), rows=[])
        self.need("values")
        while True:
            if self.take("("):
                row = [self.expr()]
                while self.take(","):
                    row.append(self.expr())
                self.need(")")
            else:
                row = [self.expr()]
            n.rows.append(row)
            if not self.take(","):
                return self.done(n)

    def select(self, source) -> Node:
        s = Node("select", self.here(), items=[], distinct=False, relations=source, laterals=[], where=None, group=[], grouping="", having=None, windows={}, qualify=None)
        self.need("select")
        s.distinct = self.take("distinct")
        self.take("all")
        while True:
            s.items.append(self.item())
            if not self.take(","):
                break
        if source is None and self.take("from"):
            s.relations = self.relations()
        while self.peek() == "lateral" and self.peek(1) == "view":
            s.laterals.append(self.lateral_view())
        if self.take("where"):
            s.where = self.expr()
        if self.take("group", "by"):
            self.grouping(s)
        if self.take("having"):
            s.having = self.expr()
        if self.take("qualify"):
            s.qualify = self.expr()
        if self.take("window"):
            while True:
                name = self.name()
                self.need("as")
                s.windows[name] = self.window()
                if not self.take(","):
                    break
        return self.done(s)

    def grouping(self, s: Node) -> None:
        for word in ("rollup", "cube"):
            if self.peek() == word and self.peek(1) == "(":
                self.i += 2
                s.grouping = word
                s.group = self.expr_list(")")
                return
        if self.take("all"):
            s.grouping = "all"
            return
        if self.take("grouping", "sets"):
            s.grouping = "grouping sets"
            self.need("(")
            s.group = self.expr_list(")")
            return
        s.group = [self.expr()]
        while self.take(","):
            s.group.append(self.expr())
        if self.take("with", "rollup"):
            s.grouping = "rollup"
        elif self.take("with", "cube"):
            s.grouping = "cube"
        elif self.take("grouping", "sets"):
            s.grouping = "grouping sets"
            self.need("(")
            self.expr_list(")")

    def item(self) -> Node:
        start = self.here()
        e = self.expr()
        n = Node("item", start, expr=e, alias=None, aliases=[])
        if self.take("as"):
            if self.peek() == "(":
                n.aliases = self.names()
            else:
                n.alias = self.name() if self.tokens[self.i][0] != "string" else self.string_name()
        elif self.is_name():
            n.alias = self.name()
        return self.done(n)

    def string_name(self) -> str:
        value = self.tokens[self.i][1]
        self.i += 1
        return value[1:-1].lower()

    def relations(self) -> list[Node]:
        out = [self.joined()]
        while self.take(","):
            out.append(self.joined())
        return out

    def joined(self) -> Node:
        """A relation with its joins: kids[0] is the first, `joins` the rest."""
        n = Node("joined", self.here(), kids=[self.relation()], joins=[])
        while True:
            while self.peek() == "lateral" and self.peek(1) == "view":
                n.joins.append(Node("join", self.here(), how="LATERAL", right=self.lateral_view(), on=None, using=[]))
            start, how = self.here(), "INNER"
            natural = self.take("natural")
            if self.take("cross"):
                how = "CROSS"
            elif self.take("inner"):
                pass
            elif self.peek() in ("left", "right", "full", "semi", "anti") and self.peek(1) in ("join", "outer", "semi", "anti"):
                side = self.peek()
                self.i += 1
                if side in ("semi", "anti"):
                    how = f"LEFT_{side.upper()}"
                else:
                    kind = self.peek() if self.peek() in ("semi", "anti") else "outer"
                    self.i += self.peek() in ("semi", "anti", "outer")
                    how = f"{side}_{kind}".upper()
            elif self.peek() != "join":
                if natural:
                    raise SqlError(f"expected join at {self.here()}")
                return self.done(n)
            self.need("join")
            j = Node("join", start, how=how, right=self.relation(), on=None, using=[])
            if self.take("on"):
                j.on = self.expr()
            elif self.take("using"):
                j.using = self.names()
            n.joins.append(self.done(j))

    def relation(self) -> Node:
        n = Node("relation", self.here(), what="", alias=None, columns=[])
        lateral = self.take("lateral")
        if self.take("("):
            if self.peek() in ("select", "with", "values", "(", "from"):
                n.what, n.query = "query", self.query()
                if self.peek() != ")":  # a parenthesised join that starts with a subquery
                    raise SqlError(f"unexpected {self.tokens[self.i][1]!r} at {self.here()}")
            else:
                n.what, n.inner = "group", self.relations()
            self.need(")")
        elif self.peek() == "values":
            n.what, n.values = "values", self.values()
        else:
            if not self.is_name() and self.peek() in _STOP:
                raise SqlError(f"expected a relation at {self.here()}, found {self.peek()!r}")
            parts = self.dotted()
            if self.peek() == "(":
                self.i += 1
                n.what, n.function, n.args = "function", ".".join(parts), self.expr_list(")")
            else:
                n.what, n.name, n.parts = "table", ".".join(parts), parts
        if self.take("tablesample"):
            self.need("(")
            depth = 1
            while depth:
                depth += (self.peek() == "(") - (self.peek() == ")")
                if self.tokens[self.i][0] == "end":
                    raise SqlError("unclosed tablesample")
                self.i += 1
        n.lateral = lateral
        if self.take("as") or self.is_name():
            n.alias = self.name()
            if self.peek() == "(":
                n.columns = self.names()
        return self.done(n)

    def lateral_view(self) -> Node:
        n = Node("view", self.here(), columns=[], alias=None)
        self.need("lateral", "view")
        n.outer = self.take("outer")
        n.expr = self.expr()
        if self.is_name():
            n.alias = self.name()
        if self.take("as"):
            n.columns = [self.name()]
            while self.take(","):
                n.columns.append(self.name())
        return self.done(n)

    def order_items(self) -> list[tuple[Node, str]]:
        out = []
        while True:
            e = self.expr()
            way = "DESC" if self.take("desc") else "ASC"
            self.take("asc")
            if self.take("nulls"):
                self.i += 1
            out.append((e, way))
            if not self.take(","):
                return out

    # -- expressions --
    def expr_list(self, close: str) -> list[Node]:
        if self.take(close):
            return []
        out = [self.expr()]
        while self.take(","):
            out.append(self.expr())
        self.need(close)
        return out

    def expr(self, least: int = 0) -> Node:
        start = self.here()
        if self.take("not") or (self.peek() == "!" and self.take("!")):
            left = Node("not", start, kids=[self.expr(3)])
            self.done(left)
        else:
            left = self.unary()
        while True:
            word = self.peek()
            power = _BINDING.get(word, 0)
            if power and power > least:
                self.i += 1
                left = self.done(Node("binary", start, op=word, kids=[left, self.expr(power)]))
                continue
            if least >= 4:
                return left
            negated = word == "not" and self.peek(1) in ("in", "between", "like", "rlike", "regexp", "ilike")
            if negated:
                self.i += 1
                word = self.peek()
            if word == "is":
                self.i += 1
                negated = self.take("not")
                if self.take("distinct", "from"):
                    left = self.done(Node("binary", start, op="<=>", kids=[left, self.expr(4)]))
                else:
                    value = self.name()
                    left = self.done(Node("is", start, value=value, negated=negated, kids=[left]))
            elif word == "in":
                self.i += 1
                self.need("(")
                if self.peek() in ("select", "with"):
                    q = self.query()
                    self.need(")")
                    left = self.done(Node("in_query", start, negated=negated, query=q, kids=[left]))
                else:
                    left = self.done(Node("in", start, negated=negated, kids=[left, *self.expr_list(")")]))
            elif word == "between":
                self.i += 1
                low = self.expr(4)
                self.need("and")
                left = self.done(Node("between", start, negated=negated, kids=[left, low, self.expr(4)]))
            elif word in ("like", "rlike", "regexp", "ilike"):
                self.i += 1
                self.take("any") or self.take("all")
                left = self.done(Node("like", start, op=word, negated=negated, kids=[left, self.expr(4)]))
                if self.take("escape"):
                    self.i += 1
                    self.done(left)
            else:
                return left

    def unary(self) -> Node:
        start = self.here()
        for op in ("-", "+", "~"):
            if self.take(op):
                return self.done(Node("unary", start, op=op, kids=[self.expr(9)]))
        return self.postfix(self.primary())

    def postfix(self, e: Node) -> Node:
        while True:
            if self.peek() == "[":
                self.i += 1
                at = self.expr()
                self.need("]")
                e = self.done(Node("item_of", e.start, kids=[e, at]))
            elif self.peek() == "." and self.tokens[self.i + 1][0] in ("word", "quoted") and e.kind != "column":
                self.i += 1
                self.name()
                e = self.done(Node("field_of", e.start, kids=[e]))
            elif self.take("::"):
                e = self.done(Node("cast", e.start, type=self.type_text(), kids=[e]))
            else:
                return e

    def type_text(self) -> str:
        start, depth = self.here(), 0
        self.name()
        while self.peek() in ("(", "<") or depth:
            word = self.peek()
            if self.tokens[self.i][0] == "end":
                raise SqlError("unclosed type")
            depth += (word in ("(", "<")) - (word in (")", ">")) - 2 * (word == ">>")
            self.i += 1
        return self.text[start : self.back()]

    def primary(self) -> Node:
        kind, value, start, end = self.tokens[self.i]
        word = self.peek()
        if kind == "string":
            self.i += 1
            while self.tokens[self.i][0] == "string":
                self.i += 1
            return self.done(Node("literal", start, type="string", text=self.text[start : self.back()]))
        if kind == "number":
            self.i += 1
            return Node("literal", start, end, type="number", text=value)
        if word == "(":
            self.i += 1
            if self.peek() in ("select", "with", "values"):
                q = self.query()
                self.need(")")
                return self.done(Node("scalar", start, query=q))
            inner = [self.expr()]
            while self.take(","):
                inner.append(self.expr())
            self.need(")")
            if self.peek() == "->":
                return self.lambda_(start, [k.parts[0] for k in inner if k.kind == "column"])
            return self.done(Node("group" if len(inner) == 1 else "tuple", start, kids=inner))
        if word == "*":
            self.i += 1
            return self.star(start, None)
        if word == "case":
            return self.case()
        if word == "cast" or word == "try_cast":
            if self.peek(1) == "(":
                self.i += 2
                e = self.expr()
                self.need("as")
                n = Node("cast", start, type=self.type_text(), kids=[e])
                self.need(")")
                return self.done(n)
        if word == "exists" and self.peek(1) == "(" and self.peek(2) in ("select", "with"):
            self.i += 2
            q = self.query()
            self.need(")")
            return self.done(Node("exists", start, query=q))
        if word in ("null", "true", "false") and self.peek(1) != "(":
            self.i += 1
            return Node("literal", start, end, type="null" if word == "null" else "boolean", text=value)
        if word == "interval" and self.tokens[self.i + 1][0] in ("number", "string", "op"):
            self.i += 1
            self.take("-")
            self.i += 1
            while self.peek() in ("year", "years", "month", "months", "week", "weeks", "day", "days", "hour", "hours", "minute", "minutes", "second", "seconds", "to"):
                self.i += 1
                if self.tokens[self.i][0] in ("number", "string"):
                    self.i += 1
            return self.done(Node("literal", start, type="interval", text=self.text[start : self.back()]))
        if word in ("date", "timestamp") and self.tokens[self.i + 1][0] == "string":
            self.i += 2
            return self.done(Node("literal", start, type="string", text=self.text[start : self.back()]))
        if kind in ("word", "quoted"):
            if kind == "word" and word in _STOP and self.peek(1) not in ("(", "."):
                raise SqlError(f"unexpected {value!r} at {start}")
            parts = [self.name()]
            if self.peek() == "->":
                return self.lambda_(start, parts)
            while self.peek() == ".":
                if self.peek(1) == "*":
                    self.i += 2
                    return self.star(start, ".".join(parts))
                self.i += 1
                parts.append(self.name())
            if self.peek() == "(":
                return self.function(start, parts)
            return self.done(Node("column", start, parts=parts))
        raise SqlError(f"unexpected {value or 'the end'!r} at {start}")

    def star(self, start: int, of: str | None) -> Node:
        n = Node("star", start, of=of, without=[])
        if self.peek() == "except" and self.peek(1) == "(" and self.peek(2) not in ("select", "with", "("):
            self.i += 1
            n.without = self.names()
        return self.done(n)

    def lambda_(self, start: int, names: list[str]) -> Node:
        self.need("->")
        return self.done(Node("lambda", start, names=names, kids=[self.expr()]))

    def case(self) -> Node:
        n = Node("case", self.here(), operand=None, branches=[], otherwise=None)
        self.need("case")
        if self.peek() != "when":
            n.operand = self.expr()
        while self.take("when"):
            when = self.expr()
            self.need("then")
            n.branches.append((when, self.expr()))
        if self.take("else"):
            n.otherwise = self.expr()
        self.need("end")
        n.kids = [*([n.operand] if n.operand else []), *(x for b in n.branches for x in b), *([n.otherwise] if n.otherwise else [])]
        return self.done(n)

    def function(self, start: int, parts: list[str]) -> Node:
        n = Node("function", start, name=".".join(parts), distinct=False, over=None, condition=None)
        self.need("(")
        n.distinct = self.take("distinct")
        self.take("all")
        if n.name == "extract" or n.name in ("trim", "position", "overlay", "substring", "substr"):
            n.kids = self.keyword_args()
        else:
            n.kids = self.arguments()
        if self.take("within", "group"):
            self.need("(", "order", "by")
            n.kids = [*n.kids, *(e for e, _ in self.order_items())]
            self.need(")")
        if self.take("filter"):
            self.need("(", "where")
            n.condition = self.expr()
            self.need(")")
            n.kids = [*n.kids, n.condition]
        if self.peek() in ("ignore", "respect") and self.peek(1) == "nulls":
            self.i += 2
        self.done(n)
        if self.take("over"):
            w = Node("window", start, call=n, named=None)
            if self.peek() == "(":
                w.spec = self.window()
            else:
                w.named, w.spec = self.name(), None
            return self.done(w)
        return n

    def arguments(self) -> list[Node]:
        if self.take(")"):
            return []
        out = []
        while True:
            if self.is_name() and self.peek(1) == "=>":
                self.i += 2
            out.append(self.expr())
            if self.peek() in ("ignore", "respect") and self.peek(1) == "nulls":
                self.i += 2
            if not self.take(","):
                break
        self.need(")")
        return out

    def keyword_args(self) -> list[Node]:
        """Arguments with words between them, as in extract(year from x)."""
        out = []
        while not self.take(")"):
            if self.take(",") or self.take("from") or self.take("for") or self.take("in") or self.take("placing"):
                continue
            if self.peek() in ("both", "leading", "trailing") or self.peek(1) == "from" and self.is_name():
                self.i += 1
                continue
            out.append(self.expr(4))
        return out

    def window(self) -> Node:
        w = Node("spec", self.here(), partition=[], order=[], frame="")
        self.need("(")
        if self.take("partition", "by") or self.take("distribute", "by"):
            w.partition = [self.expr()]
            while self.take(","):
                w.partition.append(self.expr())
        if self.take("order", "by") or self.take("sort", "by"):
            w.order = self.order_items()
        start, depth = self.here(), 1
        while True:
            word = self.peek()
            if self.tokens[self.i][0] == "end":
                raise SqlError("unclosed window")
            depth += (word == "(") - (word == ")")
            self.i += 1
            if not depth:
                break
        w.frame = self.text[start : self.tokens[self.i - 1][2]].strip()
        return self.done(w)


def parse(text: str) -> list[Node]:
    """The write statements of one statement text."""
    try:
        return Parser(text).statement()
    except RecursionError:
        raise SqlError("nested too deeply") from None
