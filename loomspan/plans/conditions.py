"""What a condition says, read from its parse tree: how its parts are joined, the operators it uses,
the columns it holds equal, and the kind of filter it is."""

from __future__ import annotations

from loomspan.plans.sqlparse import COMPARISONS, Node, Parser, SqlError

# Functions whose value comes from the run itself.
RUNTIME = frozenset("current_date current_timestamp current_time now rand random uuid unix_timestamp localtimestamp current_user".split())
#: Columns that mark a partition, and a row that was deleted.
PARTITION, DELETED = frozenset(("dt",)), frozenset(("deleted", "is_deleted"))
#: Functions told beside the operators.
TOLD = frozenset(("datediff", "substring", "coalesce"))


def expression(text: str | None) -> Node | None:
    """The tree of an expression's text, or None if it is no whole expression."""
    if not text or not text.strip():
        return None
    try:
        p = Parser(text)
        e = p.expr()
    except (SqlError, RecursionError):
        return None
    return e if p.tokens[p.i][0] == "end" else None


def bare(e: Node) -> Node:
    while e.kind == "group":
        e = e.kids[0]
    return e


def parts(e: Node) -> tuple[set[str], list[Node]]:
    """The connectives of a condition and the predicates they join."""
    words: set[str] = set()
    leaves: list[Node] = []
    stack = [e]
    while stack:
        x = bare(stack.pop())
        if x.kind == "binary" and x.op in ("and", "or"):
            words.add(x.op)
            stack += reversed(x.kids)
        elif x.kind == "unary" and x.op == "not" or x.kind == "not":
            stack += x.kids
        else:
            leaves.append(x)
    return words, leaves


def shape(e: Node) -> str:
    words = parts(e)[0]
    return {frozenset(): "SINGLE_CONDITION", frozenset(("and",)): "AND_GROUP", frozenset(("or",)): "OR_GROUP"}.get(frozenset(words), "MIXED_AND_OR")


def below(e: Node):
    stack = [e]
    while stack:
        x = stack.pop()
        yield x
        stack += reversed(x.kids)


def _named(x: Node) -> str | None:
    yes = {"in": "IN", "in_query": "IN", "between": "BETWEEN", "like": "LIKE"}
    if x.kind in yes:
        return ("NOT_" if x.negated else "") + yes[x.kind]
    if x.kind == "is":
        return f"IS_NOT_{x.value.upper()}" if x.negated else f"IS_{x.value.upper()}"
    if x.kind == "binary" and x.op in COMPARISONS:
        return {"==": "=", "!=": "<>"}.get(x.op, x.op)
    if x.kind == "function" and x.name in TOLD:
        return x.name.upper()
    if x.kind == "exists":
        return "EXISTS"
    return None


def operators(e: Node) -> list[str]:
    """Each operator once, in the order met."""
    return list(dict.fromkeys(n for x in below(e) if (n := _named(x))))


def equalities(e: Node) -> list[tuple[Node, Node]]:
    """Pairs of columns held equal by a predicate that must hold: one joined to the others by AND only."""
    words, leaves = parts(e)
    if "or" in words:
        # Only what stands outside every OR must hold.
        leaves, stack = [], [e]
        while stack:
            x = bare(stack.pop())
            if x.kind == "binary" and x.op == "and":
                stack += reversed(x.kids)
            else:
                leaves.append(x)
    sides = [(bare(x.kids[0]), bare(x.kids[1])) for x in leaves if x.kind == "binary" and x.op in ("=", "==", "<=>")]
    return [(a, b) for a, b in sides if a.kind == b.kind == "column"]


def filter_kind(e: Node) -> str:
    """Whether it picks partitions or leaves out deleted rows, by the columns its predicates compare."""
    compared: set[str] = set()
    told: set[str] = set()
    for x in parts(e)[1]:
        names = {y.parts[-1] for y in below(x) if y.kind == "column"}
        told |= names
        if x.kind in ("in", "between") or x.kind == "binary" and x.op in ("=", "==", ">=", "<=", ">", "<"):
            compared |= names
    return "partition_filter" if compared & PARTITION else "soft_delete_filter" if told & DELETED else "other_filter"


def is_constant(e: Node | None) -> bool:
    """A literal, a signed literal, or a function of the run without arguments."""
    if e is None:
        return False
    e = bare(e)
    if e.kind == "unary":
        e = bare(e.kids[0])
    return e.kind == "literal" or e.kind == "function" and e.name in RUNTIME and not e.kids or e.kind == "column" and len(e.parts) == 1 and e.parts[0] in RUNTIME


def told(e: Node | None) -> dict:
    """The facts of a condition; of a text that could not be read they are empty."""
    if e is None:
        return {"shape": None, "filter_kind": None, "operators": []}
    return {"shape": shape(e), "filter_kind": filter_kind(e), "operators": operators(e)}
