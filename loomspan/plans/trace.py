"""Walks from columns to the physical columns they come from, within one statement."""

from __future__ import annotations

import heapq

# The order in which the strongest transform along a path counts.
ORDER = ("CONSTANT", "DIRECT", "EXPAND_ALL", "UNION", "EXPRESSION", "CONDITIONAL", "WINDOW", "AGGREGATE")
RANK = {t: i for i, t in enumerate(ORDER)}
LEAVES = ("CONSTANT", "SYSTEM", "UNKNOWN")


def end_to_end(columns: list[tuple], scopes: set[str], roots: list[tuple] | None = None) -> list[dict]:
    """`columns` are (scope, name, transform, merge_branch, [(scope, column), ...]).  For each column
    of ROOT, or each (scope, name, merge_branch) of `roots`: its physical sources with the strongest
    transform on the way there, whether the walk met everything, and if not, why."""
    table: dict[tuple, list] = {}
    stars: dict[str, list] = {}
    for scope, name, transform, branch, sources in columns:
        table.setdefault((scope, name), []).append((transform, branch, sources))
        if transform == "EXPAND_ALL":
            stars.setdefault(scope, []).extend(sources)
    out = []
    for scope, name, branch in roots or [(c[0], c[1], c[3]) for c in columns if c[0] == "ROOT"]:
        found: dict[tuple, None] = {}
        reasons: dict[str, None] = {}

        def step(at: str, column: str, rank: int, first: bool, branch=branch, found=found, reasons=reasons) -> list[tuple] | None:
            """What a column leads to, or None where the walk ends."""
            if at in LEAVES:
                if at == "UNKNOWN":
                    reasons.setdefault("unknown_source")
                return None
            if at not in scopes:
                found.setdefault((at, column, ORDER[rank]))
                return None
            own = table.get((at, column))
            if own is None:
                if column == "*" or column.endswith(".*") or at in stars:
                    reasons.setdefault("star_not_expanded")
                    return [(s, c, max(rank, RANK["EXPAND_ALL"])) for s, c in stars.get(at, [])]
                reasons.setdefault("missing_scope_column")
                return None
            if any(t == "EXPAND_ALL" and not (first and b != branch) for t, b, _ in own):
                reasons.setdefault("star_not_expanded")
            return [(s, c, max(rank, RANK.get(t, 0))) for t, b, sources in own if not (first and b != branch) for s, c in sources]

        _descend((scope, name, 0), step, lambda reasons=reasons: reasons.setdefault("cycle_detected"))
        out.append({"scope_id": scope, "name": name, "merge_branch": branch, "sources": [{"scope": s, "column": c, "transform": t} for s, c, t in found], "complete": not reasons, "reasons": list(reasons)})
    return out


def _descend(start: tuple[str, str, int], step, on_cycle) -> None:
    """Depth first, sources in order.  A state is a column with the strongest transform so far and is
    opened once; a column met again on the way down to itself is a cycle.  Each column of the way is
    marked when it is entered and unmarked when it is left, so nothing is copied."""
    stack: list[tuple] = [(*start, False)]
    way: dict[tuple, int] = {}
    done: set[tuple] = set()
    while stack:
        at, column, rank, leave = stack.pop()
        here = (at, column)
        if leave:
            way[here] -= 1
            continue
        if way.get(here):
            on_cycle()
            continue
        if (at, column, rank) in done:
            continue
        below = step(at, column, rank, len(done) == 0)
        if below is None:
            continue
        done.add((at, column, rank))
        way[here] = way.get(here, 0) + 1
        stack.append((at, column, rank, True))
        stack += [(*x, False) for x in reversed(below)]


def to_physical(columns: list[tuple], scopes: set[str], scope: str, name: str) -> list[tuple[str, str, str]]:
    return Leaves(columns, scopes).of(scope, name)


class Leaves:
    """Leaves of one column as (scope, column, transform), constants and system values kept; a
    wildcard passes the requested name on, and a request for `*` opens every named column.  Each leaf
    comes once for each transform it is reached by."""

    def __init__(self, columns: list[tuple], scopes: set[str]):
        self.scopes = scopes
        self.table: dict[tuple, list] = {}
        self.by_scope: dict[str, list[tuple]] = {}
        self.over: dict[str, dict[str, None]] = {}
        self.known: dict[tuple, list] = {}
        for at, column, transform, _, sources in columns:
            self.table.setdefault((at, column), []).append((transform, sources))
            self.by_scope.setdefault(at, []).append((transform, sources))
            self.over.setdefault(at, {}).update(dict.fromkeys(s for s, _ in sources))

    def of(self, scope: str, name: str) -> list[tuple[str, str, str]]:
        if (scope, name) in self.known:
            return self.known[scope, name]
        out: dict[tuple[str, str, str], None] = {}

        def step(at: str, column: str, rank: int, first: bool) -> list[tuple] | None:
            if at in LEAVES or at not in self.scopes:
                if at != "UNKNOWN":
                    out.setdefault((at, column, ORDER[rank]))
                return None
            every = self.by_scope.get(at, [])
            if column == "*":
                named = [sources for t, sources in every if t != "EXPAND_ALL"]
                return [(s, c, rank) for sources in named or [sources for _, sources in every] for s, c in sources]
            if (at, column) in self.table:
                return [(s, c, max(rank, RANK.get(t, 0))) for t, sources in self.table[at, column] for s, c in sources]
            wild = [x for t, sources in every if t == "EXPAND_ALL" for x in sources]
            if wild:
                return [(s, column if c == "*" else c, max(rank, RANK["EXPAND_ALL"])) for s, c in wild]
            if at != "ROOT" and len(self.over.get(at, {})) == 1:
                return [(next(iter(self.over[at])), column, rank)]
            return None

        _descend((scope, name, 0), step, lambda: None)
        self.known[scope, name] = list(out)
        return self.known[scope, name]


def upstream(columns: list[tuple], scopes: set[str], scope: str, name: str) -> dict:
    """Breadth first: the physical columns met, the links walked and how many columns were visited."""
    table: dict[tuple, list] = {}
    for at, column, _, _, sources in columns:
        table.setdefault((at, column), []).extend(sources)
    seen, queue, links, physical = {(scope, name)}, [(scope, name)], [], {}
    for at in queue:
        for source in table.get(at, []):
            links.append((source, at))
            if source[0] not in scopes and source[0] not in LEAVES:
                physical.setdefault(source)
            if source not in seen:
                seen.add(source)
                queue.append(source)
    return {"target": (scope, name), "physical": list(physical), "links": links, "path_length": len(seen)}


def ordered(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Nodes so that each comes after all that feed it, of those free at once the smallest by text first;
    nodes on cycles, or fed by one, come last in order of text."""
    feeds: dict[str, set[str]] = {n: set() for n in nodes}
    open_ = {n: 0 for n in nodes}
    for a, b in edges:
        if a in feeds and b in feeds and b not in feeds[a] and a != b:
            feeds[a].add(b)
            open_[b] += 1
    free = [n for n in nodes if not open_[n]]
    heapq.heapify(free)
    out = []
    while free:
        out.append(n := heapq.heappop(free))
        for b in feeds[n]:
            open_[b] -= 1
            if not open_[b]:
                heapq.heappush(free, b)
    return out + sorted(n for n in nodes if open_[n] > 0)


def feeding_tables(depends: dict[str, list[str]], scope: str) -> list[str]:
    """The tables that feed a scope, directly or through other scopes; cycles end where they close."""
    seen, todo, out = {scope}, [scope], set()
    while todo:
        for d in depends.get(todo.pop(), []):
            if d not in depends:
                out.add(d)
            elif d not in seen:
                seen.add(d)
                todo.append(d)
    return sorted(out)


def physical_refs(leaves: Leaves, refs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The physical columns that references of a scope stand for, in order and once each."""
    return list(dict.fromkeys((s, c) for scope, column in refs for s, c, _ in leaves.of(scope, column) if s not in LEAVES))
