"""Problem 2: parent-child links into full hierarchies.

For every node of every tree: root, path from the root, depth, the list of all its descendants and
the size of its subtree; nodes on a cycle, or whose way up leads into one, are reported with root ''
and depth -1.

Bottom-up leaf peeling: every round takes the nodes no unpeeled node hangs under, and sends their
descendant lists and subtree sizes to their parents.  What no round takes lies on a
cycle or above one.  The reverse of the peel order then gives roots, depths and paths from the
parents down; what hangs under a cycle is never reached that way and is reported with it.  All the
descendant lists of a tree are segments of one array of its nodes, so a list is sent to a parent by
giving it its place there, whatever its length, and lists are copied out only where they are asked for.

A tree never leaves its group (statement), so groups are packed by hash into buckets of bounded size
and each bucket is peeled in one task, all its trees at once, with numpy.  A group with more than
GROUP_LINKS links (it may hold a third of all rows) is first peeled by rounds on DataFrames, spread
by node: a round takes leaves, and takes nodes out of chains (a chain of a million links would else
need a million rounds), which leaves at most about three quarters of the nodes.  When a group fits a task,
the rest of it is peeled there, and the nodes taken out are placed in reverse order, a join a round.

Defined results: a link without child (null) gives no node for that end; a null parent makes the
child a node without parent.  Repeated links count once.  Should a node have several parents, the
smallest by text is its parent on the path, and it counts as leading into a cycle if any of them
does.  Text is compared as written; '' is a node like any other.  Rows with null group form the group
null.  Empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import broadcast_if_small, buckets_for, stored

#: Links of a group that one task may hold; larger groups go the distributed way.
GROUP_LINKS = 200_000
#: Links packed into a bucket.
BUCKET_LINKS = 100_000

_COLUMNS = "node string, parent string, root string, depth int, n_descendants bigint"


def hierarchy(links: DataFrame, keys: list[str], lists: bool = False, group_links: int = GROUP_LINKS) -> DataFrame:
    """`links` has the group's `keys` and the strings child and parent.  Gives the keys, node, parent,
    root, depth and n_descendants; with `lists` also path and descendants (arrays; empty on a cycle).
    The output of `lists` has as many entries as the nodes have ancestors, which is what was asked."""
    links = links.select(*keys, "child", "parent")
    large, n, widest = _sizes(links, keys, group_links)
    if widest <= group_links:
        return _packed(links, keys, lists, n)
    out = _packed(links.join(large, _same(links, large, keys), "left_anti"), keys, lists, n)
    # Repeats may be all that makes a group large.
    rest = stored(links.join(large, _same(links, large, keys), "left_semi").distinct())
    still, n, widest = _sizes(rest, keys, group_links)
    if widest <= group_links:
        return out.unionByName(_packed(rest, keys, lists, n))
    out = out.unionByName(_packed(rest.join(still, _same(rest, still, keys), "left_anti"), keys, lists, n))
    return out.unionByName(_spread(stored(rest.join(still, _same(rest, still, keys), "left_semi")), keys, lists, group_links))


def _sizes(links: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, int, int]:
    """The groups with more than `limit` rows, the rows of all groups and of the largest."""
    sizes = links.groupBy(*keys).count()
    n, widest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    return broadcast_if_small(sizes.where(F.col("count") > limit).drop("count")), n, widest


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> list:
    return [a[k].eqNullSafe(b[k]) for k in keys]


# -- groups that fit a task -------------------------------------------------------------------------


def peel(group: np.ndarray, child: np.ndarray, parent: np.ndarray, lists: bool) -> dict[str, list]:
    """All trees of a bucket at once.  `group` holds integer codes, child and parent object arrays."""
    n = len(group)
    ends = pd.DataFrame({"g": np.r_[group, group], "t": np.r_[child, parent]}).dropna(subset=["t"])
    nodes = ends.drop_duplicates().sort_values(["g", "t"], kind="stable").reset_index(drop=True)
    code = pd.MultiIndex.from_frame(nodes)
    c = code.get_indexer(pd.MultiIndex.from_arrays([group, child])) if n else np.empty(0, int)
    p = code.get_indexer(pd.MultiIndex.from_arrays([group, parent])) if n else np.empty(0, int)
    linked = (c >= 0) & (p >= 0)
    pairs = np.unique(np.stack([c[linked], p[linked]]), axis=1)
    c, p = pairs[0], pairs[1]
    m = len(nodes)
    up = np.full(m, -1)
    first = np.r_[True, c[1:] != c[:-1]] if len(c) else np.empty(0, bool)
    up[c[first]] = p[first]  # nodes are sorted by text, so this is the smallest parent

    def spans(key: np.ndarray, other: np.ndarray):
        """For nodes, the other ends of their links by `key`: (ends, how many each)."""
        by = np.argsort(key, kind="stable")
        start = np.searchsorted(key[by], np.arange(m + 1))

        def of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            counts = start[v + 1] - start[v]
            at = np.repeat(start[v], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            return other[by[at]], counts

        return of

    parents, children = spans(c, p), spans(p, c)
    # Up: waves of nodes that nothing unpeeled hangs under.
    below = np.bincount(p, minlength=m)
    waves: list[np.ndarray] = []
    ready = np.flatnonzero(below == 0)
    while len(ready):
        waves.append(ready)
        to = parents(ready)[0]
        np.subtract.at(below, to, 1)
        ready = np.unique(to[below[to] == 0])
    # What is left lies on a cycle or above one; from the top, what is not on it can still be placed.
    left = np.ones(m, dtype=bool)
    for wave in waves:
        left[wave] = False
    above = np.bincount(c, minlength=m)
    down: list[np.ndarray] = []
    ready = np.flatnonzero(left & (above == 0))
    while len(ready):
        down.append(ready)
        to = children(ready)[0]
        to = to[left[to]]
        np.subtract.at(above, to, 1)
        ready = np.unique(to[above[to] == 0])
    # Down: a node is placed once its parents are, unless one of them leads into a cycle.
    root, depth = np.full(m, -1), np.full(m, -1)
    bad = left.copy()
    for wave in down:
        bad[wave] = False
    for wave in [*down, *waves[::-1]]:
        to, counts = parents(wave)
        np.logical_or.at(bad, np.repeat(wave, counts), bad[to])
        good = wave[~bad[wave]]
        top, rest = good[up[good] < 0], good[up[good] >= 0]
        root[top], depth[top] = top, 0
        root[rest], depth[rest] = root[up[rest]], depth[up[rest]] + 1
    # In peel order, subtree sizes go to the parents.
    size = np.zeros(m, dtype=np.int64)
    placed = ~bad & (up >= 0)
    for wave in [*waves, *down[::-1]]:
        hung = wave[placed[wave]]
        np.add.at(size, up[hung], size[hung] + 1)
    text = nodes["t"].to_numpy(dtype=object)
    none = np.array([None], dtype=object)
    pick = lambda ix: np.where(ix >= 0, text[ix] if m else text, none) if m else text
    out = {"group": nodes["g"].to_numpy(), "node": text, "parent": pick(up), "root": np.where(bad, "", pick(root)), "depth": depth, "n_descendants": np.where(bad, 0, size)}
    # A node's list is the segment after its own place; a parent's segment holds those of its children.
    place = np.full(m, -1)
    good = np.flatnonzero(~bad)
    top = good[up[good] < 0]
    place[top] = np.cumsum(size[top] + 1) - size[top] - 1
    hung = np.flatnonzero(placed)
    hung = hung[np.argsort(up[hung], kind="stable")]
    before = np.zeros(m, dtype=np.int64)
    run = np.cumsum(size[hung] + 1) - size[hung] - 1
    lead = np.r_[True, up[hung][1:] != up[hung][:-1]] if len(hung) else np.empty(0, bool)
    before[hung] = run - np.repeat(run[lead], np.diff(np.r_[np.flatnonzero(lead), len(hung)])) if len(hung) else 0
    for wave in [*down, *waves[::-1]]:
        under = wave[placed[wave]]
        place[under] = place[up[under]] + 1 + before[under]
    if lists:
        members = np.empty(len(good), dtype=np.int64)
        members[place[good]] = good
        ends = np.cumsum(np.where(bad, 0, size))
        of = np.repeat(np.arange(m), np.where(bad, 0, size))
        flat = members[np.repeat(place + 1, np.where(bad, 0, size)) + np.arange(len(of)) - np.repeat(ends - np.where(bad, 0, size), np.where(bad, 0, size))] if len(of) else np.empty(0, np.int64)
        out["descendants"] = (ends, text[flat[np.lexsort((flat, of))]])  # nodes are numbered in the order of their text
        steps = np.where(bad, 0, depth + 1)
        ends = np.cumsum(steps)
        flat, at, k = np.zeros(int(steps.sum()), dtype=np.int64), good, 0
        own = good
        while len(own):
            flat[ends[own] - 1 - k] = at
            k += 1
            more = depth[own] >= k
            own, at = own[more], up[at[more]]
        out["path"] = (ends, text[flat])
    return out


def _lists(ends_and_texts: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    ends, texts = ends_and_texts
    return pa.LargeListArray.from_arrays(pa.array(np.r_[0, ends], pa.int64()), pa.array(texts, pa.string())).cast(pa.list_(pa.string()))


def _packed(links: DataFrame, keys: list[str], lists: bool, n: int) -> DataFrame:
    """Buckets of whole groups through the peel."""
    kinds = dict(links.dtypes)
    buckets = buckets_for(n, BUCKET_LINKS, 8)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), _COLUMNS, *(["path array<string>, descendants array<string>"] if lists else [])])

    def of_bucket(t: pa.Table) -> pa.Table:
        frame = t.select(keys).to_pandas()
        group = frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        firsts = np.unique(group, return_index=True)[1]
        got = peel(group, t["child"].to_numpy(), t["parent"].to_numpy(), lists)
        own = t.select(keys).take(pa.array(firsts[got["group"]] if len(firsts) else [], pa.int64()))
        names, arrays = [*keys], [own[k] for k in keys]
        for name, kind in (("node", pa.string()), ("parent", pa.string()), ("root", pa.string()), ("depth", pa.int32()), ("n_descendants", pa.int64())):
            names.append(name)
            arrays.append(pa.array(got[name], kind))
        if lists:
            names += ["path", "descendants"]
            arrays += [_lists(got["path"]), _lists(got["descendants"])]
        return pa.table(arrays, names=names)

    return links.groupBy(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")).applyInArrow(of_bucket, schema)


# -- groups beyond a task ---------------------------------------------------------------------------


def _spread(links: DataFrame, keys: list[str], lists: bool, group_links: int) -> DataFrame:
    """Groups beyond a task.  `live` holds the nodes not yet taken: the node above (`up`), the links to
    it (`far`), what hangs on those links (`extra`), what is known to hang below (`below`), and whether
    the node itself counts (`own`)."""
    child = links.where("child is not null").select(*keys, F.col("child").alias("node"), "parent")
    top = links.where("parent is not null").select(*keys, F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"))
    first = stored(child.unionByName(top).groupBy(*keys, "node").agg(F.min("parent").alias("parent"), F.count_distinct("parent").alias("n_parents")))
    bad = _into_cycles(links, first, keys) if not first.where("n_parents > 1").isEmpty() else first.where("false").select(*keys, "node")

    def met(a: DataFrame, by: str, b: DataFrame, name: str, how: str = "left") -> DataFrame:
        """a with the row of b whose `name` is a's `by`, in the same group; b's other columns differ from a's."""
        b = b.select(*(F.col(k).alias(f"b_{k}") for k in keys), *(F.col(c) for c in b.columns if c not in keys))
        on = [*(F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys), F.col(by) == F.col(name)]
        return a.join(b, on, how).drop(*(f"b_{k}" for k in keys), name)

    zero = F.lit(0).cast("bigint")
    flagged = met(first, "node", bad.select(*keys, F.col("node").alias("bad_node"), F.lit(True).alias("bad")), "bad_node")
    live = stored(flagged.select(*keys, "node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("far"), zero.alias("extra"), zero.alias("below"), F.when(F.col("bad"), 0).otherwise(1).cast("bigint").alias("own")))
    taken: list[DataFrame] = []
    at = 0
    while _sizes(live, keys, group_links)[2] > group_links:
        at += 1
        coin = lambda c, at=at: F.pmod(F.xxhash64(*keys, c, F.lit(at)), F.lit(2)) == 1
        kids = live.where("up is not null").groupBy(*keys, F.col("up").alias("k_up")).agg(F.count("*").alias("kids"), F.min("node").alias("kid"), F.max("extra").alias("kid_extra"))
        # No two nodes taken out of a chain are neighbours, and no leaf is taken from under one of them.
        kids_ = F.coalesce("kids", F.lit(0))
        what = (
            F.when(F.col("up").isNull() & (kids_ == 0), "root").when((F.col("up") == F.col("node")) & (kids_ == 1), "loop")
            .when(F.col("up").isNotNull() & (kids_ == 0) & ~coin("up"), "leaf").when(F.col("up").isNotNull() & (kids_ == 1) & coin("node") & ~coin("up"), "chain")
        )
        marked = stored(met(live, "node", kids, "k_up").withColumn("what", what))
        taken.append(marked.where("what is not null"))
        weight = F.col("below") + F.col("own") + F.col("extra")
        sent = marked.where("what = 'leaf'").groupBy(*keys, F.col("up").alias("l_up")).agg(F.sum(weight).alias("sent"))
        out = marked.where("what = 'chain'").select(*keys, F.col("node").alias("c_node"), F.col("up").alias("c_up"), F.col("far").alias("c_far"), weight.alias("c_weight"))
        left = met(met(marked.where("what is null").drop("kids", "kid", "kid_extra", "what"), "node", sent, "l_up"), "up", out, "c_node")
        live = stored(left.select(*keys, "node", F.coalesce("c_up", "up").alias("up"), (F.col("far") + F.coalesce("c_far", zero)).alias("far"), (F.col("extra") + F.coalesce("c_weight", zero)).alias("extra"), (F.col("below") + F.coalesce("sent", zero)).alias("below"), "own"))
    placed = stored(_finish(live, keys))
    for t in reversed(taken):
        over = placed.select(*keys, F.col("node").alias("o_node"), F.col("root").alias("o_root"), F.col("depth").alias("o_depth"))
        under = placed.select(*keys, F.col("node").alias("u_node"), F.col("n_descendants").alias("u_size"), F.col("own").alias("u_own"))
        j = met(met(t, "up", over, "o_node"), "kid", under, "u_node")
        whole = F.col("below") + F.when(F.col("what") == "chain", F.col("u_size") + F.col("u_own") + F.col("kid_extra")).otherwise(0)
        cyclic = (F.col("what") == "loop") | F.coalesce(F.col("o_depth") < 0, F.lit(False))
        root = F.when(cyclic, "").when(F.col("what") == "root", F.col("node")).otherwise(F.col("o_root"))
        depth = F.when(cyclic, -1).when(F.col("what") == "root", 0).otherwise(F.col("o_depth") + F.col("far"))
        placed = stored(placed.unionByName(j.select(*keys, "node", root.alias("root"), depth.cast("bigint").alias("depth"), whole.alias("n_descendants"), "own")))
    good = F.col("own").eqNullSafe(F.lit(1)) & (F.col("depth") >= 0)
    out = met(placed, "node", first.select(*keys, F.col("node").alias("f_node"), "parent"), "f_node")
    out = out.select(*keys, "node", "parent", F.when(good, F.col("root")).otherwise("").alias("root"), F.when(good, F.col("depth")).otherwise(-1).cast("int").alias("depth"), F.when(good, F.col("n_descendants")).otherwise(0).alias("n_descendants"))
    return _with_lists(stored(out), keys) if lists else out


def _into_cycles(links: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """Where nodes have several parents: those of whose parents any leads into a cycle.  From the top, a
    node is placed once none of its parents is open, a round a level."""
    same = lambda a, b: [*(F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys), F.col(a) == F.col(b)]
    named = lambda df: df.select(*(F.col(k).alias(f"w_{k}") for k in keys), F.col("node").alias("w_node"))
    open_ = links.where("child is not null and parent is not null").select(*keys, F.col("child").alias("node"), "parent")
    wave = first.where("parent is null").select(*keys, "node")
    done = wave
    while not wave.isEmpty():
        gone = named(wave)
        freed = open_.join(gone, same("parent", "w_node"), "left_semi").select(*keys, "node").distinct()
        open_ = stored(open_.join(gone, same("parent", "w_node"), "left_anti"))
        wave = stored(freed.join(named(open_.select(*keys, "node").distinct()), same("node", "w_node"), "left_anti"))
        done = stored(done.unionByName(wave))
    return first.select(*keys, "node").join(named(done), same("node", "w_node"), "left_anti")


def _finish(live: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of large groups, now of a task's size, peeled there: keys, node, root, depth, n_descendants, own."""
    kinds = dict(live.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "node string, root string, depth bigint, n_descendants bigint, own bigint"])

    def of_bucket(t: pa.Table) -> pa.Table:
        group = t.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        node, over = t["node"].to_numpy(), t["up"].to_numpy()
        code = pd.MultiIndex.from_arrays([group, node])
        up = code.get_indexer(pd.MultiIndex.from_arrays([group, over])) if len(node) else np.empty(0, int)
        far, extra, size, own = (t[c].to_numpy().copy() for c in ("far", "extra", "below", "own"))
        kids = np.bincount(up[up >= 0], minlength=len(node))
        waves, ready = [], np.flatnonzero(kids == 0)
        while len(ready):
            waves.append(ready)
            hung = ready[up[ready] >= 0]
            np.add.at(size, up[hung], size[hung] + own[hung] + extra[hung])
            np.subtract.at(kids, up[hung], 1)
            above = np.unique(up[hung])
            ready = above[kids[above] == 0]
        root, depth = np.full(len(node), -1), np.full(len(node), -1)
        for wave in waves[::-1]:
            top, rest = wave[up[wave] < 0], wave[up[wave] >= 0]
            root[top], depth[top] = top, 0
            rest = rest[root[up[rest]] >= 0]
            root[rest], depth[rest] = root[up[rest]], depth[up[rest]] + far[rest]
        names = np.where(root >= 0, node[root], "") if len(node) else node
        own_keys = t.select(keys)
        return pa.table([*(own_keys[k] for k in keys), t["node"], pa.array(names, pa.string()), pa.array(depth, pa.int64()), pa.array(size, pa.int64()), pa.array(own, pa.int64())], names=[*keys, "node", "root", "depth", "n_descendants", "own"])

    return live.groupBy(F.pmod(F.xxhash64(*keys), F.lit(buckets_for(live.count(), BUCKET_LINKS, 8))).alias("bucket")).applyInArrow(of_bucket, schema)


def _with_lists(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Paths and descendant lists of placed nodes, from the pairs of node and ancestor, which are as many as
    the entries asked for; they are made by doubling distances."""
    pair = lambda a, b, x, y: [*(F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.col(f"{a}.{x}") == F.col(f"{b}.{y}")]
    total = stored(placed.where("depth > 0").select(*keys, "node", F.col("parent").alias("anc"), F.lit(1).alias("dist")))
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    span = 1
    while span < deepest:
        step = total.select(*keys, F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"))
        far = total.where(F.col("dist") == span).alias("x").join(step.alias("y"), pair("x", "y", "anc", "anc")).select(*(F.col(f"x.{k}").alias(k) for k in keys), "x.node", F.col("anc2").alias("anc"), (F.col("x.dist") + F.col("dist2")).alias("dist"))
        total = stored(total.unionByName(far))
        span *= 2
    empty = F.array().cast("array<string>")
    down = total.groupBy(*keys, F.col("anc").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("kin"))
    up = total.groupBy(*keys, "node").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), F.col("anc").alias("a")))), lambda x: x["a"]).alias("above"))
    j = placed.alias("p").join(down.alias("d"), pair("p", "d", "node", "node"), "left").join(up.alias("u"), pair("p", "u", "node", "node"), "left")
    path = F.when(F.col("p.depth") < 0, empty).otherwise(F.concat(F.coalesce("u.above", empty), F.array(F.col("p.node"))))
    return j.select(*(F.col(f"p.{k}").alias(k) for k in keys), "p.node", "p.parent", "p.root", "p.depth", "p.n_descendants", path.alias("path"), F.coalesce("d.kin", empty).alias("descendants"))


# -- the project's trees ----------------------------------------------------------------------------


def source_links(edges: DataFrame) -> DataFrame:
    """A column hangs under its first source."""
    name = lambda a, b: F.concat(F.col(a), F.lit("|"), F.coalesce(F.col(b), F.lit("")))
    return edges.where("edge_ordinal = 0").select(F.lit("source").alias("tree_kind"), "stmt_id", name("to_scope", "to_column").alias("child"), name("from_scope", "from_column").alias("parent"))


def join_links(joins: DataFrame) -> DataFrame:
    """A right scope hangs under its left scope."""
    return joins.select(F.lit("join").alias("tree_kind"), "stmt_id", F.col("right_scope").alias("child"), F.col("left_scope").alias("parent"))


def hierarchies(edges: DataFrame, joins: DataFrame, lists: bool = False) -> DataFrame:
    """Both kinds of trees in one pass."""
    return hierarchy(source_links(edges).unionByName(join_links(joins)), ["tree_kind", "stmt_id"], lists)


def found(edges: DataFrame, joins: DataFrame) -> DataFrame:
    return hierarchies(edges, joins).select("tree_kind", "stmt_id", "node", "root", "depth")


def tree_report(edges: DataFrame, joins: DataFrame) -> DataFrame:
    """Per kind: trees, nodes, nodes in or under cycles, greatest depth and largest subtree."""
    return hierarchies(edges, joins).groupBy("tree_kind").agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("depth") == 0).alias("n_roots"), F.count_if(F.col("depth") < 0).alias("n_cyclic"), F.max("depth").alias("max_depth"), F.max("n_descendants").alias("max_descendants")
    )

