"""Topology of sites: undirected simple graphs, analysed for all sites in one job by joins, whatever the size of a site.

Searches go on level by level; what a node asks of its ancestors or descendants is found by jump pointers, which double each round. Rounds
therefore follow the depth of a site's tree (searches) or its logarithm (all else), and no task holds a site. Rounds cost the same however
little there is to do, so ``site_metrics`` gives sites of up to ``SMALL`` nodes and links to a task each; the results do not depend on it.
Path lengths need a row for each node and each word of starts, and write these every round. So the searches of a site of up to ``MEDIUM``
nodes and links are dealt to tasks by groups of starts, each with the site's links (16 bytes a link) in numpy arrays, and write a row a group;
larger sites go by rounds. Nodes are long numbers.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specgraph.operators.walk import components, shared_checkpoint

#: Start nodes in a group that is numbered together (about), and those that one word of bits stands for.
GROUP, WORD = 1024, 63
KEY = ["site_id", "node"]
#: Most nodes and links together of a site that one task analyses.
SMALL = 2000
#: Most nodes and links together of a site whose links a task of searches holds, starts of such a task, and words of 64 starts that are searched at once.
MEDIUM, STARTS, WORDS = 2_000_000, 8192, 8
SITE = "site_id string, far long, steps long, bridges string, cut_nodes string, n_nodes long, n_edges long, n_components long, connected boolean"


def simple_edges(edges: DataFrame) -> DataFrame:
    """(site_id, u, v) with u < v, each pair once, no loops."""
    return edges.where("u <> v").select("site_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    """(site_id, node, near): each link from both its ends."""
    one = pairs.select("site_id", F.col("u").alias("node"), F.col("v").alias("near"))
    return one.unionByName(pairs.select("site_id", F.col("v").alias("node"), F.col("u").alias("near")))


def whole(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(site_id, node): the nodes given and the ends of links, each once."""
    return nodes.select("site_id", "node").union(pairs.select("site_id", "u")).union(pairs.select("site_id", "v")).distinct()


def site_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(site_id, node, component) for graphs of any size: smallest reachable node, by rounds of joins over the whole table."""
    labelled = components(simple_edges(edges).select(_name("u").alias("a"), _name("v").alias("b")))
    own = nodes.select("site_id", "node", _name("node").alias("id"))
    named = own.join(labelled.withColumnRenamed("node", "id"), "id", "left").select("site_id", "node", F.coalesce("root", "id").alias("root"))
    return named.select("site_id", "node", F.element_at(F.split("root", "/"), -1).cast("long").alias("component"))


def _name(column: str):  # noqa: ANN202
    """A node of a site as one text, in the order of its numbers."""
    return F.concat_ws("/", "site_id", F.lpad(F.col(column).cast("string"), 20, "0"))


def search_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(site_id, node, parent, level): breadth-first trees from the least node of every component; of several parents the least.

    A link that is not in the tree joins nodes of one level or of two that follow each other, and neither is above the other. So a node
    that is reached again lies in one of the last two levels, and new ones are told from these alone.
    """
    near = shared_checkpoint(both_ways(shared_checkpoint(simple_edges(edges))))
    front = shared_checkpoint(site_components(nodes, edges).where("node = component").select(*KEY, F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level")))
    before, every, level = front, front, 0
    while True:
        level += 1
        heard = front.select(*KEY).join(near, KEY).groupBy("site_id", F.col("near").alias("node")).agg(F.min("node").alias("parent"))
        fresh = heard.join(front.select(*KEY).unionByName(before.select(*KEY)), KEY, "left_anti")
        before, front = front, shared_checkpoint(fresh.withColumn("level", F.lit(level)))
        if front.isEmpty():
            return every
        every = every.unionByName(front)


def jumps(tree: DataFrame) -> list[DataFrame]:
    """(site_id, node, up) tables: the ancestors 1, 2, 4, ... levels above; nodes that are not so deep are left out."""
    found = [shared_checkpoint(tree.where("parent IS NOT NULL").select(*KEY, F.col("parent").alias("up")))]
    while not found[-1].isEmpty():
        step = found[-1]
        found.append(shared_checkpoint(step.join(step.select("site_id", F.col("node").alias("up"), F.col("up").alias("far")), ["site_id", "up"]).select(*KEY, F.col("far").alias("up"))))
    return found[:-1]


def meeting_levels(tree: DataFrame, pairs: DataFrame, ups: list[DataFrame]) -> DataFrame:
    """(site_id, u, v, meet): the level of the lowest common ancestor of each link that is not in the tree."""
    own = tree.select("site_id", F.col("node").alias("u"), F.col("parent").alias("pu"), F.col("level").alias("lu"))
    other = own.toDF("site_id", "v", "pv", "lv")
    links = pairs.join(own, ["site_id", "u"]).join(other, ["site_id", "v"]).where("NOT (pu <=> v OR pv <=> u)")
    # the deeper end goes up one level, so that both are on one
    low = F.when(F.col("lu") > F.col("lv"), F.col("pu")).otherwise(F.col("u"))
    high = F.when(F.col("lv") > F.col("lu"), F.col("pv")).otherwise(F.col("v"))
    rows = shared_checkpoint(links.select("site_id", "u", "v", low.alias("x"), high.alias("y"), F.least("lu", "lv").alias("at")))
    for k in reversed(range(len(ups))):
        above = ups[k]
        asked = rows.join(above.select("site_id", F.col("node").alias("x"), F.col("up").alias("ux")), ["site_id", "x"], "left").join(above.select("site_id", F.col("node").alias("y"), F.col("up").alias("uy")), ["site_id", "y"], "left")
        apart = F.coalesce(F.col("ux") != F.col("uy"), F.lit(False))
        rows = shared_checkpoint(asked.select("site_id", "u", "v", F.when(apart, F.col("ux")).otherwise(F.col("x")).alias("x"), F.when(apart, F.col("uy")).otherwise(F.col("y")).alias("y"), F.when(apart, F.col("at") - (1 << k)).otherwise(F.col("at")).alias("at")))
    return rows.select("site_id", "u", "v", (F.col("at") - 1).alias("meet"))


def least_below(values: DataFrame, ups: list[DataFrame]) -> DataFrame:
    """(site_id, node, value): for each node the least value of itself and all its descendants."""
    for above in ups:
        passed = values.join(above, KEY).select("site_id", F.col("up").alias("node"), "value")
        values = shared_checkpoint(values.unionByName(passed).groupBy(*KEY).agg(F.min("value").alias("value")))
    return values


def blocks(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site_id, node, parent, bridge, block) of every node but the trees' roots, standing for the link to its parent, and the links themselves.

    A link of the tree is a bridge if no other link leaves the part below it. It is in one block with the link above it if one leaves the
    part below that as well. The ends of every other link stand for two links of the tree in one block. Blocks are what is linked by these.
    """
    pairs = shared_checkpoint(simple_edges(edges))
    tree = shared_checkpoint(search_tree(whole(nodes, pairs), pairs))
    ups = jumps(tree)
    meets = shared_checkpoint(meeting_levels(tree, pairs, ups))
    ends = meets.select("site_id", F.col("u").alias("node"), "meet").unionByName(meets.select("site_id", F.col("v").alias("node"), "meet"))
    own = tree.select(*KEY).join(ends.groupBy(*KEY).agg(F.min("meet").alias("value")), KEY, "left")
    below = least_below(shared_checkpoint(own.select(*KEY, F.coalesce("value", F.lit(1 << 30)).alias("value"))), ups)
    links = shared_checkpoint(tree.where("parent IS NOT NULL").join(below, KEY).select(*KEY, "parent", "level", "value", (F.col("value") >= F.col("level")).alias("bridge")))
    above = links.where("value < level - 1").select("site_id", F.col("node").alias("u"), F.col("parent").alias("v"))
    joined = components(above.unionByName(meets.select("site_id", "u", "v")).select(_name("u").alias("a"), _name("v").alias("b")))
    named = links.withColumn("id", _name("node")).join(joined.select(F.col("node").alias("id"), F.col("root").alias("block")), "id", "left")
    return shared_checkpoint(named.select(*KEY, "parent", "bridge", F.coalesce("block", "id").alias("block"))), pairs


def bridges(links: DataFrame) -> DataFrame:
    """(site_id, u, v) with u < v: links without which a site falls apart; ``links`` as ``blocks`` gives them."""
    return links.where("bridge").select("site_id", F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))


def cut_nodes(links: DataFrame) -> DataFrame:
    """(site_id, node): nodes whose links are in several blocks."""
    at = links.select(*KEY, "block").unionByName(links.select("site_id", F.col("parent").alias("node"), "block")).distinct()
    return at.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY)


def searched(starts: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[int, int]:
    """(far, steps) of searches from some nodes over the links u - v: a word of bits of each node says which starts have come to it, and each round takes the bits of its neighbours."""
    names, at = np.unique(np.concatenate([starts, u, v]), return_inverse=True)
    a = np.concatenate([at[len(starts) : len(starts) + len(u)], at[len(starts) + len(u) :]])
    b = np.concatenate([at[len(starts) + len(u) :], at[len(starts) : len(starts) + len(u)]])
    order = np.argsort(b, kind="stable")
    near, ends = a[order], b[order]
    heads = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else np.empty(0, np.int64)
    heard_by = ends[heads]
    far = steps = 0
    for lo in range(0, len(starts), 64 * WORDS):
        own = at[lo : min(lo + 64 * WORDS, len(starts))]
        seen = np.zeros((len(names), -(-len(own) // 64)), np.uint64)
        numbers = np.arange(len(own))
        seen[own, numbers // 64] = np.left_shift(np.uint64(1), (numbers % 64).astype(np.uint64))
        front, depth = seen.copy(), 0
        while len(heads):
            depth += 1
            heard = np.bitwise_or.reduceat(front[near], heads, axis=0) & ~seen[heard_by]
            new = int(np.bitwise_count(heard).sum())
            if not new:
                break
            far, steps = max(far, depth), steps + new * depth
            seen[heard_by] |= heard
            front[heard_by] = heard
    return far, steps


def _of_group(key: tuple, starts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    found = [[key[0], *searched(starts["node"].to_numpy(np.int64), pairs["u"].to_numpy(np.int64), pairs["v"].to_numpy(np.int64))]] if len(starts) else []
    return pd.DataFrame(found, columns=["site_id", "far", "steps"])


def medium_lengths(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``path_lengths`` of sites whose links a task can hold: a task has a group of starts."""
    groups = nodes.groupBy("site_id").agg(F.ceil(F.count("*") / STARTS).alias("groups"))
    starts = nodes.join(groups, "site_id").select(*KEY, F.pmod(F.xxhash64("node"), "groups").alias("group"))
    links = pairs.join(groups, "site_id").select("site_id", "u", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
    found = starts.groupBy("site_id", "group").cogroup(links.groupBy("site_id", "group")).applyInPandas(_of_group, "site_id string, far long, steps long")
    return found.groupBy("site_id").agg(F.max("far").alias("far"), F.sum("steps").alias("steps"))


def path_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(site_id, far, steps): the longest of all shortest paths between nodes that reach each other, and the sum of all of them (each pair from both ends)."""
    pairs = shared_checkpoint(simple_edges(edges))
    nodes = shared_checkpoint(nodes.select(*KEY).distinct())
    sizes = nodes.select("site_id").unionByName(pairs.select("site_id")).groupBy("site_id").agg(F.count("*").alias("n"))
    large = shared_checkpoint(sizes.where(F.col("n") > MEDIUM).select("site_id"))
    found = medium_lengths(nodes.join(large, "site_id", "left_anti"), pairs.join(large, "site_id", "left_anti"))
    if not large.isEmpty():
        found = found.unionByName(large_lengths(nodes.join(large, "site_id", "left_semi"), pairs.join(large, "site_id", "left_semi")))
    return found


def large_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``path_lengths`` by rounds of joins, whatever the size of a site.

    Searches start at all nodes at once, ``WORD`` of them in a word of bits: a row says which starts have come to a node. Each round only bits that are
    new to a node move on.
    """
    near = shared_checkpoint(both_ways(shared_checkpoint(simple_edges(edges))))
    nodes = shared_checkpoint(nodes)
    count = nodes.groupBy("site_id").agg(F.count("*").alias("n"))
    grouped = nodes.join(count, "site_id").withColumn("group", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / GROUP)))
    number = F.row_number().over(Window.partitionBy("site_id", "group").orderBy("node")) - 1
    bit = F.expr(f"shiftleft(1L, cast(number % {WORD} AS INT))")
    starts = grouped.withColumn("number", number).select(*KEY, F.concat_ws(".", "group", F.floor(F.col("number") / WORD)).alias("word"), bit.alias("bits"))
    front = shared_checkpoint(starts)
    seen, depth, found = front, 0, None
    while True:
        depth += 1
        heard = front.join(near, KEY).groupBy("site_id", F.col("near").alias("node"), "word").agg(F.bit_or("bits").alias("heard"))
        fresh = heard.join(seen, [*KEY, "word"], "left").withColumn("fresh", F.col("heard").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")))))
        fresh = shared_checkpoint(fresh.where("fresh <> 0").select(*KEY, "word", F.col("fresh").alias("bits")))
        of_round = shared_checkpoint(fresh.groupBy("site_id").agg(F.lit(depth).cast("long").alias("far"), F.sum(F.bit_count("bits") * depth).cast("long").alias("steps")))
        if of_round.isEmpty():
            break
        found = of_round if found is None else found.unionByName(of_round)
        seen = shared_checkpoint(seen.unionByName(fresh).groupBy(*KEY, "word").agg(F.bit_or("bits").alias("bits")))
        front = fresh
    zero = nodes.select("site_id", F.lit(0).cast("long").alias("far"), F.lit(0).cast("long").alias("steps")).distinct()
    return (zero if found is None else zero.unionByName(found)).groupBy("site_id").agg(F.max("far").alias("far"), F.sum("steps").alias("steps"))


def site_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(site_id, n_nodes, n_edges, n_components, connected)."""
    pairs = simple_edges(edges)
    parts = site_components(whole(nodes, pairs), edges)
    own = parts.groupBy("site_id", "component").agg(F.count("*").alias("n")).groupBy("site_id").agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_components"))
    links = pairs.groupBy("site_id").agg(F.count("*").alias("n_edges"))
    return own.join(links, "site_id", "left").select("site_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_components", (F.col("n_components") == 1).alias("connected"))


def adjacency(nodes: list[int], pairs: list[tuple[int, int]]) -> dict[int, list[int]]:
    near: dict[int, list[int]] = {n: [] for n in nodes}
    for u, v in pairs:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    return near


def distances(near: dict[int, list[int]], start: int) -> dict[int, int]:
    """Steps from one node to each that it reaches."""
    seen, todo = {start: 0}, deque([start])
    while todo:
        u = todo.popleft()
        for v in near[u]:
            if v not in seen:
                seen[v] = seen[u] + 1
                todo.append(v)
    return seen


def weak_points(near: dict[int, list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Bridges (u < v) and cut nodes, by depth-first low points without recursion."""
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    bridges: list[tuple[int, int]] = []
    cuts: set[int] = set()
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, branches = [(root, -1, iter(near[root]))], 0
        while stack:
            u, up, rest = stack[-1]
            for v in rest:
                if v not in order:
                    order[v] = low[v] = len(order)
                    branches += u == root
                    stack.append((v, u, iter(near[v])))
                    break
                if v != up:
                    low[u] = min(low[u], order[v])
            else:
                stack.pop()
                if stack:
                    low[up] = min(low[up], low[u])
                    if low[u] > order[up]:
                        bridges.append((min(u, up), max(u, up)))
                    if up != root and low[u] >= order[up]:
                        cuts.add(up)
        if branches > 1:
            cuts.add(root)
    return sorted(bridges), sorted(cuts)


def _of_site(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Bridges, cut nodes and path lengths of one small site."""
    near = adjacency(sorted(set(nodes["node"])), list(zip(edges["u"], edges["v"], strict=True)))
    found, cuts = weak_points(near)
    reach = [distances(near, n).values() for n in near]
    left, parts = set(near), 0
    while left:
        left -= distances(near, next(iter(left))).keys()
        parts += 1
    row = [key[0], max(map(max, reach)), sum(map(sum, reach)), ",".join(f"{u}-{v}" for u, v in found), ",".join(map(str, cuts)), len(near), len(edges), parts, parts == 1]
    return pd.DataFrame([row], columns=[c.split()[0] for c in SITE.split(", ")])


def small_sites(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``SITE`` rows of sites that fit in a task each."""
    return nodes.groupBy("site_id").cogroup(pairs.groupBy("site_id")).applyInPandas(_of_site, SITE)


def large_sites(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same columns, by rounds of joins; all pairs are searched in connected sites alone, as the others have no path lengths."""
    counts = shared_checkpoint(site_counts(nodes, pairs))
    whole_ones = counts.where("connected").select("site_id")
    lengths = path_lengths(nodes.join(whole_ones, "site_id", "left_semi"), pairs.join(whole_ones, "site_id", "left_semi")).select("site_id", "far", "steps")
    links = blocks(nodes, pairs)[0]
    weak = bridges(links).groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u", "v"))), lambda b: F.concat_ws("-", b["u"], b["v"])), ",").alias("bridges"))
    cuts = cut_nodes(links).groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("cut_nodes"))
    return counts.join(lengths, "site_id", "left").join(weak, "site_id", "left").join(cuts, "site_id", "left").na.fill("", ["bridges", "cut_nodes"])


def site_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, components, diameter, average path (both null where a site is not connected), bridges and cut nodes of every site.

    Bridges (``u-v``) and cut nodes are given as one text for each site; ``bridges`` and ``cut_nodes`` have them as rows.
    """
    pairs = shared_checkpoint(simple_edges(edges))
    every = shared_checkpoint(whole(nodes, pairs))
    sizes = every.select("site_id").unionByName(pairs.select("site_id")).groupBy("site_id").agg(F.count("*").alias("n"))
    large = shared_checkpoint(sizes.where(F.col("n") > SMALL).select("site_id"))
    found = small_sites(every.join(large, "site_id", "left_anti"), pairs.join(large, "site_id", "left_anti"))
    if not large.isEmpty():
        found = found.unionByName(large_sites(shared_checkpoint(every.join(large, "site_id", "left_semi")), shared_checkpoint(pairs.join(large, "site_id", "left_semi"))))
    pairs_of = F.col("n_nodes") * (F.col("n_nodes") - 1)
    average = F.when(F.col("connected"), F.when(pairs_of > 0, F.round(F.col("steps") / pairs_of, 2)).otherwise(0.0))
    return found.select("site_id", "n_nodes", "n_edges", "n_components", "connected", F.when(F.col("connected"), F.col("far")).alias("diameter"), average.alias("avg_path"), "bridges", "cut_nodes")
