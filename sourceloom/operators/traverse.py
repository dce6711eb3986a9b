"""Bounded traversals for many roots in one job: one equi join per level, lineage cut per level.

Edges are (src, dst, relationship_type[, repository_id]); seeds carry a ``root`` column. A frontier
whose counted size is small is broadcast, so the edge table is scanned in place; a larger one is
joined by shuffle with Spark's skew handling. Nothing is collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.functions import scalars as S
from sourceloom.functions.ranking import ranked, top_per_group
from sourceloom.session import cut, cut_counted, small_side, stored, stored_observed

#: Links of one root that a task may walk depth first.
TASK_EDGES = 1_000_000
#: Words of 64 roots that share a row in ``packed_reach``.
ROW_WORDS = 4
#: Asked pairs beyond which ``shortest_path`` first drops links on no path, and levels a job of that walks.
PRUNE_PAIRS, PRUNE_HOPS = 1_000, 8


def links(edges: DataFrame, direction: str = "outgoing", rel_types=None) -> DataFrame:
    """(src, dst) pairs to walk: filtered by edge type, turned round or doubled by direction."""
    wanted = S.known_edge_types(rel_types)
    kept = edges.where(S.edge_type(F.col("relationship_type")).isin(*wanted)) if wanted else edges
    direction = S.clean_direction(direction)
    if direction == "outgoing":
        return kept.select("src", "dst")
    if direction == "incoming":
        return kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return kept.select(F.explode(ends).alias("e")).select("e.src", "e.dst")


def _start(seeds: DataFrame) -> tuple[DataFrame, int]:
    return cut_counted(seeds.select("root", F.col("root").alias("node")).distinct())


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else like.limit(0)


def _leveled(frame: DataFrame, level: int) -> DataFrame:
    return frame.withColumn("depth", F.lit(level))


def reach(pairs: DataFrame, seeds: DataFrame, depth: int, include_root: bool = False) -> DataFrame:
    """(root, node, depth): every node within ``depth`` steps with its smallest distance."""
    frontier, rows = _start(seeds)
    seen = [frontier]
    found = [_leveled(frontier, 0)] if include_root else []
    for level in range(1, depth + 1):
        step = (pairs.join(small_side(frontier, rows), pairs["src"] == frontier["node"])
                .select("root", F.col("dst").alias("node")).distinct())
        fresh = step.join(_union(seen, frontier), ["root", "node"], "left_anti")
        frontier, rows = cut_counted(fresh)
        if rows == 0:
            break
        seen.append(frontier)
        found.append(_leveled(frontier, level))
    return _union(found, _leveled(frontier, 0))


@dataclass
class PackedReach:
    """Reach of many roots: ``numbers`` (root, block, bit) and, for each level at which a node is first met, ``planes`` (block, node,
    depth, bits) with a bit for every root of the block that meets it there."""

    numbers: DataFrame
    planes: DataFrame

    def pairs(self) -> DataFrame:
        """(root, node, depth) of every root and node it reaches."""
        return self.planes.join(self.numbers, "block").where("(shiftright(bits, bit) & 1) = 1").select("root", "node", "depth")

    def counts(self) -> DataFrame:
        """(root, depth, node_count): nodes first met at each depth. Blocks are summed bit by bit before roots are told apart."""
        sums = F.array(*[F.sum(F.expr(f"shiftright(bits, {k}) & 1")) for k in range(64)])
        summed = self.planes.groupBy("block", "depth").agg(sums.alias("sums")).select("block", "depth", F.posexplode("sums").alias("bit", "node_count"))
        return summed.where("node_count > 0").join(self.numbers, ["block", "bit"]).select("root", "depth", "node_count")

    def farthest(self) -> DataFrame:
        """(root, depth): the largest distance at which a root first meets a node."""
        bits = self.planes.groupBy("block", "depth").agg(F.bit_or("bits").alias("bits"))
        return bits.join(self.numbers, "block").where("(shiftright(bits, bit) & 1) = 1").groupBy("root").agg(F.max("depth").alias("depth"))


def packed_reach(pairs: DataFrame, seeds: DataFrame, depth: int | None = None) -> PackedReach:
    """Every node within ``depth`` steps of each root (all if None), for thousands of roots at once.

    64 roots share a block and up to ``ROW_WORDS`` blocks a row, whose words hold one bit for each root that has met the node, so a
    level is one join with the links and one bitwise or of few wide rows. A row's blocks leave once none of their roots meets a new
    node; only rows with a new bit go on. Roots are numbered in order of their ids, so that like ones share blocks.
    """
    if seeds.isEmpty():
        name = dict(seeds.dtypes)["root"]
        return PackedReach(*[seeds.sparkSession.createDataFrame([], kind) for kind in (f"root {name}, block long, bit int", f"block long, node {name}, depth int, bits long")])
    numbered, measured = stored_observed(seeds.select("root").distinct().orderBy("root").withColumn("at", F.monotonically_increasing_id()), "packed-roots", roots=F.count(F.lit(1)))
    numbers = numbered.select("root", F.expr("at div 64").alias("block"), F.expr("cast(at % 64 as int)").alias("bit"))
    words = range(min(ROW_WORDS, -(-measured["roots"] // 64)))
    steps = stored(pairs.select("src", "dst").where("src <> dst").distinct(), "packed-links")

    def opened(plane: DataFrame, level: int) -> DataFrame:
        rows = F.explode(F.array(*[F.struct((F.col("row") * len(words) + k).alias("block"), F.col(f"w{k}").alias("bits")) for k in words])).alias("e")
        return _leveled(plane.select("node", rows).select("e.block", "node", "e.bits").where("bits <> 0"), level)

    seen = numbers.select(F.expr(f"block div {len(words)}").alias("row"), F.col("root").alias("node"),
                          *[F.expr(f"if(block % {len(words)} = {k}, shiftleft(1L, bit), 0L)").alias(f"w{k}") for k in words])
    planes, plane, rows, level = [opened(seen, 0)], seen, measured["roots"], 0
    while depth is None or level < depth:
        level += 1
        offers = steps.join(small_side(plane.withColumnRenamed("node", "src"), rows), "src").groupBy("row", F.col("dst").alias("node")).agg(*[F.bit_or(f"w{k}").alias(f"o{k}") for k in words])
        merged = seen.join(offers, ["row", "node"], "full_outer").select(
            "row", "node", *[F.expr(f"coalesce(w{k}, 0L) | coalesce(o{k}, 0L)").alias(f"w{k}") for k in words],
            *[F.expr(f"coalesce(o{k}, 0L) & ~coalesce(w{k}, 0L)").alias(f"f{k}") for k in words])
        new = F.expr(" | ".join(f"f{k}" for k in words)) != 0
        merged, measured = stored_observed(merged, "packed-level", met=F.count_if(new))
        rows = measured["met"]
        if not rows:
            break
        plane = merged.where(new).select("row", "node", *[F.col(f"f{k}").alias(f"w{k}") for k in words])
        planes.append(opened(plane, level))
        seen = merged.join(plane.select("row").distinct(), "row", "left_semi").select("row", "node", *[f"w{k}" for k in words])
    return PackedReach(numbers, _union(planes, planes[0]))


def walk_levels(pairs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth) for every walk length 1..depth: a node may appear on several levels."""
    frontier, rows = _start(seeds)
    found = []
    for level in range(1, depth + 1):
        step = (pairs.join(small_side(frontier, rows), pairs["src"] == frontier["node"])
                .select("root", F.col("dst").alias("node")).distinct())
        frontier, rows = cut_counted(step)
        if rows == 0:
            break
        found.append(_leveled(frontier, level))
    return _union(found, _leveled(frontier, 0))


def bfs(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, direction: str = "outgoing",
        rel_types=None, entity_types=None) -> DataFrame:
    """Reachable nodes except the root; entity types filter the result, not the walk."""
    found = reach(links(edges, direction, rel_types), seeds, S.clamp_depth(depth)).where("node <> root")
    typed = nodes.select(F.col("node_id").alias("node"), "entity_type")
    if entity_types:
        typed = typed.where(F.col("entity_type").isin(*entity_types))
    return found.join(typed, "node").select("root", "node", "depth", "entity_type")


def dfs(edges: DataFrame, seeds: DataFrame, depth: int = 3, direction: str = "outgoing", rel_types=None,
        max_rounds: int = 10_000) -> DataFrame:
    """(root, node, dfs_path): ordering by ``dfs_path`` within a root is depth-first discovery order.

    Children are taken in id order. A node's depth-first path is its smallest simple path inside
    the depth-bounded subgraph, and every prefix of such a path is the smallest path of its end, so
    one best path per node is kept and relaxed until nothing improves. Rounds follow the longest
    depth-first path; exceeding ``max_rounds`` raises instead of returning a partial order.
    """
    pairs = links(edges, direction, rel_types)
    members = reach(pairs, seeds, S.clamp_depth(depth), include_root=True).select("root", "node")
    inside = (pairs.join(members.withColumnRenamed("node", "src"), "src")
              .join(members.withColumnRenamed("node", "dst"), ["root", "dst"], "left_semi")
              .select("root", "src", "dst").distinct())
    inside, _ = cut_counted(inside)
    best, rows = cut_counted(seeds.select("root", F.col("root").alias("node"), F.array("root").alias("path")).distinct())
    changed = best
    for _ in range(max_rounds):
        if rows == 0:
            return best.select("root", "node", F.col("path").alias("dfs_path"))
        moved = small_side(changed.withColumnRenamed("node", "src"), rows)
        offers = (inside.join(moved, ["root", "src"]).where(~F.array_contains("path", F.col("dst")))
                  .groupBy("root", F.col("dst").alias("node"))
                  .agg(F.min(F.concat("path", F.array("dst"))).alias("offer")))
        merged, _ = cut_counted(best.join(offers, ["root", "node"], "full_outer").select(
            "root", "node", F.coalesce(F.least("path", "offer"), "path", "offer").alias("path"),
            (F.col("path").isNull() | (F.col("offer") < F.col("path"))).alias("improved")))
        best = merged.drop("improved")
        changed, rows = cut_counted(merged.where("improved").drop("improved"))
    raise RuntimeError("depth-first order did not settle within max_rounds")


def _discovered(group: pd.DataFrame) -> pd.DataFrame:
    """Depth-first discovery of one root's links: every node with its parent and its place in the order."""
    root = group["root"].iloc[0]
    names, codes = np.unique(np.concatenate([[root], group["src"].to_numpy(object), group["dst"].to_numpy(object)]).astype(str), return_inverse=True)
    src, dst = codes[1:len(group) + 1], codes[len(group) + 1:]
    by_source = np.lexsort((dst, src))
    targets = dst[by_source].tolist()
    begin = np.searchsorted(src[by_source], np.arange(len(names) + 1)).tolist()
    ahead, parent, order, stack = begin[:-1], {int(codes[0]): -1}, [int(codes[0])], [int(codes[0])]
    while stack:
        node = stack[-1]
        at, end = ahead[node], begin[node + 1]
        while at < end and targets[at] in parent:
            at += 1
        ahead[node] = at + 1
        if at < end:
            parent[targets[at]] = node
            order.append(targets[at])
            stack.append(targets[at])
        else:
            stack.pop()
    return pd.DataFrame({"root": root, "node": names[order], "parent": [None if parent[n] < 0 else names[parent[n]] for n in order],
                         "position": np.arange(1, len(order) + 1)})


def dfs_order(edges: DataFrame, seeds: DataFrame, depth: int = 3, direction: str = "outgoing", rel_types=None,
              task_edges: int = TASK_EDGES) -> DataFrame:
    """(root, node, parent, position): depth-first discovery order of the nodes within ``depth`` steps of each root, from 1.

    Children are taken in id order. Which nodes and links belong to a root is found level by level over all roots. Discovery
    itself is a sequence: a root whose links are counted to fit a task is walked there with an explicit stack, as many roots at
    once as there are tasks; a larger one goes through ``dfs``, whose rows never meet in one task.
    """
    pairs = links(edges, direction, rel_types)
    members = reach(pairs, seeds, S.clamp_depth(depth), include_root=True).select("root", "node")
    inside = (pairs.join(members.withColumnRenamed("node", "src"), "src")
              .join(members.withColumnRenamed("node", "dst"), ["root", "dst"], "left_semi").where("src <> dst")
              .select("root", "src", "dst").distinct())
    inside = stored(inside, "dfs-links")
    counts = stored(seeds.select("root").distinct().join(inside.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root", "left"), "dfs-sizes")
    none = F.lit(None).cast("string")
    found = counts.where("n is null").select("root", F.col("root").alias("node"), none.alias("parent"), F.lit(1).cast("long").alias("position"))
    fitting = inside.join(counts.where(F.col("n") <= task_edges).select("root"), "root", "left_semi")
    found = found.unionByName(fitting.groupBy("root").applyInPandas(_discovered, "root string, node string, parent string, position long"))
    large = counts.where(F.col("n") > task_edges).select("root")
    if not large.isEmpty():
        paths = dfs(edges, large, depth, direction, rel_types)
        rows = ranked(paths, ["root"], ["dfs_path"])
        found = found.unionByName(rows.select("root", "node", F.expr("if(size(dfs_path) > 1, dfs_path[size(dfs_path) - 2], null)").alias("parent"), "position"))
    return found


def traversal_edges(edges: DataFrame, members: DataFrame, root_only: bool = False) -> DataFrame:
    """Edges with both ends in a root's member set (root, node); ``root_only`` keeps those touching the root."""
    inside = (edges.join(members.select("root", F.col("node").alias("src")), "src")
              .join(members.select("root", F.col("node").alias("dst")), ["root", "dst"], "left_semi"))
    if root_only:
        inside = inside.where((F.col("src") == F.col("root")) | (F.col("dst") == F.col("root")))
    return inside.select("root", "src", "dst", "relationship_type")


def neighbors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row per edge at a root, tagged incoming or outgoing."""
    ends = F.array(
        F.struct(F.col("src").alias("root"), F.col("dst").alias("neighbor"), F.lit("outgoing").alias("direction")),
        F.struct(F.col("dst").alias("root"), F.col("src").alias("neighbor"), F.lit("incoming").alias("direction")))
    return (edges.select(F.explode(ends).alias("e"), "relationship_type").select("e.*", "relationship_type")
            .join(seeds.select("root").distinct(), "root", "left_semi"))


def neighbors_report(edges: DataFrame, seeds: DataFrame, most: int = 500) -> DataFrame:
    """The first ``most`` neighbours per root and direction, in id order."""
    return top_per_group(neighbors(edges, seeds), ["root", "direction"],
                         [F.col("neighbor"), F.col("relationship_type")], most)


def node_detail(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """A node's edges with direction and the neighbour's type and name."""
    other = nodes.select(F.col("node_id").alias("neighbor"), F.col("entity_type").alias("neighbor_type"),
                         F.col("name").alias("neighbor_name"))
    return neighbors(edges, seeds).join(other, "neighbor", "left")


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "both",
                 rel_types=None, entity_types=None, mode: str = "bfs") -> tuple[DataFrame, DataFrame]:
    """Nodes around each root and the edges among them (root included)."""
    if mode == "dfs":
        walked = dfs(edges, seeds, depth, direction, rel_types).where("node <> root")
        typed = nodes.select(F.col("node_id").alias("node"), "entity_type")
        found = walked.join(typed, "node")
        if entity_types:
            found = found.where(F.col("entity_type").isin(*entity_types))
    else:
        found = bfs(nodes, edges, seeds, depth, direction, rel_types, entity_types)
    members = found.select("root", "node").unionByName(seeds.select("root", F.col("root").alias("node")).distinct())
    return found, traversal_edges(edges, members)


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes at distance 0..depth and all edges with both ends among them."""
    members = reach(links(edges), seeds, S.clamp_depth(depth), include_root=True)
    return members, traversal_edges(edges, members)


def expand_neighbors(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Distinct 1-hop neighbours, both ways, of a node set."""
    both = links(edges, "both")
    return both.join(selected.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi").select(
        F.col("dst").alias("node_id")).distinct()


def edges_within(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with both ends in a given node set."""
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(selected.select(F.col("node_id").alias(end)).distinct(), end, "left_semi")
    return kept.select(*edges.columns)


def _nodes_within(hashed: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node): hashes of the nodes within ``depth`` steps of any start, or a few steps more. A job walks several levels, whose shuffle of the links is shared."""
    frontier, rows = cut_counted(start.distinct())
    seen = [frontier]
    while rows and depth > 0:
        current, walked = frontier, []
        for level in range(min(PRUNE_HOPS, depth)):
            current = hashed.join(current.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
            walked.append(_leveled(current, level))
        first = _union(walked, frontier).groupBy("node").agg(F.min("depth").alias("depth"))
        fresh, _ = cut_counted(first.join(_union(seen, frontier), "node", "left_anti"))
        seen.append(fresh.select("node"))
        frontier, rows = cut_counted(fresh.where(F.col("depth") == len(walked) - 1).select("node"))
        depth -= len(walked)
    return _union(seen, frontier)


def _useful_links(step_links: DataFrame, asked: DataFrame, max_depth: int) -> DataFrame:
    """Links that can lie on a path of some asked pair: their start is in reach of a start, and an end in reach of theirs.

    Nodes are told apart by hashes, whatever pair they belong to. Two nodes of one hash keep a link too many, never lose one.
    """
    kept = step_links.withColumn("s", F.xxhash64("src")).withColumn("d", F.xxhash64("dst"))
    for start, near, far in (("b", "d", "s"), ("a", "s", "d")):
        walk = kept.select(F.col(near).alias("src"), F.col(far).alias("dst"))
        inside = _nodes_within(walk, asked.select(F.xxhash64(start).alias("node")), max_depth)
        kept = stored(kept.join(inside.withColumnRenamed("node", "s"), "s", "left_semi").join(inside.withColumnRenamed("node", "d"), "d", "left_semi").select("src", "dst", "s", "d"), "path-useful")
    return kept.select("src", "dst")


def _meet(step_links: DataFrame, asked: DataFrame, rows: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Levels met from both ends of each asked (pair, a, b), and where they meet.

    (pair, ahead, node, depth): nodes by their distance from a (ahead) or to b; (pair, p, q): the levels at which the two met, so that
    a shortest path has p + q steps. In each round the side of a pair with fewer nodes on its last level grows by one.
    """
    both = stored(step_links.select(F.explode(F.array(
        F.struct(F.lit(True).alias("ahead"), "src", "dst"), F.struct(F.lit(False).alias("ahead"), F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*"), "path-links")
    ends = F.explode(F.array(F.struct(F.lit(True).alias("ahead"), F.col("a").alias("node")), F.struct(F.lit(False).alias("ahead"), F.col("b").alias("node")))).alias("e")
    seen = cut(asked.select("pair", ends).select("pair", "e.ahead", "e.node", F.lit(0).alias("depth")))
    open_, columns = asked.select("pair", F.lit(0).alias("p"), F.lit(0).alias("q")), ["pair", "ahead", "node", "depth"]
    levels, last, met = [seen], seen, []
    for _ in range(max_depth):
        sizes = last.groupBy("pair").agg((F.count_if(F.col("ahead")) <= F.count_if(~F.col("ahead"))).alias("turn"))
        edge = last.join(sizes, "pair").where(F.col("ahead") == F.col("turn")).withColumnRenamed("node", "src")
        offers = both.join(edge, ["ahead", "src"]).groupBy("pair", "ahead", F.col("dst").alias("node")).agg((F.min("depth") + 1).alias("depth"))
        # offers of a pair are on one side: those seen there before drop out, those seen on the other side are where the two meet
        every = _union(levels, seen).join(small_side(open_.select("pair"), rows), "pair", "left_semi")
        both_kinds = offers.select(*columns, F.lit(None).cast("boolean").alias("known")).unionByName(
            every.select("pair", F.lit(None).cast("boolean").alias("ahead"), "node", F.lit(None).cast("int").alias("depth"), F.col("ahead").alias("known")))
        judged = both_kinds.groupBy("pair", "node").agg(F.max("ahead").alias("ahead"), F.max("depth").alias("depth"), F.collect_set("known").alias("known")).where(
            "ahead is not null and not array_contains(known, ahead)")
        fresh, found = stored_observed(judged.select(*columns, (F.size("known") > 0).alias("hit")), "path-fresh", rows=F.count(F.lit(1)))
        if not found["rows"]:
            break
        levels.append(fresh.select(*columns))
        grown = fresh.groupBy("pair").agg(F.first("ahead").alias("side"), F.max("depth").alias("to"), F.max("hit").alias("hit"))
        state = open_.join(grown, "pair").select("pair", F.expr("if(side, to, p)").alias("p"), F.expr("if(side, q, to)").alias("q"), "side", "hit")
        state, measured = stored_observed(state, "path-state", left=F.count_if((~F.col("hit")) & (F.col("p") + F.col("q") < max_depth)))
        met.append(state.where("hit").select("pair", "p", "q"))
        rows = measured["left"]
        if not rows:
            break
        open_ = state.where(f"not hit and p + q < {max_depth}")
        going = small_side(open_.select("pair", "side"), rows)
        # the side that grew goes on from its new level, the other one from where it stood
        kept = last.join(going, "pair").where("ahead <> side").select(*columns)
        # written out: a checkpoint would carry its plan's constraints along, which double each round
        last = stored(kept.unionByName(fresh.select(*columns).join(going.select("pair"), "pair", "left_semi")), "path-last")
        open_ = open_.select("pair", "p", "q")
    return _union(levels, seen), _union(met, asked.select("pair", F.lit(0).alias("p"), F.lit(0).alias("q")).limit(0))


def shortest_path(edges: DataFrame, pairs: DataFrame, max_depth: int = 6) -> DataFrame:
    """(src, dst, length, path) for asked (src, dst) pairs; ties go to the smallest path.

    For many pairs, links that lie on no path between any start and any end are dropped first. A search runs from both ends, the one
    with the smaller frontier first, and only distances are kept of what it meets. A pair that has one node on each of its levels
    has its path with them. For the others, the levels of the first half are walked back from where the two meet to find the nodes on
    shortest paths; then each pair steps along them, the smallest next node first. Frontiers hold no paths.
    """
    max_depth = S.clamp_depth(max_depth)
    step_links = stored(links(edges).where("src <> dst").select("src", "dst").distinct(), "path-steps")
    asked, measured = stored_observed(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct()
                                      .withColumn("pair", F.monotonically_increasing_id()), "path-pairs", rows=F.count(F.lit(1)))
    if measured["rows"] > PRUNE_PAIRS:
        step_links = _useful_links(step_links, asked, max_depth)
    levels, met = _meet(step_links, asked, measured["rows"], max_depth)
    met, found = cut_counted(met)
    if not found:
        return asked.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0).alias("length"), F.array("a").alias("path")).limit(0)
    levels = stored(levels.join(met, "pair"), "path-levels")
    far = levels.where("not ahead")
    middle = levels.where("ahead and depth = p").join(far.where("depth = q").select("pair", "node"), ["pair", "node"], "left_semi").select("pair", "node", "depth")
    rest = far.where("depth < q").select("pair", "node", (F.col("p") + F.col("q") - F.col("depth")).alias("at"))
    near = levels.where("ahead and depth < p").select("pair", "node", "depth")
    nodes = stored(near.unionByName(middle).withColumnRenamed("depth", "at").unionByName(rest), "path-nodes")
    several = met.join(nodes.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair").where("n > p + q + 1").select("pair", "p", "q")
    several, more = cut_counted(several)
    on_path = nodes.join(small_side(several.select("pair"), more), "pair", "left_anti")
    if more:
        on_path = on_path.unionByName(_smallest_steps(step_links, asked, several, near, middle, rest))
    path = F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda s: s["node"])
    found = on_path.groupBy("pair").agg(F.max("at").alias("length"), path.alias("path"))
    return found.join(asked, "pair").select(F.col("a").alias("src"), F.col("b").alias("dst"), "length", "path")


def _smallest_steps(step_links: DataFrame, asked: DataFrame, met: DataFrame, near: DataFrame, middle: DataFrame, rest: DataFrame) -> DataFrame:
    """(pair, node, at): the nodes of the smallest shortest path of each pair in ``met``, of those that ``shortest_path`` found on its levels."""
    pairs = met.select("pair")
    longest = met.agg(F.max("p").alias("p"), F.max(F.col("p") + F.col("q")).alias("d")).first()
    current = cut(middle.join(pairs, "pair", "left_semi"))
    useful = [current]
    for _ in range(longest.p):
        back = step_links.join(current.withColumnRenamed("node", "dst"), "dst").select("pair", F.col("src").alias("node"), (F.col("depth") - 1).alias("depth")).distinct()
        current = cut(back.join(near, ["pair", "node", "depth"], "left_semi"))
        useful.append(current)
    allowed = stored(_union(useful, current).withColumnRenamed("depth", "at").unionByName(rest.join(pairs, "pair", "left_semi")), "path-allowed")
    step = asked.join(pairs, "pair", "left_semi").select("pair", F.col("a").alias("node"), F.lit(0).alias("at"))
    steps = [step]
    for _ in range(longest.d):
        ahead = step_links.join(step.withColumnRenamed("node", "src"), "src").select("pair", F.col("dst").alias("node"), (F.col("at") + 1).alias("at"))
        step = cut(ahead.join(allowed, ["pair", "node", "at"], "left_semi").groupBy("pair", "at").agg(F.min("node").alias("node")).select("pair", "node", "at"))
        steps.append(step)
    return _union(steps, step)


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The hops of each path with the relationship types that connect them."""
    hop = F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("position", "hop_src")
    hops = paths.select("src", "dst", "path", hop).withColumn("hop_dst", F.element_at("path", F.col("position") + 2))
    types = edges.select(F.col("src").alias("hop_src"), F.col("dst").alias("hop_dst"), "relationship_type").distinct()
    return hops.join(types, ["hop_src", "hop_dst"]).select("src", "dst", "position", "hop_src", "hop_dst", "relationship_type")


def all_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 5) -> DataFrame:
    """All simple directed paths of at most ``max_depth`` steps: (src, dst, length, path).

    A path only grows into nodes that can still reach the target in the steps left, so no dead end
    is expanded.
    """
    max_depth = S.clamp_depth(max_depth)
    step_links = links(edges)
    asked = pairs.select("src", "dst").where("src <> dst").distinct()
    targets = asked.select(F.col("dst").alias("root")).distinct()
    remaining, _ = cut_counted(reach(links(edges, "incoming"), targets, max_depth, include_root=True).select(
        F.col("root").alias("b"), F.col("node"), F.col("depth").alias("left")))
    frontier, rows = cut_counted(asked.select(
        F.col("src").alias("a"), F.col("dst").alias("b"), F.col("src").alias("node"), F.array("src").alias("path")))
    found = []
    for level in range(1, max_depth + 1):
        step = (step_links.join(small_side(frontier, rows), step_links["src"] == frontier["node"])
                .where(~F.array_contains("path", F.col("dst")))
                .select("a", "b", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).distinct())
        useful = step.join(remaining.where(F.col("left") <= max_depth - level), ["b", "node"], "left_semi")
        grown, rows = cut_counted(useful)
        if rows == 0:
            break
        found.append(grown.where("node = b").select(
            F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(level).alias("length"), "path"))
        frontier, rows = cut_counted(grown.where("node <> b"))
        if rows == 0:
            break
    empty = frontier.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0).alias("length"), "path")
    return _union(found, empty)


def all_paths_report(paths: DataFrame, max_paths: int = V.MAX_PATHS) -> DataFrame:
    """The first ``max_paths`` paths per pair by length then path, with full count and shortest length."""
    listed = top_per_group(paths, ["src", "dst"], [F.col("length"), F.col("path")], max_paths)
    totals = paths.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("total_paths"), F.min("length").alias("shortest_length"))
    return listed.join(totals, ["src", "dst"])


def chain(edges: DataFrame, seeds: DataFrame, rel_types, out_role: str, in_role: str, max_depth: int = V.MAX_DEPTH,
          transitive_in: bool = True) -> DataFrame:
    """(root, role, node): direct neighbours both ways and nodes at walk length 2..max_depth.

    Both directions advance in one loop, told apart by their role. Transitive roles exclude the root
    but may repeat direct neighbours and nodes on cycles.
    """
    kept = edges.where(S.edge_type(F.col("relationship_type")).isin(*S.known_edge_types(rel_types)))
    ends = F.array(F.struct(F.lit(out_role).alias("role"), "src", "dst"),
                   F.struct(F.lit(in_role).alias("role"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    pairs = kept.select(F.explode(ends).alias("e")).select("e.*")
    roles = F.explode(F.array(F.lit(out_role), F.lit(in_role)))
    frontier, rows = cut_counted(seeds.select("root", roles.alias("role"), F.col("root").alias("src")).distinct())
    found = []
    for level in range(1, S.clamp_depth(max_depth) + 1):
        step = pairs.join(small_side(frontier, rows), ["role", "src"]).select("root", "role", F.col("dst").alias("src")).distinct()
        frontier, rows = cut_counted(step)
        if rows == 0:
            break
        found.append(_leveled(frontier, level))
        if level == 1 and not transitive_in:
            frontier = frontier.where(F.col("role") == out_role)
    levels = _union(found, _leveled(frontier, 0)).withColumnRenamed("src", "node")
    direct = levels.where("depth = 1").select("root", "role", "node")
    far = levels.where("depth > 1 and node <> root").select("root", F.concat(F.lit("transitive_"), "role").alias("role"), "node")
    return direct.unionByName(far.distinct())


def dependency_chain(edges: DataFrame, seeds: DataFrame, max_depth: int = V.MAX_DEPTH) -> DataFrame:
    return chain(edges, seeds, V.DEPENDENCY_CHAIN_TYPES, "dependency", "dependent", max_depth, transitive_in=False)


def call_chain(edges: DataFrame, seeds: DataFrame, max_depth: int = V.MAX_DEPTH) -> DataFrame:
    return chain(edges, seeds, ["CALLS"], "callee", "caller", max_depth)


def import_chain(edges: DataFrame, seeds: DataFrame, max_depth: int = V.MAX_DEPTH) -> DataFrame:
    return chain(edges, seeds, ["IMPORTS"], "importee", "importer", max_depth)


def inheritance_chain(edges: DataFrame, seeds: DataFrame, max_depth: int = V.MAX_DEPTH) -> DataFrame:
    return chain(edges, seeds, ["INHERITS"], "superclass", "subclass", max_depth)


def chain_counts(chain_rows: DataFrame) -> DataFrame:
    return chain_rows.groupBy("root", "role").agg(F.count(F.lit(1)).alias("node_count"))


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int = 4, rel_types=None) -> DataFrame:
    """(root, node, depth, impact): nodes that depend on the root, direct at depth 1."""
    found = reach(links(edges, "incoming", rel_types), seeds, S.clamp_depth(max_depth))
    return found.withColumn("impact", F.when(F.col("depth") == 1, "direct").otherwise("indirect"))


def blast_counts(edges: DataFrame, seeds: DataFrame, max_depth: int | None = 4, rel_types=None) -> DataFrame:
    """(root, depth, node_count): how many nodes depend on each of many roots, by distance, without a row for each of them."""
    return packed_reach(links(edges, "incoming", rel_types), seeds, max_depth).counts().where("depth > 0")


def blast_levels(radius: DataFrame) -> DataFrame:
    return radius.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("node_count"))


def dependency_tree(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Outgoing expansion as path rows: (root, depth, parent, node, relationship_type, path).

    An ancestor is never repeated on its own path; parallel edges of different types give one
    branch each.
    """
    hops = edges.select("src", "dst", "relationship_type")
    frontier, rows = cut_counted(seeds.select("root", F.col("root").alias("node"), F.array("root").alias("path")).distinct())
    found = []
    for level in range(1, S.clamp_depth(depth) + 1):
        step = (hops.join(small_side(frontier, rows), hops["src"] == frontier["node"])
                .where(~F.array_contains("path", F.col("dst")))
                .select("root", F.lit(level).alias("depth"), F.col("src").alias("parent"), F.col("dst").alias("node"),
                        "relationship_type", F.concat("path", F.array("dst")).alias("path")))
        grown, rows = cut_counted(step)
        if rows == 0:
            break
        found.append(grown)
        frontier = grown.select("root", "node", "path")
    empty = frontier.select("root", F.lit(0).alias("depth"), F.col("node").alias("parent"), "node",
                            F.lit("").alias("relationship_type"), "path")
    return _union(found, empty)


def smallest_paths(pairs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth, path): the smallest among the shortest paths to every node in reach."""
    step_links = pairs
    frontier, rows = cut_counted(seeds.select("root", F.col("root").alias("node"), F.array("root").alias("path")).distinct())
    seen, found = [frontier.select("root", "node")], [_leveled(frontier, 0)]
    for level in range(1, depth + 1):
        step = (step_links.join(small_side(frontier, rows), step_links["src"] == frontier["node"])
                .groupBy("root", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path")))
        frontier, rows = cut_counted(step.join(_union(seen, seen[0]), ["root", "node"], "left_anti"))
        if rows == 0:
            break
        seen.append(frontier.select("root", "node"))
        found.append(_leveled(frontier, level))
    return _union(found, _leveled(frontier, 0))


def request_flows(components: DataFrame, edges: DataFrame, max_entries: int = V.MAX_FLOW_ENTRIES,
                  max_nodes: int = V.MAX_FLOW_NODES) -> DataFrame:
    """Inferred request flows: from each entry component the first longest shortest path.

    Entries are the first components of the entry layers per repository by (entity type, label, id).
    """
    layers = components.select(F.col("node_id").alias("node"), "layer")
    entries = top_per_group(components.where(F.col("layer").isin(*V.ENTRY_LAYERS)), ["repository_id"],
                            [F.col("entity_type"), F.col("name"), F.col("node_id")], max_entries)
    entries, _ = cut_counted(entries.select("repository_id", F.col("node_id").alias("root"), "name",
                                            F.col("layer").alias("entry_layer")))
    ids = components.select("node_id")
    inner = stored(links(edges_within(edges.select("src", "dst", "relationship_type"), ids)), "component-links")
    reached = smallest_paths(inner, entries, max_nodes - 1)
    best = reached.groupBy("root").agg(F.min_by("path", F.struct(-F.col("depth"), F.col("path"))).alias("path"))
    steps = best.select("root", F.posexplode("path").alias("position", "node")).join(layers, "node")
    ordered = steps.groupBy("root").agg(F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "layer"))), lambda s: s["layer"])).alias("layers"))
    flows = entries.join(best, "root").join(ordered, "root")
    enough = (F.size("layers") >= 2) | (F.col("entry_layer") == "api")
    return flows.where(enough).select(
        "repository_id", F.col("root").alias("entry_node"), F.concat("name", F.lit(" request flow")).alias("name"),
        "path", "layers", F.when(F.size("layers") >= 3, 0.7).otherwise(0.5).alias("confidence"))
