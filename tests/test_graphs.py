"""Graph operators against hand-made graphs and brute force on random ones."""

import itertools
import random

import pytest

from sourceloom.operators import components as K
from sourceloom.operators import traverse as T


def frames(spark, ids, pairs, kind="calls"):
    nodes = spark.createDataFrame([("r", n, "function") for n in ids], "repository_id string, node_id string, entity_type string")
    edges = spark.createDataFrame([(a, b, kind) for a, b in pairs], "src string, dst string, relationship_type string")
    return nodes, edges


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


COMPONENTS = [
    ([], [], 0), ("1", [], 1), ("12", [], 1), ("12", ["12"], 2), ("12345", ["12", "23", "45"], 3), ("12345", ["12", "23", "34", "45", "51"], 5),
    ("12345", ["12", "23", "34", "45"], 5), ("12345", ["12", "13", "14", "15"], 5), ("12345", ["12", "23", "34"], 4), ("12", ["11", "12"], 2), ("12", ["12", "19"], 2)]


def test_component_sizes(spark):
    """All hand-made graphs in one job, each under its own prefix."""
    ids = [f"{g}{n}" for g, (names, _, _) in zip("abcdefghijk", COMPONENTS) for n in names]
    pairs = [(f"{g}{p[0]}", f"{g}{p[1]}") for g, (_, links, _) in zip("abcdefghijk", COMPONENTS) for p in links]
    nodes, edges = frames(spark, ids, pairs)
    sizes = {}
    for row in K.component_sizes(K.connected_components(nodes, edges)).collect():
        sizes[row["component"][0]] = max(sizes.get(row["component"][0], 0), row["size"])
    assert [sizes.get(g, 0) for g in "abcdefghijk"] == [want for _, _, want in COMPONENTS]


@pytest.mark.parametrize("pairs, order", [
    (["99"], "1"), (["12", "23", "34"], "1234"), (["12", "13", "24", "25", "36"], "124536"), (["12", "23", "24", "31"], "1234"), (["12", "34"], "12")])
def test_depth_first_order(spark, pairs, order):
    _, edges = frames(spark, "1", [tuple(p) for p in pairs])
    found = T.dfs(edges, seeds(spark, "1"), depth=8).orderBy("dfs_path").collect()
    assert "".join(r["node"] for r in found) == order


def random_graph(seed, size=9, links=16):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(size)]
    return ids, sorted({(a, b) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(links)) if a != b})


def distances(ids, pairs, start):
    found, frontier = {start: 0}, [start]
    while frontier:
        frontier = sorted({b for a, b in pairs if a in frontier and b not in found})
        found.update({n: max(found.values()) + 1 for n in frontier})
    return found


def ordered_dfs(pairs, start):
    order, stack = [], [start]
    while stack:
        node = stack.pop()
        if node not in order:
            order.append(node)
            stack += sorted((b for a, b in pairs if a == node), reverse=True)
    return order


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graph(spark, seed):
    ids, pairs = random_graph(seed)
    nodes, edges = frames(spark, ids, pairs)
    every = seeds(spark, *ids)
    dist = {n: distances(ids, pairs, n) for n in ids}
    got = {(r["root"], r["node"]): r["depth"] for r in T.reach(T.links(edges), every, 8, include_root=True).collect()}
    assert got == {(a, b): d for a in ids for b, d in dist[a].items()}

    first = T.dfs(edges, seeds(spark, ids[0]), depth=8).orderBy("dfs_path").collect()
    assert [r["node"] for r in first] == ordered_dfs(pairs, ids[0])
    for most in (1000, 12, 0):  # walked in tasks, some of them, or none
        order = {}
        for r in T.dfs_order(edges, every, depth=8, task_edges=most).orderBy("position").collect():
            order.setdefault(r["root"], []).append((r["node"], r["parent"], r["position"]))
        for start in ids:
            assert [n for n, _, _ in order[start]] == ordered_dfs(pairs, start) and [p for _, _, p in order[start]] == list(range(1, len(order[start]) + 1))
            place = {n: p for n, _, p in order[start]}
            assert all((n == start) if parent is None else ((parent, n) in pairs and place[parent] < place[n]) for n, parent, _ in order[start])

    scc = {r["node"]: r["scc"] for r in K.strong_components(edges.select("src", "dst")).collect()}
    want = {a: min(b for b in ids if b in dist[a] and a in dist[b]) for a in ids if any(b != a and b in dist[a] and a in dist[b] for b in ids)}
    assert scc == want

    rings = set()
    for length in range(2, 6):
        for ring in itertools.permutations(ids, length):
            if ring[0] == min(ring) and all((a, b) in pairs for a, b in zip(ring, ring[1:] + ring[:1])):
                rings.add(frozenset(ring))
    assert {frozenset(r["cycle_path"]) for r in K.cycles(edges, nodes).collect()} == rings

    every = [tuple(r["cycle_path"]) for r in K.cycles_witness(edges, nodes).collect()]
    on_cycles = {(a, b) for a, b in pairs if a in dist[b]}
    assert all(len(set(c)) == len(c) and c[0] == min(c) and set(zip(c, c[1:] + c[:1])) <= set(pairs) for c in every)
    assert sum(r["links"] for r in K.cycles_witness(edges, nodes).collect()) == len(on_cycles)
    assert len({frozenset(c) for c in every}) == len(every)

    assert K.dependency_depth(nodes, edges).first()["dependency_depth"] == max(max(d.values()) for d in dist.values())
    assert K.dependency_depth(nodes, edges, batches=3).first()["dependency_depth"] == max(max(d.values()) for d in dist.values())

    asked = spark.createDataFrame([(ids[0], n) for n in ids[1:]], "src string, dst string")
    paths = [p for k in range(2, 6) for p in itertools.permutations(ids, k) if p[0] == ids[0] and all(h in pairs for h in zip(p, p[1:]))]
    assert {tuple(r["path"]) for r in T.all_paths(edges, asked, 4).collect()} == set(paths)
    best = {r["dst"]: list(r["path"]) for r in T.shortest_path(edges, asked, 8).collect()}
    assert {d: len(p) - 1 for d, p in best.items()} == {n: d for n, d in dist[ids[0]].items() if d}
    for target, path in best.items():
        options = [list(p) for p in paths if p[-1] == target and len(p) == len(path)]
        assert not options or path == min(options)


def test_witness_cycles_of_any_length(spark):
    """A ring of forty with a chord, a pair, and a path: every link of the rings has a witness, the path has none."""
    ring = [f"r{i:02}" for i in range(40)]
    pairs = list(zip(ring, ring[1:] + ring[:1])) + [("r30", "r05"), ("a", "b"), ("b", "a"), ("b", "r00"), ("x", "y"), ("x", "x")]
    nodes, edges = frames(spark, [*ring, *"abxy"], pairs)
    found = {tuple(r["cycle_path"]): (r["length"], r["links"], r["severity"]) for r in K.cycles_witness(edges, nodes).collect()}
    assert found == {("a", "b"): (2, 2, "high"), tuple(ring): (40, 40, "medium"), tuple(ring[5:31]): (26, 1, "medium")}


def test_dense_depth_first_order(spark):
    """A dense graph, where the order is one path through nearly all nodes."""
    rng = random.Random(3)
    ids = [f"n{i:03}" for i in range(300)]
    pairs = sorted({(a, b) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(4000)) if a != b})
    _, edges = frames(spark, ids, pairs)
    found = T.dfs_order(edges, seeds(spark, "n000", "absent"), depth=8).orderBy("root", "position").collect()
    assert [r["node"] for r in found] == ["absent", *ordered_dfs(pairs, "n000")]


def test_ranked_rows_of_a_hot_group(spark):
    from pyspark.sql import functions as F

    from sourceloom.functions.ranking import ranked
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, F.col("id").cast("string")).alias("g"), F.xxhash64("id").alias("v"))
    got = ranked(rows, ["g"], ["v"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["v"], r["position"]))
    assert len(got) == 5000 and all([p for _, p in sorted(v)] == list(range(1, len(v) + 1)) for v in groups.values())


def test_chain_keeps_cycles_and_repeats(spark):
    _, edges = frames(spark, "1234", [("1", "2"), ("2", "3"), ("3", "1"), ("1", "3")])
    rows = {(r["role"], r["node"]) for r in T.call_chain(edges, seeds(spark, "1"), 4).collect()}
    assert rows == {("callee", "2"), ("callee", "3"), ("transitive_callee", "2"), ("transitive_callee", "3"),
                    ("caller", "3"), ("transitive_caller", "2"), ("transitive_caller", "3")}


def test_empty_and_missing_roots(spark):
    nodes, edges = frames(spark, "12", [("1", "2")])
    assert T.bfs(nodes, edges, seeds(spark, "9"), 3).count() == 0
    assert T.dependency_tree(edges, seeds(spark, "9"), 3).count() == 0
    assert K.strong_components(edges.select("src", "dst")).count() == 0


def test_neighborhood_modes_agree(spark):
    nodes, edges = frames(spark, "12345", [("1", "2"), ("2", "3"), ("3", "4"), ("5", "1")])
    for mode in ("bfs", "dfs"):
        found, inner = T.neighborhood(nodes, edges, seeds(spark, "1"), 2, "both", mode=mode)
        assert {r["node"] for r in found.collect()} == {"2", "3", "5"}
        assert {(r["src"], r["dst"]) for r in inner.collect()} == {("1", "2"), ("2", "3"), ("5", "1")}


def test_hub_holding_most_edges(spark):
    """A hub with most of the edges gives whole results."""
    spokes = [f"s{i}" for i in range(400)]
    nodes, edges = frames(spark, ["hub", *spokes], [("hub", s) for s in spokes] + [(s, "hub") for s in spokes[:50]])
    assert T.reach(T.links(edges), seeds(spark, "s0"), 2).count() == 400
    assert T.neighbors_report(edges, seeds(spark, "hub"), 500).count() == 450
    assert K.component_sizes(K.connected_components(nodes, edges)).first()["size"] == 401


def test_impact_edges_stay_with_their_root(spark):
    """Two roots whose affected nodes are linked with each other: only links among one root's own nodes count."""
    from sourceloom.operators import impact as I
    nodes = spark.createDataFrame([(n, "file", f"src/{n}.{'py' if n < 'd' else 'ts'}") for n in "abcdef"], "node_id string, entity_type string, file_path string")
    edges = spark.createDataFrame([(a, b, "imports") for a, b in ("ba", "ca", "cb", "ed", "fd", "fe", "be")], "src string, dst string, relationship_type string")
    radius = T.blast_radius(edges, seeds(spark, "a", "d"), 1)
    kept, inner = I.impact_graph(radius, nodes, edges, 1)
    assert {(r["root"], r["node"]) for r in kept.collect()} == {("a", "b"), ("a", "c"), ("d", "e"), ("d", "f")}
    assert {(r["root"], r["src"], r["dst"]) for r in inner.collect()} == {("a", "c", "b"), ("d", "f", "e")}
    risks = spark.createDataFrame([("b", "High"), ("c", "High"), ("f", "Low")], "node_id string, risk string")
    kept, inner = I.impact_graph(radius, nodes, edges, 1, risks=risks, risk="High", language="Python")
    assert {r["node"] for r in kept.collect()} == {"b", "c"} and [r["root"] for r in inner.collect()] == ["a"]
