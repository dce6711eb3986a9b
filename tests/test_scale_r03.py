"""What the steps of the source graph and of the components write, and that they give the same rows."""

import ast
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from sourceloom.functions import scalars as S
from sourceloom.operators import graph_build as G
from sourceloom.operators import symbols as X
from sourceloom.plans.analysis import analyze, build_graph
from sourceloom.session import checkpoint_folder


def _written(spark, name):
    return set(Path(checkpoint_folder(spark).removeprefix("file:")).glob(f"{name}-*"))


def test_tables_are_written_when_asked_for(spark):
    text = "import os\nclass A(base.B):\n    def f(self, x: mod.C[int] = 'a') -> None:\n        pass\n"
    raw = spark.createDataFrame([("r", "p/a.py", bytearray(text.encode()))], "repository_id string, path string, content binary")
    files, edges = _written(spark, "files"), _written(spark, "edges")
    run = analyze(raw)
    assert run.functions.select("return_type").first()[0] == "None"
    assert _written(spark, "files") == files
    graph = build_graph(run)
    assert graph.nodes.where("entity_type = 'class'").count() == 1
    assert _written(spark, "edges") == edges
    found = {(r["src"], r["dst"], r["relationship_type"]) for r in graph.edges.collect()}
    assert ("r/file:p/a.py", "r/package:os", "imports") in found and ("r/package:os", "r/file:p/a.py", "imported_by") in found
    assert all(r["lines"] == ([1] if "import" in r["relationship_type"] else []) for r in graph.edges.collect())


def test_plain_expressions_read_as_unparsed():
    for text in ("a", "a.b.c", "1", "True", "None", "'x'", "\"it's\"", "a.b[c]", "a[1]", "a['q'][d.e]", "u'x'", "f(1)", "a[1, 2]", "1.5", "...", "b'x'", "1 .real", "-1"):
        node = ast.parse(text, mode="eval").body
        assert X._source(node) == ast.unparse(node)
    assert X._plain(ast.parse("a.b[c]", mode="eval").body) == "a.b[c]"


def test_types_are_not_sorted_before_writing(spark):
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= 8


def test_connected_components_carry_numbers_and_give_smallest_names(spark):
    from sourceloom.operators import components as K

    rings = [(f"{g}{i}", f"{g}{(i + 1) % 4}") for g in "abc" for i in range(4)]
    links = rings + rings[:3] + [("a0", "b2"), ("b1", "z"), ("y", "c3"), ("z", "z"), (None, "a0"), ("a0", None)]
    edges = spark.createDataFrame(links, "src string, dst string")
    names = [f"{g}{i}" for g in "abc" for i in range(4)] + ["a0", "z", "y", "x", None]
    nodes = spark.createDataFrame([(n,) for n in names], "node_id string")
    weak = sorted(((r["node_id"], r["component"]) for r in K.connected_components(nodes, edges).collect()), key=str)
    expected = {(n, None if n is None else n if n == "x" else "a0" if n[0] in "abz" else "c0") for n in names}
    assert set(weak) == expected and len(weak) == len(expected)
    numbers = K._numbered(nodes.select(nodes.node_id.alias("node")).distinct(), "node")
    assert dict(numbers.dtypes)["id"] == "bigint"


def _digraph(seed, size, links):
    import random

    rng = random.Random(seed)
    ids = [f"n{i:02}" for i in range(size)]
    pairs = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(links)})
    seen = {a: {b for x, b in pairs if x == a} for a in ids}
    for _ in ids:
        seen = {a: s.union(*[seen[b] for b in s]) for a, s in seen.items()}
    return ids, pairs, seen


def test_many_links_are_peeled_and_walked_one_level_a_job(spark, monkeypatch):
    """The loops for many links give the components of brute force: a knot, a ring, a path and null ends beside them."""
    from sourceloom.operators import components as K

    ids, pairs, seen = _digraph(5, 16, 26)
    path, ring = [f"p{i:02}" for i in range(5)], ["r0", "r1", "r2"]
    more = list(zip(path, path[1:])) + list(zip(ring, ring[1:] + ring[:1])) + [("r1", "p00"), ("p04", "n00"), (None, "r0")]
    edges = spark.createDataFrame(pairs + more + pairs[:5], "src string, dst string")
    want = {a: min(b for b in ids if b in seen[a] and a in seen[b]) for a in ids if any(b != a and b in seen[a] and a in seen[b] for b in ids)} | dict.fromkeys(ring, "r0")
    monkeypatch.setattr(K, "LARGE_LINKS", 0)
    got = K.strong_components(edges).collect()
    assert {r["node"]: r["scc"] for r in got} == want and len(got) == len(want)
    typed = edges.selectExpr("src", "dst", "'imports' as relationship_type")
    nodes = spark.createDataFrame([(n, "file") for n in [*ids, *ring]], "node_id string, entity_type string")
    links = {(a, b) for a, b in pairs + more if a in want and want[a] == want.get(b) and a != b}
    witness = K.cycles_witness(typed, nodes).collect()
    assert sum(r["links"] for r in witness) == len(links)
    assert all(set(zip(r["cycle_path"], r["cycle_path"][1:] + r["cycle_path"][:1])) <= links and r["cycle_path"][0] == min(r["cycle_path"]) for r in witness)


def test_cycles_are_met_halfway(spark):
    """All cycles of two to six nodes of a dense graph, from ways of at most half their length."""
    import itertools

    from sourceloom.operators import components as K

    ids, pairs, _ = _digraph(7, 8, 60)
    nodes = spark.createDataFrame([(n, "file" if n < "n04" else "class") for n in ids], "node_id string, entity_type string")
    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, relationship_type string")
    for most in (1, 5, 6):
        best = {}
        for length in range(2, most + 1):
            for ring in itertools.permutations(ids, length):
                if ring[0] == min(ring) and all(p in pairs for p in zip(ring, ring[1:] + ring[:1])):
                    best[frozenset(ring)] = min(best.get(frozenset(ring), ring), ring)
        before = _written(spark, "ways")
        rows = K.cycles(edges, nodes, most).collect()
        assert sorted(tuple(r["cycle_path"]) for r in rows) == sorted(best.values())
        assert all(r["length"] == len(r["cycle_path"]) and r["severity"] == ("high" if r["length"] < 4 else "medium") for r in rows)
        kinds = {tuple(r["cycle_path"]): r["cycle_type"] for r in rows}
        assert all(k == ("file" if max(p) < "n04" else "class" if min(p) >= "n04" else "mixed") for p, k in kinds.items())
        made = _written(spark, "ways") - before
        assert made and max(len(spark.read.parquet(str(t)).columns) for t in made) <= most // 2 + 2


def test_roots_share_wide_rows(spark, monkeypatch):
    """150 roots are 3 words: a level holds one row a node instead of one for every 64 roots."""
    from sourceloom.operators import traverse as T

    links = [(f"n{i:03}", f"n{(i * 7 + k) % 150:03}") for i in range(150) for k in (1, 2, 3)]
    pairs = spark.createDataFrame(links, "src string, dst string")
    roots = pairs.selectExpr("src as root").distinct()
    want = {(r["root"], r["node"], r["depth"]) for r in T.reach(pairs, roots, 3, include_root=True).collect()}
    before = _written(spark, "packed-level")
    for words in (4, 2):
        monkeypatch.setattr(T, "ROW_WORDS", words)
        packed = T.packed_reach(pairs, roots, 3)
        assert {(r["root"], r["node"], r["depth"]) for r in packed.pairs().collect()} == want
        counts = {(r["root"], r["depth"]): r["node_count"] for r in packed.counts().collect()}
        assert counts == {(a, d): sum((x, e) == (a, d) for x, _, e in want) for a, d in {(a, d) for a, _, d in want}}
        assert {r["root"]: r["depth"] for r in packed.farthest().collect()} == {a: max(d for x, _, d in want if x == a) for a, _, _ in want}
        if words == 4:
            made = _written(spark, "packed-level") - before
            assert made and max(spark.read.parquet(str(t)).groupBy("node").count().agg({"count": "max"}).first()[0] for t in made) <= 2


def test_many_asked_paths_search_only_links_between_their_ends(spark, monkeypatch):
    """links that no asked path can use are dropped first; ties still go to the smallest path."""
    from sourceloom.operators import traverse as T

    monkeypatch.setattr(T, "PRUNE_PAIRS", 0)
    monkeypatch.setattr(T, "PRUNE_HOPS", 2)
    links = [("a", "b1"), ("a", "b2"), ("b2", "c"), ("b1", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("a", "out"), ("out", "far"), ("in", "a"), ("p", "q"), ("q", "r")]
    edges = spark.createDataFrame([(s, d, "calls") for s, d in links + links[:2]], "src string, dst string, relationship_type string")
    pairs = spark.createDataFrame([("a", "e"), ("p", "r"), ("r", "p"), ("a", "e"), ("c", "c"), ("c", "b2"), (None, "a"), ("a", "nowhere")], "src string, dst string")
    found = sorted((r["src"], r["dst"], r["length"], tuple(r["path"])) for r in T.shortest_path(edges, pairs, 6).collect())
    assert found == [("a", "e", 4, ("a", "b1", "c", "d", "e")), ("c", "b2", 4, ("c", "d", "e", "a", "b2")), ("p", "r", 2, ("p", "q", "r"))]
    asked = pairs.where("src <> dst").selectExpr("src as a", "dst as b")
    kept = {tuple(r) for r in T._useful_links(edges.select("src", "dst").distinct(), asked, 6).collect()}
    assert kept == {link for link in links if link not in {("a", "out"), ("out", "far"), ("in", "a")}}
    assert T.shortest_path(edges, pairs.where("src = 'r'"), 6).count() == 0


def test_depth_bounds_see_past_a_hub(spark):
    """a chain whose links all use one class is not bounded by its length and the class's depth together."""
    from sourceloom.operators import components as K

    length, tail = 7, 6
    links = [(i, i + 1) for i in range(length)] + [(i, 100) for i in range(length + 1)] + [(100 + i, 101 + i) for i in range(tail)] + [(200, 0), (200, 201), (201, 202), (202, 200)]
    pairs = spark.createDataFrame(links, "src long, dst long")
    bounds = {r["node"]: r["most"] for r in K._distance_bounds(pairs, K._strong(pairs)).collect()}
    ahead = {}
    for s, d in links:
        ahead.setdefault(s, []).append(d)

    def farthest(start):
        seen, level, depth = {start}, [start], 0
        while level := list({d for n in level for d in ahead.get(n, ())} - seen):
            seen |= set(level)
            depth += 1
        return depth

    true = {n: farthest(n) for pair in links for n in pair}
    assert all(bounds[n] >= far for n, far in true.items())
    assert all(bounds[n] == far for n, far in true.items() if n < 200)
    names = pairs.selectExpr("concat('n', src) as src", "concat('n', dst) as dst", "'calls' as relationship_type")
    nodes = spark.createDataFrame([(f"n{n}", "r") for n in true], "node_id string, repository_id string")
    assert [tuple(r) for r in K.dependency_depth(nodes, names).collect()] == [("r", max(true.values()))]


def test_edges_are_told_apart_by_keys(spark, tmp_path):
    """lineitem's edges are made distinct as keys, before they become texts; null and repeated keys give the same rows."""
    from sourceloom.plans.workload import adapters as A

    lines = [(1, 10, 1, 1), (1, 10, 1, 1), (1, 11, 2, 2), (1, 11, None, 2), (1, None, 2, 3), (2, 12, 1, 1), (2, 13, 1, 2), (2, 12, 1, 3), (None, 12, 1, 4)]
    made = {"lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
            "nation": ([(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"), "supplier": ([(1, 1)], "s_suppkey long, s_nationkey int"),
            "customer": ([(3,)], "c_custkey long"), "orders": ([(5, 3, 1), (6, 3, 2)], "o_orderkey long, o_custkey long, o_orderdate int")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    tables = {name: spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in made}
    frame = A.load(spark, str(tmp_path), "edges")
    assert sorted(map(str, frame.collect())) == sorted(map(str, spark.sql(A.EDGES, **tables).collect()))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("Aggregate [")[1].split("], [")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert len(keys) == 2 and not any("concat" in key for key in keys)


def test_texts_are_made_once_and_after_files_are_spread(spark):
    raw = spark.range(0, 40, 1, 1).selectExpr(
        "'r' as repository_id", "concat('p/m', id, if(id % 4 = 3, '.md', '.py')) as path", "cast(concat('import a', id) as binary) as content")
    run = analyze(raw, parse_partitions=5)
    plan = X.extract_symbols(run.described)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "MapInArrow" in plan.split("RepartitionByExpression")[0]
    assert "Dockerfile" not in below and plan.count("concat(import a") == 1
    assert run.symbols.where("kind = 'import'").count() == 30 and run.files.where("parse_status = 'parsed'").count() == 30
    assert run.files.where("language = 'Markdown' and parse_status = 'not_applicable'").count() == 10


def test_symbols_leave_python_by_kind(monkeypatch):
    text = ('"""T.\n\n    Indented.\n    """\nimport a, b.c as d\nfrom .. import e\n@f.g\nclass H(i.J[k]):\n    """\tOne line. """\n'
            "    async def l(self, /, m: 'N' = None, *o, p: int = -1, **q) -> r.S: pass\n"
            "    class T:\n        def u(self):\n            try: import v\n            except W: import x\n            finally:\n                def y(): pass\n"
            "match z:\n    case 1: import aa\n")
    batch = pa.RecordBatch.from_pydict({"repository_id": ["r"] * 4, "path": ["a.py", "b.py", "c.md", "d.py"], "text": [text, "def (", None, ""]})
    for rows in (1, 500):
        monkeypatch.setattr(X, "BATCH_ROWS", rows)
        batches = list(X._parse_batches(iter([batch])))
        assert all(len(set(b.column("kind").to_pylist())) == 1 for b in batches)
        found = [row for b in batches for row in b.to_pylist()]
        assert {(r["path"], r["kind"]) for r in found if r["path"] != "a.py"} == {("b.py", "error"), ("d.py", "module")}
        mine = [r for r in found if r["path"] == "a.py"]
        assert [r["docstring"] for r in mine if r["kind"] == "module"] == [ast.get_docstring(ast.parse(text))]
        assert {(r["module"], r["imported_name"], r["alias"], r["level"]) for r in mine if r["kind"] == "import"} == {
            ("a", None, None, 0), ("b.c", None, "d", 0), ("", "e", None, 2), ("v", None, None, 0), ("x", None, None, 0), ("aa", None, None, 0)}
        assert {(r["name"], *r["class_path"], r["docstring"]) for r in mine if r["kind"] == "class"} == {("H", "One line. "), ("T", "H", None)}
        functions = {r["name"]: r for r in mine if r["kind"] == "function"}
        assert {n: r["class_path"] for n, r in functions.items()} == {"l": ["H"], "u": ["H", "T"], "y": ["H", "T"]}
        assert [tuple(p.values()) for p in functions["l"]["parameters"]] == [
            ("self", None, None, "positional"), ("m", "'N'", "None", "positional"), ("o", None, None, "vararg"),
            ("p", "int", "-1", "keyword_only"), ("q", None, None, "kwarg")]
        assert functions["l"]["is_async"] and functions["l"]["return_type"] == "r.S" and functions["y"]["parameters"] == []


def test_resolving_sorts_names_and_texts_once(spark):
    modules = spark.createDataFrame([("r", "a.b", "a/b.py"), ("r", "a.b", "a/b.pyi"), ("r", "a", "a/__init__.py"), ("s", "a.b.c", "a/b/c.py")],
                                    "repository_id string, name string, file_path string")
    imports = spark.createDataFrame([("r", "x.py", m, 0, n) for n, m in enumerate(("a.b.c", "a.b", "a.c.d", "os", "", None, "a.b"))] + [("s", "y.py", "a.b.c.d", 0, 1)],
                                    "repository_id string, file_path string, module string, level int, line_number int")
    found = G.resolve_imports(imports, modules)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2
    assert {(r["repository_id"], r["line_number"]): (r["target_module"], r["target_file"]) for r in found.collect()} == {
        ("r", 0): ("a.b", "a/b.pyi"), ("r", 1): ("a.b", "a/b.pyi"), ("r", 2): ("a", "a/__init__.py"), ("r", 3): (None, None),
        ("r", 4): (None, None), ("r", 5): (None, None), ("r", 6): ("a.b", "a/b.pyi"), ("s", 1): ("a.b.c", "a/b/c.py")}


def test_paths_are_judged_without_taking_them_apart(spark):
    paths = {"a/b.PY": (".py", False), "a/.env": ("", False), ".git/x.py": (".py", True), "a/build/x.tar.gz": (".gz", True), "a/build": ("", False),
             "buildx/y.": ("", False), "git/..": ("", False), "/dist/z.\n": (".\n", True), "xdist/.next.y": (".y", False), "": ("", False), None: (None, None)}
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    judged = table.select("path", S.suffix(S.file_name(F.col("path"))).alias("suffix"), S.in_ignored_directory(F.col("path")).alias("ignored"))
    assert {r["path"]: (r["suffix"], r["ignored"]) for r in judged.collect()} == paths
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "split" not in plan
