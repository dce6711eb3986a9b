"""Degree, statistics, traversal, path, component and cycle queries over the estate graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.functions import scalars as S
from sourceloom.operators import catalog as C
from sourceloom.operators import components as K
from sourceloom.operators import degrees as D
from sourceloom.operators import graph_build as G
from sourceloom.operators import search as SE
from sourceloom.operators import traverse as T
from sourceloom.plans.workload.adapters import DEGREES, estate, load, roots, with_inputs
from sourceloom.plans.workload.registry import query

_LABELS = "case entity_type " + " ".join(f"when '{k}' then '{v}'" for k, v in V.ENTITY_LABELS.items()) + " else 'Unknown' end"
_TYPES = "case relationship_type " + " ".join(f"when '{k}' then '{v}'" for k, v in V.EDGE_TYPES.items()) + " else upper(relationship_type) end"


def _graph_check(select: str, more: str = "", recursive: bool = False) -> str:
    return with_inputs(DEGREES + more + select, "nodes", "edges", recursive=recursive)


def _degree_table(spark, folder) -> DataFrame:
    graph = estate(spark, folder)
    return D.degrees(graph.nodes, graph.edges)


# ---- vocabulary ----------------------------------------------------------------------------
@query("entity_label", _graph_check(f"select node_id, {_LABELS} as label from nodes"))
def entity_label(spark, folder):
    return load(spark, folder, "nodes").select("node_id", S.entity_label(F.col("entity_type")).alias("label"))


@query("edge_type", _graph_check(f"select {_TYPES} as edge_type, count(*) as edges from edges group by 1"))
def edge_type(spark, folder):
    return estate(spark, folder).edges.groupBy(S.edge_type(F.col("relationship_type")).alias("edge_type")).agg(
        F.count(F.lit(1)).alias("edges"))


@query("event_types_as_edge_types", """
select upper(event_type) as edge_type, false as known, count(*) as events from events group by event_type""")
def event_types_as_edge_types(spark, folder):
    kind = F.col("action")
    return load(spark, folder, "activity").groupBy(
        S.edge_type(kind).alias("edge_type"), S.is_known_edge_type(kind).alias("known")).agg(F.count(F.lit(1)).alias("events"))


@query("flatten_metadata", with_inputs("""
select node_id, case when entity_type = 'file' then 'Python' else '' end as language,
  entity_type = 'function' as is_async, false as is_package, entity_type <> 'package' as internal,
  coalesce(file_path, '') as file_path, '' as module from nodes""", "nodes"))
def flatten_metadata(spark, folder):
    kind = F.col("entity_type")
    metadata = (F.when(kind == "file", '{"language": "Python", "lines": 3}').when(kind == "function", '{"is_async": true}')
                .when(kind == "package", '{"internal": false}').when(kind == "class", "{}"))
    nodes = load(spark, folder, "nodes").withColumn("metadata_json", metadata).withColumn("package", F.lit(None).cast("string"))
    return G.flatten_metadata(nodes).select("node_id", "language", "is_async", "is_package", "internal", "file_path", "module")


@query("flatten_edges", with_inputs(f"""
select src as source_key, dst as target_key, {_TYPES} as edge_type from edges
where src not like 'module:%' and dst not like 'module:%'""", "edges"))
def flatten_edges(spark, folder):
    graph = estate(spark, folder)
    known = graph.nodes.where("entity_type <> 'module'")
    return G.flatten_edges(graph.edges, known).select("source_key", "target_key", "edge_type")


@query("valid_edges", with_inputs("""
select src, dst, relationship_type from edges where src not like 'package:%' and dst not like 'package:%'
and relationship_type <> 'belongs_to' and src <> dst""", "edges"))
def valid_edges(spark, folder):
    graph = estate(spark, folder)
    kept = graph.nodes.where("entity_type <> 'package'")
    kind = F.when(F.col("relationship_type") == "belongs_to", "located_in").otherwise(F.col("relationship_type"))
    return G.valid_edges(graph.edges.withColumn("relationship_type", kind), kept).select("src", "dst", "relationship_type")


@query("dedupe_edges", with_inputs("""
select l_suppkey, l_partkey, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') as lines
from lineitem group by l_suppkey, l_partkey""", "edges"))
def dedupe_edges(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.lit("estate").alias("repository_id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"),
        F.lit("contains").alias("relationship_type"), F.col("l_linenumber").alias("line"))
    return G.dedupe_edges(rows).select(F.col("src").alias("l_suppkey"), F.col("dst").alias("l_partkey"), F.array_join(
        F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("filter_graph", with_inputs("""
with k as (select node_id from nodes where entity_type in ('file', 'module') and name not like '%widget')
select src, dst, relationship_type from edges where relationship_type = 'contains'
and src in (select node_id from k) and dst in (select node_id from k)""", "nodes", "edges"))
def filter_graph(spark, folder):
    graph = estate(spark, folder)
    return G.filter_graph(graph.nodes, graph.edges, F.col("entity_type").isin("file", "module") & ~F.col("name").endswith("widget"),
                          F.col("relationship_type") == "contains")[1].select("src", "dst", "relationship_type")


# ---- degrees and statistics ----------------------------------------------------------------
@query("degrees", _graph_check("select node_id, in_degree, out_degree, total_degree from deg"))
def degrees(spark, folder):
    return _degree_table(spark, folder).select("node_id", "in_degree", "out_degree", "total_degree")


@query("most_referenced", _graph_check("""
select repository_id, entity_type, node_id, in_degree from (
  select *, row_number() over (partition by entity_type order by in_degree desc, node_id) as r from deg
  where entity_type in ('file', 'function') and in_degree > 0) t where r = 1"""))
def most_referenced(spark, folder):
    return D.most_referenced(_degree_table(spark, folder))


@query("dependency_metrics", _graph_check("""
select repository_id, count(*) as total_nodes, sum(out_degree) as total_edges, sum(in_degree) as incoming_dependency_count,
  sum(out_degree) as outgoing_dependency_count, max(in_degree) as fan_in, max(out_degree) as fan_out,
  min_by(node_id, (-in_degree, node_id)) filter (where entity_type = 'file' and in_degree > 0) as most_referenced_file,
  min_by(node_id, (-in_degree, node_id)) filter (where entity_type = 'function' and in_degree > 0) as most_referenced_function,
  round(sum(out_degree) / (count(*) * (count(*) - 1.0)), 6) as dependency_density
from deg group by repository_id"""))
def dependency_metrics(spark, folder):
    return D.dependency_metrics(_degree_table(spark, folder))


@query("node_distribution", _graph_check("select repository_id, entity_type, count(*) as node_count from nodes group by 1, 2"))
def node_distribution(spark, folder):
    return D.node_distribution(estate(spark, folder).nodes)


@query("relationship_distribution", _graph_check("select repository_id, relationship_type, count(*) as edge_count from edges group by 1, 2"))
def relationship_distribution(spark, folder):
    return D.relationship_distribution(estate(spark, folder).edges)


@query("graph_counts", _graph_check("""
select repository_id, count(*) as total_nodes, (select count(*) from edges) as total_edges from nodes group by 1"""))
def graph_counts(spark, folder):
    graph = estate(spark, folder)
    return D.graph_counts(graph.nodes, graph.edges)


@query("graph_statistics", _graph_check("""
select repository_id, count(*) as total_nodes, sum(out_degree) as total_relationships,
  min_by(node_id, (-total_degree, node_id)) as most_connected_node, max(total_degree) as most_connected_degree,
  round(sum(total_degree) / count(*), 6) as average_degree,
  round(sum(out_degree) / (count(*) * (count(*) - 1.0)), 6) as graph_density from deg group by repository_id"""))
def graph_statistics(spark, folder):
    return D.graph_statistics(_degree_table(spark, folder))


@query("type_statistics", _graph_check("""
select repository_id, count(*) as nodes, count(*) filter (where entity_type = 'function') as function_count,
  count(*) filter (where entity_type = 'class') as class_count, count(*) filter (where entity_type = 'module') as module_count,
  count(*) filter (where entity_type = 'file') as file_count, count(*) filter (where entity_type = 'package') as package_count,
  (select count(*) from edges) as edges, round((select count(*) from edges) / count(*), 1) as avg_connections from nodes group by 1"""))
def type_statistics(spark, folder):
    graph = estate(spark, folder)
    return D.type_statistics(graph.nodes, graph.edges)


@query("hotspots", _graph_check("""
select node_id, total_degree, r as rank from (select *, row_number() over (order by total_degree desc, node_id) as r from deg) t where r <= 10"""))
def hotspots(spark, folder):
    return D.hotspots(_degree_table(spark, folder)).select("node_id", "total_degree", "rank")


def _targeted(kind: str) -> str:
    return _graph_check(f"""select node_id, edge_count, r as rank from (
      select dst as node_id, count(*) as edge_count, row_number() over (order by count(*) desc, dst) as r
      from edges where relationship_type = '{kind}' group by dst) t where r <= 5""")


@query("most_imported", _targeted("imports"))
def most_imported(spark, folder):
    return D.most_targeted(estate(spark, folder).edges, "IMPORTS").select("node_id", "edge_count", "rank")


@query("most_called", _targeted("calls"))
def most_called(spark, folder):
    return D.most_targeted(estate(spark, folder).edges, "CALLS").select("node_id", "edge_count", "rank")


@query("role_counts", _graph_check("""
select repository_id, count(*) filter (where total_degree = 0) as orphan_total,
  count(*) filter (where in_degree = 0 and out_degree > 0) as entry_point_total,
  count(*) filter (where out_degree = 0 and in_degree > 0) as sink_total,
  least(100, orphan_total) as orphan_count, least(50, entry_point_total) as entry_point_count, least(50, sink_total) as sink_count
from deg group by repository_id"""))
def role_counts(spark, folder):
    return D.role_counts(_degree_table(spark, folder))


_ROLE = """case when total_degree = 0 then 'orphan' when in_degree = 0 then 'entry_point' when out_degree = 0 then 'sink' else 'inner' end"""


@query("role_members", _graph_check(f"select node_id, {_ROLE} as role from deg where {_ROLE} <> 'inner'"))
def role_members(spark, folder):
    return D.role_members(_degree_table(spark, folder)).select("node_id", "role")


@query("role_report", _graph_check(f"""
select node_id, role, r as rank from (select node_id, {_ROLE} as role, row_number() over (partition by {_ROLE} order by node_id) as r from deg) t
where role <> 'inner' and r <= case role when 'orphan' then 100 else 50 end"""))
def role_report(spark, folder):
    return D.role_report(_degree_table(spark, folder)).select("node_id", "role", "rank")


@query("graph_summary", _graph_check(f"""
select count(*) as total_nodes, (select count(*) from edges) as total_edges,
  count(*) filter (where {_ROLE} = 'entry_point') as entry_point_total, count(*) filter (where {_ROLE} = 'sink') as sink_total,
  (select string_agg(node_id, ',' order by total_degree desc, node_id) from (select * from deg order by total_degree desc, node_id limit 10) t) as hotspots,
  (select string_agg(dst, ',' order by c desc, dst) from (select dst, count(*) as c from edges where relationship_type = 'imports' group by dst order by c desc, dst limit 5) t) as most_imported
from deg"""))
def graph_summary(spark, folder):
    graph = estate(spark, folder)
    listed = lambda c: F.array_join(F.transform(c, lambda s: s["node_id"]), ",").alias(c)
    return D.graph_summary(graph.nodes, graph.edges, _degree_table(spark, folder)).select(
        "total_nodes", "total_edges", "entry_point_total", "sink_total", listed("hotspots"), listed("most_imported"))


# ---- reachability --------------------------------------------------------------------------
def _walk(depth: int, direction: str = "outgoing", types: str | None = None, start: str = "roots") -> str:
    where = f"where relationship_type in ({types})" if types else ""
    pair = {"outgoing": f"select src, dst from edges {where}", "incoming": f"select dst as src, src as dst from edges {where}",
            "both": f"select src, dst from edges {where} union select dst, src from edges {where}"}[direction]
    return f""", pairs as ({pair}), walk(root, node, depth) as (
      select root, root, 0 from {start} union
      select w.root, p.dst, w.depth + 1 from walk w join pairs p on p.src = w.node where w.depth < {depth}),
    found as (select root, node, min(depth) as depth from walk group by root, node)
    """


def _reach_check(depth: int, select: str, **walk) -> str:
    return _graph_check(select, _walk(depth, **walk), recursive=True)


@query("bfs_outgoing", _reach_check(3, """
select f.root, f.node, f.depth, n.entity_type from found f join nodes n on n.node_id = f.node where f.node <> f.root"""))
def bfs_outgoing(spark, folder):
    graph = estate(spark, folder)
    return T.bfs(graph.nodes, graph.edges, roots(spark, folder), 3)


@query("bfs_incoming_types", _reach_check(6, """
select f.root, f.node, f.depth, n.entity_type from found f join nodes n on n.node_id = f.node
where f.node <> f.root and n.entity_type in ('class', 'file')""", direction="incoming", types="'imports', 'inherits'"))
def bfs_incoming_types(spark, folder):
    graph = estate(spark, folder)
    return T.bfs(graph.nodes, graph.edges, roots(spark, folder), 6, "incoming", ["imports", "INHERITS", "nonsense"], ["class", "file"])


@query("bfs_both", _reach_check(2, """
select f.root, f.node, f.depth, n.entity_type from found f join nodes n on n.node_id = f.node where f.node <> f.root""", direction="both"))
def bfs_both(spark, folder):
    graph = estate(spark, folder)
    return T.bfs(graph.nodes, graph.edges, roots(spark, folder), 2, "both")


@query("dfs")
def dfs(spark, folder):
    """SQL would list every simple path through the imports, a dense knot; checked by brute force in tests/test_graphs.py."""
    return T.dfs_order(estate(spark, folder).edges, roots(spark, folder), 4, "outgoing", ["CALLS", "IMPORTS", "USES", "INHERITS"])


# Whole depth-first paths grow with the square of a dense graph, so they are listed along symbols only.
_SYMBOL_TYPES = ["CALLS", "USES", "INHERITS"]
_SYMBOL_SQL = "'calls', 'uses', 'inherits'"


@query("dfs_symbol_paths", _reach_check(4, """
, inner_pairs as (select distinct a.root, p.src, p.dst from found a join pairs p on p.src = a.node
    join found b on b.root = a.root and b.node = p.dst),
paths(root, node, path) as (
  select root, root, [root] from roots union all
  select w.root, p.dst, list_append(w.path, p.dst) from paths w join inner_pairs p on p.root = w.root and p.src = w.node
  where not list_contains(w.path, p.dst))
select root, node, array_to_string(min(path), '>') as dfs_path from paths group by root, node""", types=_SYMBOL_SQL))
def dfs_symbol_paths(spark, folder):
    found = T.dfs(estate(spark, folder).edges, roots(spark, folder), 4, "outgoing", _SYMBOL_TYPES)
    return found.select("root", "node", F.array_join("dfs_path", ">").alias("dfs_path"))


@query("traversal_edges", _reach_check(2, """
select a.root, e.src, e.dst, e.relationship_type from edges e join found a on a.node = e.src join found b on b.root = a.root and b.node = e.dst"""))
def traversal_edges(spark, folder):
    edges = estate(spark, folder).edges
    return T.traversal_edges(edges, T.reach(T.links(edges), roots(spark, folder), 2, include_root=True))


@query("traversal_edges_root_only", _reach_check(2, """
select a.root, e.src, e.dst, e.relationship_type from edges e join found a on a.node = e.src join found b on b.root = a.root and b.node = e.dst
where e.src = a.root or e.dst = a.root"""))
def traversal_edges_root_only(spark, folder):
    edges = estate(spark, folder).edges
    return T.traversal_edges(edges, T.reach(T.links(edges), roots(spark, folder), 2, include_root=True), root_only=True)


_NEIGHBORS = """
, around as (select r.root, e.dst as neighbor, 'outgoing' as direction, e.relationship_type from roots r join edges e on e.src = r.root
  union all select r.root, e.src, 'incoming', e.relationship_type from roots r join edges e on e.dst = r.root)
"""


@query("neighbors", _graph_check("select * from around", _NEIGHBORS))
def neighbors(spark, folder):
    return T.neighbors(estate(spark, folder).edges, roots(spark, folder))


@query("neighbors_report", _graph_check("""
select root, direction, neighbor, r as rank from (select *, row_number() over (partition by root, direction order by neighbor, relationship_type) as r from around) t where r <= 500""", _NEIGHBORS))
def neighbors_report(spark, folder):
    return T.neighbors_report(estate(spark, folder).edges, roots(spark, folder)).select("root", "direction", "neighbor", "rank")


@query("node_detail", _graph_check("""
select a.root, a.neighbor, a.direction, a.relationship_type, n.entity_type as neighbor_type, n.name as neighbor_name
from around a join nodes n on n.node_id = a.neighbor""", _NEIGHBORS))
def node_detail(spark, folder):
    graph = estate(spark, folder)
    return T.node_detail(graph.nodes, graph.edges, roots(spark, folder))


@query("neighborhood", _reach_check(2, """
select f.root, f.node, f.depth, n.entity_type from found f join nodes n on n.node_id = f.node where f.node <> f.root and n.entity_type = 'class'""",
                                    direction="both", types="'inherits', 'uses'"))
def neighborhood(spark, folder):
    graph = estate(spark, folder)
    return T.neighborhood(graph.nodes, graph.edges, roots(spark, folder), 2, "both", ["INHERITS", "USES"], ["class"])[0]


@query("subgraph_nodes", _reach_check(2, "select root, node, depth from found"))
def subgraph_nodes(spark, folder):
    return T.subgraph(estate(spark, folder).edges, roots(spark, folder), 2)[0]


@query("subgraph_edges", _reach_check(2, """
select a.root, e.src, e.dst, e.relationship_type from edges e join found a on a.node = e.src join found b on b.root = a.root and b.node = e.dst"""))
def subgraph_edges(spark, folder):
    return T.subgraph(estate(spark, folder).edges, roots(spark, folder), 2)[1]


@query("expand_neighbors", _graph_check("select distinct neighbor as node_id from around", _NEIGHBORS))
def expand_neighbors(spark, folder):
    return T.expand_neighbors(estate(spark, folder).edges, roots(spark, folder).select(F.col("root").alias("node_id")))


@query("edges_within", _graph_check("""
select src, dst, relationship_type from edges where src in (select node_id from nodes where entity_type in ('class', 'package', 'repository'))
and dst in (select node_id from nodes where entity_type in ('class', 'package', 'repository'))"""))
def edges_within(spark, folder):
    graph = estate(spark, folder)
    return T.edges_within(graph.edges, graph.nodes.where("entity_type in ('class', 'package', 'repository')")).select("src", "dst", "relationship_type")


# ---- chains and impact ---------------------------------------------------------------------
def _chain(types: str, out_role: str, in_role: str, transitive_in: bool = True) -> str:
    where = f"where relationship_type in ({types})"
    far_in = f"""union all select distinct root, 'transitive_{in_role}', node from back where depth > 1 and node <> root""" if transitive_in else ""
    return _graph_check(f"""
    , walk(root, node, depth) as (select root, root, 0 from roots union
        select w.root, e.dst, w.depth + 1 from walk w join (select src, dst from edges {where}) e on e.src = w.node where w.depth < 8),
    back(root, node, depth) as (select root, root, 0 from roots union
        select w.root, e.src, w.depth + 1 from back w join (select src, dst from edges {where}) e on e.dst = w.node where w.depth < 8)
    select distinct root, '{out_role}' as role, node from walk where depth = 1
    union all select distinct root, 'transitive_{out_role}', node from walk where depth > 1 and node <> root
    union all select distinct root, '{in_role}', node from back where depth = 1 {far_in}""", recursive=True)


@query("dependency_chain", _chain("'imports', 'uses', 'depends_on'", "dependency", "dependent", False))
def dependency_chain(spark, folder):
    return T.dependency_chain(estate(spark, folder).edges, roots(spark, folder))


@query("call_chain", _chain("'calls'", "callee", "caller"))
def call_chain(spark, folder):
    return T.call_chain(estate(spark, folder).edges, roots(spark, folder))


@query("import_chain", _chain("'imports'", "importee", "importer"))
def import_chain(spark, folder):
    return T.import_chain(estate(spark, folder).edges, roots(spark, folder))


@query("inheritance_chain", _chain("'inherits'", "superclass", "subclass"))
def inheritance_chain(spark, folder):
    return T.inheritance_chain(estate(spark, folder).edges, roots(spark, folder))


@query("blast_radius", _reach_check(4, """
select root, node, depth, case when depth = 1 then 'direct' else 'indirect' end as impact from found where node <> root""", direction="incoming"))
def blast_radius(spark, folder):
    return T.blast_radius(estate(spark, folder).edges, roots(spark, folder), 4)


@query("blast_levels", _reach_check(8, "select root, depth, count(*) as node_count from found where node <> root group by root, depth", direction="incoming"))
def blast_levels(spark, folder):
    return T.blast_levels(T.blast_radius(estate(spark, folder).edges, roots(spark, folder), 8))


@query("blast_counts_every_file", with_inputs("""
with pairs as (select distinct dst as src, src as dst from edges),
walk(root, node, depth) using key (root, node) as (select node_id, node_id, 0 from nodes where entity_type = 'file' union
  select w.root, p.dst, min(w.depth + 1) from walk w join pairs p on p.src = w.node
  where w.depth < 4 and not exists (from recurring.walk k where k.root = w.root and k.node = p.dst) group by w.root, p.dst)
select root, depth, count(*) as node_count from walk where depth > 0 group by root, depth""", "nodes", "edges", recursive=True))
def blast_counts_every_file(spark, folder):
    graph = estate(spark, folder)
    return T.blast_counts(graph.edges, graph.nodes.where("entity_type = 'file'").select(F.col("node_id").alias("root")), 4)


@query("dependency_tree", _graph_check("""
, tree(root, depth, parent, node, relationship_type, path) as (
  select root, 0, cast(null as varchar), root, cast(null as varchar), [root] from roots union all
  select t.root, t.depth + 1, e.src, e.dst, e.relationship_type, list_append(t.path, e.dst) from tree t join edges e on e.src = t.node
  where t.depth < 3 and not list_contains(t.path, e.dst))
select root, depth, parent, node, relationship_type, array_to_string(path, '>') as path from tree where depth > 0""", recursive=True))
def dependency_tree(spark, folder):
    rows = T.dependency_tree(estate(spark, folder).edges, roots(spark, folder), 3)
    return rows.withColumn("path", F.array_join("path", ">"))


# ---- paths ---------------------------------------------------------------------------------
def _asked(spark, folder) -> DataFrame:
    """From each root to the estate's first class, or for structural roots to the file root."""
    top = roots(spark, folder)
    file_root = top.where("entity_type = 'file'").select(F.col("root").alias("dst"), F.lit(True).alias("structural"))
    asked = top.where("entity_type <> 'file'").select(
        F.col("root").alias("src"), F.col("entity_type").isin("repository", "package", "module").alias("structural"))
    return asked.join(file_root, "structural", "left").select("src", F.coalesce("dst", F.lit("class:0")).alias("dst"))


_ASKED = """, asked as (select root as a, case when entity_type in ('class', 'function') then 'class:0'
  else (select root from roots where entity_type = 'file') end as b from roots where entity_type <> 'file')
"""


@query("shortest_path", _graph_check("""
, fwd(root, node, depth) as (select distinct a, a, 0 from asked union
    select w.root, e.dst, w.depth + 1 from fwd w join (select distinct src, dst from edges) e on e.src = w.node where w.depth < 6),
near as (select root, node, min(depth) as depth from fwd group by root, node),
trace(a, b, node, depth, path) as (
  select q.a, q.b, q.b, n.depth, [q.b] from asked q join near n on n.root = q.a and n.node = q.b where q.a <> q.b union all
  select t.a, t.b, e.src, t.depth - 1, list_prepend(e.src, t.path) from trace t join (select distinct src, dst from edges) e on e.dst = t.node
    join near n on n.root = t.a and n.node = e.src and n.depth = t.depth - 1)
select a as src, b as dst, len(min(path)) - 1 as length, array_to_string(min(path), '>') as path from trace where depth = 0 group by a, b""", _ASKED, recursive=True))
def shortest_path(spark, folder):
    found = T.shortest_path(estate(spark, folder).edges, _asked(spark, folder), 6)
    return found.withColumn("path", F.array_join("path", ">"))


_FAR = """
, calls as (select src, dst from edges where relationship_type = 'calls'),
heads as (select src as a from calls where src not in (select dst from calls)),
trail(a, node, path) as (select a, a, [a] from heads union all select t.a, c.dst, list_append(t.path, c.dst) from trail t join calls c on c.src = t.node)
select a as src, node as dst, len(path) - 1 as length, array_to_string(path, '>') as path from trail where len(path) > 10 and node not in (select src from calls)
"""


@query("shortest_path_far", with_inputs("with" + _FAR.strip()[1:], "edges", recursive=True))
def shortest_path_far(spark, folder):
    """From the first to the last function of every chain of calls with ten steps or more, over all edges."""
    edges = estate(spark, folder).edges
    calls = edges.where("relationship_type = 'calls'").select("src", "dst")
    heads = calls.select("src").join(calls.select(F.col("dst").alias("src")), "src", "left_anti").distinct()
    owner = load(spark, folder, "commits").select(F.concat(F.lit("function:"), F.col("hash")).alias("function"), F.col("author"))
    ends = calls.select(F.col("dst").alias("last")).join(calls.select(F.col("src").alias("last")), "last", "left_anti").distinct()
    first = heads.join(owner, heads["src"] == owner["function"]).select("src", "author")
    last = ends.join(owner, ends["last"] == owner["function"]).select(F.col("last").alias("dst"), "author")
    found = T.shortest_path(edges, first.join(last, "author").select("src", "dst"), 64)
    return found.where("length >= 10").withColumn("path", F.array_join("path", ">"))


_ALL_PATHS = _ASKED + """, trails(a, b, node, path) as (
  select a, b, a, [a] from asked where a <> b union all
  select t.a, t.b, e.dst, list_append(t.path, e.dst) from trails t join (select distinct src, dst from edges) e on e.src = t.node
  where t.node <> t.b and len(t.path) <= 4 and not list_contains(t.path, e.dst)),
hits as (select a as src, b as dst, len(path) - 1 as length, array_to_string(path, '>') as path, path as steps from trails where node = b)
"""


@query("all_paths", _graph_check("select src, dst, length, path from hits", _ALL_PATHS, recursive=True))
def all_paths(spark, folder):
    return T.all_paths(estate(spark, folder).edges, _asked(spark, folder), 4).withColumn("path", F.array_join("path", ">"))


@query("all_paths_report", _graph_check("""
select src, dst, length, path, r as rank, n as total_paths, m as shortest_length from (
  select *, row_number() over (partition by src, dst order by length, steps) as r, count(*) over (partition by src, dst) as n,
    min(length) over (partition by src, dst) as m from hits) t where r <= 50""", _ALL_PATHS, recursive=True))
def all_paths_report(spark, folder):
    report = T.all_paths_report(T.all_paths(estate(spark, folder).edges, _asked(spark, folder), 4))
    return report.withColumn("path", F.array_join("path", ">"))


# ---- components, cycles, depth -------------------------------------------------------------
def _calls(spark, folder) -> DataFrame:
    return estate(spark, folder).edges.where("relationship_type = 'calls'")


@query("connected_components", with_inputs("""
with recursive_pairs as (select src, dst from edges where relationship_type = 'calls' union all select dst, src from edges where relationship_type = 'calls'),
walk(root, node) as (select node_id, node_id from nodes where entity_type = 'function' union
  select w.root, p.dst from walk w join recursive_pairs p on p.src = w.node)
select root as node_id, min(node) as component from walk group by root""", "nodes", "edges", recursive=True))
def connected_components(spark, folder):
    functions = estate(spark, folder).nodes.where("entity_type = 'function'")
    return K.connected_components(functions, _calls(spark, folder))


@query("largest_component", with_inputs("""
with recursive_pairs as (select src, dst from edges where relationship_type = 'calls' union all select dst, src from edges where relationship_type = 'calls'),
walk(root, node) as (select node_id, node_id from nodes where entity_type = 'function' union
  select w.root, p.dst from walk w join recursive_pairs p on p.src = w.node),
sizes as (select c, count(*) as n from (select root, min(node) as c from walk group by root) t group by c)
select 'estate' as repository_id, max(n) as largest_component, count(*) as component_count from sizes""", "nodes", "edges", recursive=True))
def largest_component(spark, folder):
    return K.largest_component(estate(spark, folder).nodes.where("entity_type = 'function'"), _calls(spark, folder))


@query("largest_component_estate", with_inputs("""
with recursive_pairs as (select src, dst from edges union all select dst, src from edges),
from_repository(node) as (select 'repository:0' union select p.dst from from_repository w join recursive_pairs p on p.src = w.node),
from_class(node) as (select 'class:0' union select p.dst from from_class w join recursive_pairs p on p.src = w.node),
counts as (select (select count(*) from from_repository) as a, (select count(*) from from_class) as b, (select count(*) from nodes) as n,
  (select count(*) from nodes where node_id not in (select src from recursive_pairs)) as lonely)
select 'estate' as repository_id, greatest(a, b) as largest_component,
  case when a + b + lonely = n then 2 + lonely end as component_count from counts""", "nodes", "edges", recursive=True))
def largest_component_estate(spark, folder):
    graph = estate(spark, folder)
    return K.largest_component(graph.nodes, graph.edges)


_SCC = """
with pairs as (select distinct src, dst from edges where relationship_type = 'imports'),
walk(root, node) as (select src, dst from pairs union select w.root, p.dst from walk w join pairs p on p.src = w.node),
members as (select a.root as node, min(a.node) as scc from walk a join walk b on b.root = a.node and b.node = a.root group by a.root)
"""


@query("strong_components", with_inputs(_SCC + "select node, scc from members", "edges", recursive=True))
def strong_components(spark, folder):
    return K.strong_components(K.cycle_links(estate(spark, folder).edges))


@query("scc_count", with_inputs(_SCC + "select count(distinct scc) as scc_count, count(*) as nodes_on_cycles from members", "edges", recursive=True))
def scc_count(spark, folder):
    return K.scc_count(estate(spark, folder).edges)


_CYCLES = """
with pairs as (select distinct src, dst from edges where relationship_type in ('imports', 'inherits', 'uses', 'calls', 'references')),
paths(start, node, path) as (select src, dst, [src, dst] from pairs where dst > src union all
  select t.start, p.dst, list_append(t.path, p.dst) from paths t join pairs p on p.src = t.node
  where p.dst > t.start and len(t.path) < 5 and not list_contains(t.path, p.dst)),
closed as (select min(path) as path, len(min(path)) as length from paths t join pairs p on p.src = t.node and p.dst = t.start group by list_sort(path))
"""


@query("cycles", with_inputs(_CYCLES + """
select array_to_string(path, '>') as cycle_path, 'file' as cycle_type, length, case when length <= 3 then 'high' else 'medium' end as severity
from closed""", "edges", recursive=True))
def cycles(spark, folder):
    graph = estate(spark, folder)
    return K.cycles_report(K.cycles(graph.edges, graph.nodes)).withColumn("cycle_path", F.array_join("cycle_path", ">"))


@query("cycle_edges", with_inputs(_CYCLES + """
select array_to_string(path, '>') as cycle_path, i as position, path[i + 1] as src, path[(i + 1) % length + 1] as dst, 'imports' as relationship_type
from closed, lateral (select unnest(range(0, length)) as i) g""", "edges", recursive=True))
def cycle_edges(spark, folder):
    graph = estate(spark, folder)
    found = K.cycle_edges(K.cycles(graph.edges, graph.nodes), graph.edges)
    return found.withColumn("cycle_path", F.array_join("cycle_path", ">"))


@query("cycles_witness", with_inputs(_SCC + """,
inner_pairs as (select a.scc, p.src, p.dst from pairs p join members a on a.node = p.src join members b on b.node = p.dst and b.scc = a.scc),
ahead(scc, node, depth) using key (scc, node) as (select scc, scc, 0 from members group by scc union
  select w.scc, p.dst, min(w.depth + 1) from ahead w join inner_pairs p on p.scc = w.scc and p.src = w.node
  where not exists (from recurring.ahead k where k.scc = w.scc and k.node = p.dst) group by w.scc, p.dst),
behind(scc, node, depth) using key (scc, node) as (select scc, scc, 0 from members group by scc union
  select w.scc, p.src, min(w.depth + 1) from behind w join inner_pairs p on p.scc = w.scc and p.dst = w.node
  where not exists (from recurring.behind k where k.scc = w.scc and k.node = p.src) group by w.scc, p.src),
parent as (select p.scc, p.dst as node, min(p.src) as near from inner_pairs p join ahead a on a.scc = p.scc and a.node = p.src
  join ahead b on b.scc = p.scc and b.node = p.dst and b.depth = a.depth + 1 group by 1, 2),
next_one as (select p.scc, p.src as node, min(p.dst) as near from inner_pairs p join behind a on a.scc = p.scc and a.node = p.dst
  join behind b on b.scc = p.scc and b.node = p.src and b.depth = a.depth + 1 group by 1, 2),
down(scc, node, path) as (select distinct scc, scc, [scc] from members union all
  select t.scc, t.node, list_append(d.path, t.node) from down d join parent t on t.scc = d.scc and t.near = d.node),
up(scc, node, path) as (select distinct scc, scc, [scc] from members union all
  select t.scc, t.node, list_prepend(t.node, u.path) from up u join next_one t on t.scc = u.scc and t.near = u.node),
ways as (select u.path as up, d.path as down, list_filter(u.path, lambda x: list_contains(d.path, x))[1] as turn
  from inner_pairs p join up u on u.scc = p.scc and u.node = p.dst join down d on d.scc = p.scc and d.node = p.src),
rings as (select up[1:list_position(up, turn)] || down[list_position(down, turn) + 1:len(down)] as ring from ways),
turned as (select ring[list_position(ring, list_min(ring)):len(ring)] || ring[1:list_position(ring, list_min(ring)) - 1] as path from rings)
select array_to_string(min(path), '>') as cycle_path, 'file' as cycle_type, len(min(path)) as length,
  case when len(min(path)) <= 3 then 'high' else 'medium' end as severity, count(*) as links from turned group by list_sort(path)""", "edges", recursive=True))
def cycles_witness(spark, folder):
    graph = estate(spark, folder)
    return K.cycles_witness(graph.edges, graph.nodes).withColumn("cycle_path", F.array_join("cycle_path", ">"))


@query("dependency_depth", with_inputs("""
with pairs as (select distinct src, dst from edges where relationship_type in ('imports', 'uses', 'calls', 'inherits')),
walk(root, node, depth) using key (root, node) as (select distinct src, src, 0 from pairs union
  select w.root, p.dst, min(w.depth + 1) from walk w join pairs p on p.src = w.node
  where not exists (from recurring.walk k where k.root = w.root and k.node = p.dst) group by w.root, p.dst)
select 'estate' as repository_id, max(depth) as dependency_depth from walk""", "edges", recursive=True))
def dependency_depth(spark, folder):
    graph = estate(spark, folder)
    return K.dependency_depth(graph.nodes, graph.edges)


# ---- listings and search -------------------------------------------------------------------
@query("nodes_page", _graph_check("select node_id, entity_type, label from nodes order by entity_type, label, node_id limit 40 offset 60"))
def nodes_page(spark, folder):
    return C.nodes_page(estate(spark, folder).nodes, 40, 60).select("node_id", "entity_type", "label")


@query("edges_page", _graph_check("select src, dst, relationship_type from edges order by relationship_type, src, dst limit 40 offset 60"))
def edges_page(spark, folder):
    return C.edges_page(estate(spark, folder).edges, 40, 60).select("src", "dst", "relationship_type")


@query("graph_extract", _graph_check("select node_id, name from nodes where entity_type = 'class' order by node_id limit 200"))
def graph_extract(spark, folder):
    graph = estate(spark, folder)
    return C.graph_extract(graph.nodes, graph.edges, "class", 200)[0].select("node_id", "name")


@query("graph_extract_edges", _graph_check("select src, dst, relationship_type from edges order by src, dst, relationship_type limit 5000"))
def graph_extract_edges(spark, folder):
    graph = estate(spark, folder)
    return C.graph_extract(graph.nodes, graph.edges, "class", 200)[1].select("src", "dst", "relationship_type")


@query("search_nodes", with_inputs("""
with tokenized as (select *, list_distinct(regexp_extract_all(lower(concat_ws(' ', name, label, entity_key)), '[a-z0-9]+')) as t from nodes),
stats as (select count(*) as n, count(*) filter (where list_contains(t, 'red')) as a, count(*) filter (where list_contains(t, 'widget')) as b,
  count(*) filter (where list_contains(t, 'file')) as c from tokenized),
scored as (select node_id, round(case when list_contains(t, 'file') then ln(1 + n / c) else 0 end + case when list_contains(t, 'red') then ln(1 + n / a) else 0 end
  + case when list_contains(t, 'widget') then ln(1 + n / b) else 0 end, 6) as score from tokenized, stats
  where entity_type = 'file' and list_has_any(t, ['red', 'widget', 'file']))
select 'estate' as repository_id, node_id, score, row_number() over (order by score desc, node_id) as rank from scored qualify rank <= 50""", "nodes"))
def search_nodes(spark, folder):
    return SE.search_nodes(estate(spark, folder).nodes, "Red widget file", "file", 50)


@query("search_nodes_contains", with_inputs("""
select node_id, rank from (select node_id, row_number() over (order by node_id) as rank from nodes
  where contains(lower(name), 'supplier#00000001') or contains(lower(label), 'supplier#00000001') or contains(lower(entity_key), 'supplier#00000001')) t
where rank <= 50""", "nodes"))
def search_nodes_contains(spark, folder):
    return SE.search_nodes_contains(estate(spark, folder).nodes, "SUPPLIER#00000001").select("node_id", "rank")
