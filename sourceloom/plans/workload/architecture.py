"""Architecture inference and impact queries over the estate graph and the derived sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.operators import architecture as A
from sourceloom.operators import degrees as D
from sourceloom.operators import impact as I
from sourceloom.operators import reports as RP
from sourceloom.operators import traverse as T
from sourceloom.plans.workload.adapters import DEGREES, _once, estate, estate_depth, roots, source_graph, with_inputs
from sourceloom.plans.workload.registry import query
from sourceloom.plans.workload.symbols import SHAPE, SOURCE_EDGES, SOURCE_NODES
from sourceloom.session import stored


def _any(text: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + ")"


_TEXT = "lower(concat(entity_type, ' ', name, ' ', label, ' ', coalesce(file_path, ''), ' ', coalesce(module, '')))"
_RULES = "case " + " ".join(
    f"when {_any('hay', patterns)} then {{'t': '{kind}', 'l': '{layer}', 'c': 0.9}}" for kind, layer, patterns in V.LAYER_RULES)
_RULES += " " + " ".join(f"when entity_type = '{k}' then {{'t': '{k}', 'l': '{layer}', 'c': {c}}}" for k, (layer, c) in V.FALLBACK_LAYERS.items())
_RULES += " else {'t': entity_type, 'l': 'infrastructure', 'c': 0.4} end"
_KINDS = ", ".join(f"'{t}'" for t in V.COMPONENT_ENTITY_TYPES)
_BY_NAME = """case when entity_type in ('class', 'function') and v.t in ('class', 'function') then
  case when contains(lower(name), 'service') then 'service' when contains(lower(name), 'repository') or suffix(lower(name), 'repo') then 'repository'
    when contains(lower(name), 'controller') or contains(lower(name), 'handler') then 'controller' end end"""
COMPONENTS = f"""
with ruled as (select *, {_RULES} as v from (select *, {_TEXT} as hay from nodes) h),
components as (
  select repository_id, node_id, entity_type, label as name, coalesce({_BY_NAME}, v.t) as component_type, coalesce({_BY_NAME}, v.l) as layer,
    file_path as path, case when {_BY_NAME} is not null then 0.85 else cast(v.c as double) end as confidence
  from ruled where entity_type in ({_KINDS})),
clinks as (select s.layer as src_layer, t.layer as dst_layer, s.name as src_name, t.name as dst_name, e.relationship_type
  from edges e join components s on s.node_id = e.src join components t on t.node_id = e.dst)
"""
METRICS = """, counted as (
  select count(*) as component_count, count(distinct layer) as layer_count, count(*) filter (where component_type = 'service') as service_count,
    count(*) filter (where component_type = 'controller') as controller_count, count(*) filter (where component_type = 'repository') as repository_count,
    count(*) filter (where layer = 'api') as api_count, count(*) filter (where layer = 'data') as database_count from components),
crossed as (select count(*) filter (where src_layer <> dst_layer) as cross_layer_edges, count(*) filter (where src_layer = dst_layer) as internal_edges from clinks),
rates as (select *, round(cross_layer_edges / (cross_layer_edges + internal_edges), 3) as layer_coupling,
  round(internal_edges / (cross_layer_edges + internal_edges), 3) as layer_cohesion from counted, crossed),
shaped as (select *, round(layer_count * 2 + layer_coupling * 30 + component_count / 25, 2) as architecture_complexity from rates),
metrics as (select 'estate' as repository_id, *, cast(greatest(0, least(100, trunc(100 - layer_coupling * 35 - greatest(0, architecture_complexity - 20)))) as int) as health_score from shaped),
findings as (
  select 'direct_database_access' as pattern_type, 'high' as severity, 'Direct database access from upper layers' as title,
    count(*) as evidence_count from clinks where src_layer in ('presentation', 'api', 'controller') and dst_layer = 'data' having count(*) > 0
  union all select 'missing_repository_pattern', 'medium', 'Missing repository boundary', 0 from metrics where repository_count = 0 and database_count > 0
  union all select 'high_coupling', 'high', 'High cross-layer coupling', 1 from metrics where layer_coupling > 0.65
  union all select 'large_layer', 'medium', concat('Large ', layer, ' layer'), 1 from components group by layer having count(*) > 50)
"""


def _check(select: str, more: str = "", recursive: bool = False) -> str:
    return with_inputs(COMPONENTS + more + select, "nodes", "edges", recursive=recursive)


def _components(spark, folder):
    """Components of the estate, written once per session and folder."""
    return _once(spark, folder, "components", lambda: stored(
        A.detect_components(estate(spark, folder).nodes), "estate-components"))


def _metrics(spark, folder):
    return A.layer_metrics(_components(spark, folder), estate(spark, folder).edges)


def _findings(spark, folder):
    components = _components(spark, folder)
    return A.anti_patterns(components, estate(spark, folder).edges, _metrics(spark, folder))


def _framework(name: str) -> str:
    return f"case when bool_or({_any('p', V.FRAMEWORK_PATTERNS[name])}) then '{name}' end"


_FRAMEWORKS = "concat_ws(',', " + ", ".join(_framework(n) for n in V.FRAMEWORK_PATTERNS) + ")"


@query("detect_frameworks", with_inputs(f"""
with t as (select concat(repository_id, '-', entity_type) as repository_id, lower(coalesce(file_path, entity_key)) as p from nodes),
f as (select repository_id, {_FRAMEWORKS} as frameworks from t group by repository_id)
select repository_id, case when frameworks = '' then 'Unknown' else frameworks end as frameworks from f""", "nodes"))
def detect_frameworks(spark, folder):
    nodes = estate(spark, folder).nodes.withColumn("repository_id", F.concat_ws("-", "repository_id", "entity_type"))
    return A.detect_frameworks(nodes).select("repository_id", F.array_join("frameworks", ",").alias("frameworks"))


@query("build_status", with_inputs(f"""
with t as (select concat(repository_id, '-', entity_type) as repository_id, lower(coalesce(file_path, entity_key)) as p from nodes),
f as (select repository_id, {_FRAMEWORKS} as frameworks from t group by repository_id)
select repository_id, case when frameworks = '' then 'completed_with_warnings' else 'completed' end as status,
  case when frameworks = '' then 'No supported framework was confidently detected.' end as warning from f""", "nodes"))
def build_status(spark, folder):
    nodes = estate(spark, folder).nodes.withColumn("repository_id", F.concat_ws("-", "repository_id", "entity_type"))
    return A.build_status(A.detect_frameworks(nodes)).select("repository_id", "status", "warning")


@query("classify_layer", _check("select node_id, v.t as component_type, v.l as layer, cast(v.c as double) as confidence from ruled"))
def classify_layer(spark, folder):
    return A.classify(estate(spark, folder).nodes).select("node_id", "component_type", "layer", "confidence")


@query("detect_components", _check("select * from components"))
def detect_components(spark, folder):
    return A.detect_components(estate(spark, folder).nodes)


@query("layer_metrics", _check("select * from metrics", METRICS))
def layer_metrics(spark, folder):
    return _metrics(spark, folder)


@query("illegal_access", _check("""
select src_name, dst_name, relationship_type from clinks where src_layer in ('presentation', 'api', 'controller') and dst_layer = 'data'"""))
def illegal_access(spark, folder):
    return A.illegal_access(_components(spark, folder), estate(spark, folder).edges).select("src_name", "dst_name", "relationship_type")


@query("illegal_access_evidence", _check("""
select src_name as source, dst_name as target, relationship_type, row_number() over (order by src_name, dst_name, relationship_type) as rank
from clinks where src_layer in ('presentation', 'api', 'controller') and dst_layer = 'data' qualify rank <= 10"""))
def illegal_access_evidence(spark, folder):
    return A.illegal_access_evidence(A.illegal_access(_components(spark, folder), estate(spark, folder).edges)).drop("repository_id")


@query("large_layers", _check("select layer, count(*) as components from components group by layer having count(*) > 50"))
def large_layers(spark, folder):
    return A.large_layers(_components(spark, folder)).select("layer", "components")


@query("anti_patterns", _check("select * from findings", METRICS))
def anti_patterns(spark, folder):
    return A.list_anti_patterns(_findings(spark, folder)).drop("repository_id")


_SAYS = """
, proof as (
  select 'direct_database_access' as pattern_type, 'Direct database access from upper layers' as title, src_name || '>' || dst_name || ':' || relationship_type as item,
    row_number() over (order by src_name, dst_name, relationship_type) as k from clinks where src_layer in ('presentation', 'api', 'controller') and dst_layer = 'data'
  union all select 'high_coupling', 'High cross-layer coupling', printf('%.3f', layer_coupling), 1 from metrics where layer_coupling > 0.65
  union all select 'large_layer', concat('Large ', layer, ' layer'), layer || '=' || count(*), 1 from components group by layer having count(*) > 50),
said as (select f.*, case pattern_type when 'direct_database_access' then 'Routes or controllers appear to depend directly on data-layer components.'
    when 'missing_repository_pattern' then 'Data-layer components exist but no repository components were detected.'
    when 'high_coupling' then 'Most relationships cross architecture layer boundaries.'
    else 'The ' || split_part(title, ' ', 2) || ' layer contains ' || (select count(*) from components c where c.layer = split_part(f.title, ' ', 2)) || ' inferred components.' end as description,
  case pattern_type when 'direct_database_access' then 'Introduce a service/repository boundary and route database access through it.'
    when 'missing_repository_pattern' then 'Add repository/DAO components to isolate persistence access.'
    when 'high_coupling' then 'Reduce direct cross-layer dependencies and introduce stable interfaces.'
    else 'Split large areas into cohesive subsystems.' end as recommendation,
  (select string_agg(item, '; ' order by k) from proof p where p.pattern_type = f.pattern_type and p.title = f.title and k <= 10) as evidence from findings f)
"""


def _findings_report(spark, folder):
    return RP.findings_report(_components(spark, folder), estate(spark, folder).edges, _metrics(spark, folder))


@query("anti_pattern_report", _check("select * from said", METRICS + _SAYS))
def anti_pattern_report(spark, folder):
    item = F.expr("""array_join(transform(evidence, e -> case when e.target is not null then concat(e.source, '>', e.target, ':', e.relationship_type)
      when e.source is not null then concat(e.source, '=', cast(e.value as bigint)) else format_string('%.3f', e.value) end), '; ')""")
    return _findings_report(spark, folder).withColumn("evidence", item).drop("repository_id")


@query("layers_grouped", _check("""
select layer, count(*) as component_count, string_agg(name, ',' order by k) filter (where k <= 20) as components
from (select *, row_number() over (partition by layer order by name, node_id) as k from components) t group by layer"""))
def layers_grouped(spark, folder):
    return RP.layers_grouped(_components(spark, folder)).select("layer", "component_count", F.array_join("components.name", ",").alias("components"))


@query("architecture_report", _check("""
, s as (select greatest(0, least(100, health_score - coalesce((select sum(case severity when 'critical' then 20 when 'high' then 12 when 'medium' then 7 when 'low' then 3 else 5 end) from findings), 0))) as score from metrics)
select 'estate' as repository_id, score, (select string_agg(layer || '=' || n, ',' order by layer) from (select layer, count(*) as n from components group by layer)) as layers,
  (select string_agg(pattern_type || '=' || evidence_count, ',' order by pattern_type, severity, title) from findings) as findings from s""", METRICS))
def architecture_report(spark, folder):
    health = A.architecture_health(_metrics(spark, folder), _findings(spark, folder))
    report = RP.architecture_report(health, _components(spark, folder), _findings_report(spark, folder))
    pairs = "array_join(transform({0}, x -> concat(x.{1}, '=', x.{2})), ',')"
    return report.select("repository_id", "score", F.expr(pairs.format("layers", "layer", "component_count")).alias("layers"),
                         F.expr(pairs.format("findings", "pattern_type", "evidence_count")).alias("findings"))


@query("dependency_report", with_inputs(DEGREES + """
, pairs as (select distinct src, dst from edges where relationship_type in ('imports', 'uses', 'calls', 'inherits')),
walk(root, node, depth) using key (root, node) as (select distinct src, src, 0 from pairs union
  select w.root, p.dst, min(w.depth + 1) from walk w join pairs p on p.src = w.node
  where not exists (from recurring.walk k where k.root = w.root and k.node = p.dst) group by w.root, p.dst),
idle as (select entity_type, count(*) as n from nodes where node_id not in (select dst from edges where relationship_type in ('imports', 'calls', 'uses')) group by 1),
best as (select min_by(node_id, (-in_degree, node_id)) filter (where entity_type = 'file' and in_degree > 0) as f,
  min_by(node_id, (-in_degree, node_id)) filter (where entity_type = 'function' and in_degree > 0) as g from deg)
select 'estate' as repository_id, (select max(depth) from walk) as dependency_depth, coalesce((select n from idle where entity_type = 'file'), 0) as unused_files,
  coalesce((select n from idle where entity_type = 'function'), 0) as unused_functions, (select label from nodes where node_id = f) as most_referenced_file_label,
  (select label from nodes where node_id = g) as most_referenced_function_label from best""", "nodes", "edges", recursive=True))
def dependency_report(spark, folder):
    graph = estate(spark, folder)
    metrics = D.dependency_metrics(D.degrees(graph.nodes, graph.edges))
    return RP.dependency_report(graph.nodes, graph.edges, metrics, estate_depth(spark, folder)).select(
        "repository_id", "dependency_depth", "unused_files", "unused_functions", "most_referenced_file_label", "most_referenced_function_label")


@query("architecture_health", _check("""
, s as (select greatest(0, least(100, health_score - coalesce((select sum(case severity when 'critical' then 20 when 'high' then 12 when 'medium' then 7 when 'low' then 3 else 5 end) from findings), 0))) as score from metrics)
select 'estate' as repository_id, score, case when score >= 85 then 'low' when score >= 65 then 'medium' when score >= 40 then 'high' else 'critical' end as risk,
  (select string_agg(distinct title, ';' order by title) from findings) as reasons from s""", METRICS))
def architecture_health(spark, folder):
    return A.architecture_health(_metrics(spark, folder), _findings(spark, folder)).withColumn("reasons", F.array_join("reasons", ";"))


@query("list_components", _check("select node_id, name, layer from components where layer = 'service' and component_type = 'service'"))
def list_components(spark, folder):
    return A.list_components(_components(spark, folder), "service", "service").select("node_id", "name", "layer")


@query("component_counts", _check("select repository_id, layer, component_type, count(*) as components from components group by 1, 2, 3"))
def component_counts(spark, folder):
    return A.component_counts(_components(spark, folder))


@query("routes", _check("""
select node_id, layer, component_type from components where layer = 'api' union all select node_id, layer, component_type from components where component_type = 'controller'"""))
def routes(spark, folder):
    return A.routes(_components(spark, folder)).select("node_id", "layer", "component_type")


@query("request_flows", _check("""
, entries as (select node_id as root, name, layer from (select *, row_number() over (order by entity_type, name, node_id) as r
    from components where layer in ('api', 'controller', 'presentation')) t where r <= 25),
pairs as (select distinct src, dst from edges where src in (select node_id from components) and dst in (select node_id from components)),
trails(root, node, path) as (select root, root, [root] from entries union all
  select t.root, p.dst, list_append(t.path, p.dst) from trails t join pairs p on p.src = t.node where len(t.path) < 6 and not list_contains(t.path, p.dst)),
short as (select root, node, path, rank() over (partition by root, node order by len(path), path) as r from trails),
best as (select root, min_by(path, (-len(path), path)) as path from short where r = 1 group by root),
steps as (select b.root, i, c.layer, row_number() over (partition by b.root, c.layer order by i) as nth
  from best b, lateral (select unnest(range(1, len(b.path) + 1)) as i) g join components c on c.node_id = b.path[i]),
layers as (select root, string_agg(layer, ',' order by i) as layers, count(*) as n from steps where nth = 1 group by root)
select e.root as entry_node, e.name || ' request flow' as name, array_to_string(b.path, '>') as path, l.layers,
  case when l.n >= 3 then 0.7 else 0.5 end as confidence
from entries e join best b on b.root = e.root join layers l on l.root = e.root where l.n >= 2 or e.layer = 'api'""", recursive=True))
def request_flows(spark, folder):
    flows = T.request_flows(_components(spark, folder), estate(spark, folder).edges)
    return flows.select("entry_node", "name", F.array_join("path", ">").alias("path"), F.array_join("layers", ",").alias("layers"), "confidence")


_SOURCE_KINDS = "'file', 'module', 'class', 'function'"


@query("source_component_counts", SHAPE.strip() + SOURCE_NODES + f"""
select repository_id, 'domain' as layer, entity_type as component_type, count(*) as components from g_nodes
where entity_type in ({_SOURCE_KINDS}) group by 1, 3""")
def source_component_counts(spark, folder):
    return A.component_counts(A.detect_components(source_graph(spark, folder).nodes))


@query("source_layer_metrics", SHAPE.strip() + SOURCE_NODES + SOURCE_EDGES + f"""
, n as (select repository_id, count(*) as component_count from g_nodes where entity_type in ({_SOURCE_KINDS}) group by 1),
e as (select repository_id, count(*) as internal_edges from g_edges where split_part(src, ':', 1) in ({_SOURCE_KINDS}) and split_part(dst, ':', 1) in ({_SOURCE_KINDS}) group by 1)
select n.repository_id, component_count, 0 as cross_layer_edges, internal_edges, 0.0 as layer_coupling, 1.0 as layer_cohesion,
  round(2 + component_count / 25, 2) as architecture_complexity, cast(greatest(0, trunc(100 - greatest(0, round(2 + component_count / 25, 2) - 20))) as int) as health_score
from n join e on e.repository_id = n.repository_id""")
def source_layer_metrics(spark, folder):
    graph = source_graph(spark, folder)
    return A.layer_metrics(A.detect_components(graph.nodes), graph.edges).select(
        "repository_id", "component_count", "cross_layer_edges", "internal_edges", "layer_coupling", "layer_cohesion",
        "architecture_complexity", "health_score")


# ---- impact --------------------------------------------------------------------------------
_RADIUS = """, back(root, node, depth) as (select root, root, 0 from roots union
    select w.root, e.src, w.depth + 1 from back w join (select distinct src, dst from edges) e on e.dst = w.node where w.depth < 4),
radius as (select root, node, min(depth) as depth from back where node <> root group by root, node)
"""


def _impact_check(select: str, more: str = "") -> str:
    return with_inputs(DEGREES + _RADIUS + more + select, "nodes", "edges", recursive=True)


def _radius(spark, folder):
    return T.blast_radius(estate(spark, folder).edges, roots(spark, folder), 4)


@query("affected_by_type", _impact_check("""
select r.root, n.entity_type, count(*) filter (where depth = 1) as direct, count(*) filter (where depth > 1) as indirect, count(*) as affected
from radius r join nodes n on n.node_id = r.node group by 1, 2"""))
def affected_by_type(spark, folder):
    return I.affected_by_type(_radius(spark, folder), estate(spark, folder).nodes)


@query("impact_summary", _impact_check("""
select root, count(*) filter (where c.entity_type = 'file') as files_affected, count(*) filter (where c.entity_type = 'function') as functions_affected,
  count(*) filter (where c.entity_type = 'class') as classes_affected, count(*) filter (where component_type = 'service') as services_affected,
  count(*) filter (where layer = 'api') as apis_affected, count(*) filter (where layer = 'data') as databases_affected
from radius r join components c on c.node_id = r.node group by root""", ", " + COMPONENTS.strip()[5:]))
def impact_summary(spark, folder):
    return I.impact_summary(_radius(spark, folder), _components(spark, folder))


_KEPT = """, kept as (select r.* from radius r join nodes n on n.node_id = r.node where depth <= 2 and entity_type in ('class', 'function'))
"""


@query("impact_graph_nodes", _impact_check("select root, node, depth, case when depth = 1 then 'direct' else 'indirect' end as impact from kept", _KEPT))
def impact_graph_nodes(spark, folder):
    graph = estate(spark, folder)
    return I.impact_graph(_radius(spark, folder), graph.nodes, graph.edges, 2, ["class", "function"])[0].select("root", "node", "depth", "impact")


@query("impact_graph_edges", _impact_check("""
select a.root, src, dst, relationship_type from edges e join kept a on a.node = e.src join kept b on b.root = a.root and b.node = e.dst
where relationship_type = 'uses'""", _KEPT))
def impact_graph_edges(spark, folder):
    graph = estate(spark, folder)
    found = I.impact_graph(_radius(spark, folder), graph.nodes, graph.edges, 2, ["class", "function"], "uses")[1]
    return found.select("root", "src", "dst", "relationship_type")


_RISKY = """, risks as (select node_id, case when s >= 0.95 then 'Critical' when s >= 0.8 then 'High' when s >= 0.5 then 'Medium' else 'Low' end as risk
  from (select *, (rank() over (partition by entity_type order by in_degree) - 1) / count(*) over (partition by entity_type) as s from deg) t),
kept as (select r.root, r.node from radius r join nodes n on n.node_id = r.node join risks k on k.node_id = r.node
  where depth <= 3 and k.risk = 'High' and n.file_path like '%.py')
"""


def _risky(spark, folder):
    graph = estate(spark, folder)
    risks = I.risk_level(D.degrees(graph.nodes, graph.edges))
    return I.impact_graph(_radius(spark, folder), graph.nodes, graph.edges, 3, relationship="imports", risks=risks, risk="High", language="Python")


@query("impact_graph_risky_nodes", _impact_check("select root, node from kept", _RISKY))
def impact_graph_risky_nodes(spark, folder):
    return _risky(spark, folder)[0].select("root", "node")


@query("impact_graph_risky_edges", _impact_check("""
select a.root, src, dst from edges e join kept a on a.node = e.src join kept b on b.root = a.root and b.node = e.dst
where relationship_type = 'imports'""", _RISKY))
def impact_graph_risky_edges(spark, folder):
    return _risky(spark, folder)[1].select("root", "src", "dst")


def _unused(kind: str) -> str:
    return with_inputs(f"""select repository_id, node_id from nodes where entity_type = '{kind}'
      and node_id not in (select dst from edges where relationship_type in ('imports', 'calls', 'uses'))""", "nodes", "edges")


@query("unused_files", _unused("file"))
def unused_files(spark, folder):
    graph = estate(spark, folder)
    return I.unused(graph.nodes, graph.edges, "file")


@query("unused_functions", _unused("function"))
def unused_functions(spark, folder):
    graph = estate(spark, folder)
    return I.unused(graph.nodes, graph.edges, "function")


@query("risk_level", with_inputs(DEGREES + """
select node_id, in_degree, case when s >= 0.95 then 'Critical' when s >= 0.8 then 'High' when s >= 0.5 then 'Medium' else 'Low' end as risk
from (select *, (rank() over (partition by entity_type order by in_degree) - 1) / count(*) over (partition by entity_type) as s from deg) t""", "nodes", "edges"))
def risk_level(spark, folder):
    graph = estate(spark, folder)
    return I.risk_level(D.degrees(graph.nodes, graph.edges)).select("node_id", "in_degree", "risk")


@query("critical_path", _impact_check("""
, near as (select root, node, depth from radius union all select root, root, 0 from roots),
trail(root, node, depth, path) as (select root, root, 0, [root] from roots union all
  select t.root, e.src, t.depth + 1, list_append(t.path, e.src) from trail t join (select distinct src, dst from edges) e on e.dst = t.node
    join near n on n.root = t.root and n.node = e.src and n.depth = t.depth + 1)
select root, array_to_string(min_by(path, (-depth, path)), '>') as path, max(depth) as length from trail group by root"""))
def critical_path(spark, folder):
    return I.critical_path(estate(spark, folder).edges, roots(spark, folder), 4).withColumn("path", F.array_join("path", ">"))
