"""Symbol extraction and graph building over Python sources derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.operators import catalog as C
from sourceloom.operators import degrees as D
from sourceloom.operators import graph_build as G
from sourceloom.operators import reports as RP
from sourceloom.operators import rollups as R
from sourceloom.operators import symbols as X
from sourceloom.plans.workload.adapters import load, source_graph, source_run, with_inputs
from sourceloom.plans.workload.registry import query

# The shape of the derived sources, from which every expected symbol follows.
SHAPE = """
with o as (
  select concat('repo', o.o_orderkey % 8) as repository_id, o.o_orderkey as k, c.c_nationkey as n,
    p.o_orderkey as pk, pc.c_nationkey as pn,
    concat('pkg', c.c_nationkey) as pkg, concat('pkg', c.c_nationkey, '.m', o.o_orderkey) as module,
    concat('pkg', c.c_nationkey, '/m', o.o_orderkey, '.py') as file_path,
    concat('pkg', pc.c_nationkey, '.m', p.o_orderkey) as prev_module,
    concat('pkg', pc.c_nationkey, '/m', p.o_orderkey, '.py') as prev_file
  from orders o join customer c on o.o_custkey = c.c_custkey
  left join orders p on p.o_orderkey = o.o_orderkey - 8
  left join customer pc on p.o_custkey = pc.c_custkey),
packs as (select distinct repository_id, pkg from o),
fns as (
  select repository_id, file_path, module, k, pk, 'run' as name, concat('C', k) as class_name, concat(module, '.C', k, '.run') as qualified_name,
    'public' as visibility, false as is_async, 4 as params, concat('mod.C', coalesce(pk, k), '[int]') as return_type from o
  union all select repository_id, file_path, module, k, pk, '_load', concat('C', k), concat(module, '.C', k, '._load'), 'protected', true, 1, null from o
  union all select repository_id, file_path, module, k, pk, concat('helper_', k), null, concat(module, '.helper_', k), 'public', false, 1, 'int' from o),
cls as (select repository_id, file_path, module, k, pk, concat('C', k) as name, concat(module, '.C', k) as qualified_name from o),
imps as (
  select repository_id, file_path, module as owner, 'os' as module, null as imported_name, null as alias, 0 as level, 2 as line_number from o
  union all select repository_id, file_path, module, prev_module, null, 'prev', 0, 3 from o where pk is not null
  union all select repository_id, file_path, module, prev_module || '.inner', 'thing', null, 0, 4 from o where pk is not null
  union all select repository_id, file_path, module, '', 'sibling', null, 1, case when pk is null then 3 else 5 end from o)
"""


def _check(select: str, more: str = "") -> str:
    return SHAPE.strip() + more + select


@query("extract_functions", _check("""
select repository_id, file_path, module, name, class_name, qualified_name, visibility, is_async, params + 
  case when name = 'run' then 1 else 0 end as params, return_type from fns"""))
def extract_functions(spark, folder):
    return source_run(spark, folder).functions.select(
        "repository_id", "file_path", "module", "name", "class_name", "qualified_name", "visibility", "is_async",
        F.size("parameters").alias("params"), "return_type")


@query("extract_classes", _check("""
select repository_id, file_path, module, name, qualified_name, case when pk is null then '' else concat('base.C', pk) end as bases,
  concat(split_part(module, '.', 1), '.register') as decorators, concat('Class ', k, '.') as docstring,
  case when pk is null then 6 else 8 end as start_line, case when pk is null then 12 else 14 end as end_line from cls"""))
def extract_classes(spark, folder):
    return source_run(spark, folder).classes.select(
        "repository_id", "file_path", "module", "name", "qualified_name", F.array_join("bases", ",").alias("bases"),
        F.array_join("decorators", ",").alias("decorators"), "docstring", "start_line", "end_line")


@query("extract_imports", _check("select repository_id, file_path, module, imported_name, alias, level, line_number from imps"))
def extract_imports(spark, folder):
    return source_run(spark, folder).imports


@query("extract_modules", _check("""
select repository_id, file_path, module as name, pkg as package, false as is_package, concat('Order ', k, '.') as docstring from o
union all select repository_id, concat(pkg, '/__init__.py'), pkg, null, true, null from packs"""))
def extract_modules(spark, folder):
    return source_run(spark, folder).modules


@query("explode_parameters", _check("""
select repository_id, qualified_name, position, name, type, dflt as default_value, kind from (
  select repository_id, qualified_name, 0 as position, 'self' as name, null as type, null as dflt, 'positional' as kind from fns where class_name is not null
  union all select repository_id, qualified_name, 1, 'a', concat('''C', k, ''''), null, 'positional' from fns where name = 'run'
  union all select repository_id, qualified_name, 2, 'args', null, null, 'vararg' from fns where name = 'run'
  union all select f.repository_id, qualified_name, 3, 'limit', 'int', cast(o.n as varchar), 'keyword_only' from fns f join o on o.k = f.k where name = 'run'
  union all select repository_id, qualified_name, 4, 'extra', null, null, 'kwarg' from fns where name = 'run'
  union all select repository_id, qualified_name, 0, 'x', 'int', '0', 'positional' from fns where class_name is null) t"""))
def explode_parameters(spark, folder):
    return X.parameters_of(source_run(spark, folder).functions).select(
        "repository_id", "qualified_name", "position", "name", "type", F.col("default").alias("default_value"), "kind")


@query("repository_metrics", with_inputs(_check("""
select f.repository_id, f.files as total_files, f.folders as total_folders, z.lines_of_code, z.languages, z.largest_file_path, z.largest_file_size,
  z.largest_folder_path, z.largest_folder_size, f.files - f.folders as classes, 3 * (f.files - f.folders) as functions,
  f.files as modules, f.folders as packages, i.imports
from (select repository_id, count(*) + count(distinct pkg) as files, count(distinct pkg) as folders from o group by repository_id) f
join (select repository_id, count(*) as imports from imps group by repository_id) i on i.repository_id = f.repository_id
join (select repository_id, sum(case when b = 0 then 0 else lines end) as lines_of_code, 1 as languages, min_by(path, (-b, path)) as largest_file_path,
  max(b) as largest_file_size, '' as largest_folder_path, sum(b) as largest_folder_size from sizes group by repository_id) z on z.repository_id = f.repository_id""", """,
sizes as (select repository_id, path, strlen(text) as b, len(string_split(text, chr(10))) - 1 as lines from sources)"""), "sources"))
def repository_metrics(spark, folder):
    return source_run(spark, folder).metrics().select(
        "repository_id", "total_files", "total_folders", "lines_of_code", "languages", "largest_file_path", "largest_file_size",
        "largest_folder_path", "largest_folder_size", "classes", "functions", "modules", "packages", "imports")


@query("repository_sizes", with_inputs("""
with f as (select repository_id, path, strlen(text) as b, len(string_split(text, chr(10))) - 1 as lines from sources)
select repository_id, sum(case when b = 0 then 0 else lines end) as lines_of_code, 1 as languages, max(b) as largest_file_size, min_by(path, (-b, path)) as largest_file_path,
  '' as largest_folder_path, sum(b) as largest_folder_size from f group by repository_id""", "sources"))
def repository_sizes(spark, folder):
    return source_run(spark, folder).metrics().select(
        "repository_id", "lines_of_code", "languages", "largest_file_size", "largest_file_path", "largest_folder_path", "largest_folder_size")


@query("run_summary", _check("""
select repository_id, count(*) + count(distinct pkg) as files_discovered, count(*) + count(distinct pkg) as files_parsed,
  0 as errors_count, 'completed' as status from o group by repository_id"""))
def run_summary(spark, folder):
    return source_run(spark, folder).summary()


@query("analysis_report", _check("""
select f.repository_id, 'completed' as status, f.files as files_discovered, f.files as total_files, 3 * (f.files - f.folders) as functions, i.imports,
  concat('Python=', f.files) as languages
from (select repository_id, count(*) + count(distinct pkg) as files, count(distinct pkg) as folders from o group by repository_id) f
join (select repository_id, count(*) as imports from imps group by repository_id) i on i.repository_id = f.repository_id"""))
def analysis_report(spark, folder):
    run = source_run(spark, folder)
    return RP.analysis_report(run.summary(), run.metrics(), run.languages(), run.warnings).select(
        "repository_id", "status", "files_discovered", "total_files", "functions", "imports",
        F.expr("array_join(transform(language_list, l -> concat(l.language, '=', l.file_count)), ',')").alias("languages"))


@query("import_frequency", _check("""
select repository_id, case when imported_name is null then module else concat(module, '.', imported_name) end as target,
  case when level > 0 then 'internal' else 'external' end as scope, count(*) as import_count from imps group by 1, 2, 3"""))
def import_frequency(spark, folder):
    return R.import_frequency(source_run(spark, folder).imports)


@query("symbol_table_functions", _check("""
select repository_id, qualified_name, 2 as lines, case when is_async then 'Medium' else 'Low' end as complexity,
  params + case when name = 'run' then 1 else 0 end as params, coalesce(return_type, 'Unknown') as return_type from fns"""))
def symbol_table_functions(spark, folder):
    return R.symbol_table_functions(source_run(spark, folder).functions).select(
        "repository_id", "qualified_name", "lines", "complexity", "params", "return_type")


@query("symbol_table_classes", _check("""
select repository_id, file_path, name, qualified_name, case when pk is null then 'None' else concat('base.C', pk) end as inheritance,
  2 as methods from cls"""))
def symbol_table_classes(spark, folder):
    run = source_run(spark, folder)
    return R.symbol_table_classes(run.classes, run.functions)


@query("symbol_filter", _check("""
select repository_id, file_path, name, 2 as lines from fns where (contains(lower(name), 'load') or contains(lower(file_path), 'load')) and file_path like 'pkg3/%'"""))
def symbol_filter(spark, folder):
    rows = R.symbol_table_functions(source_run(spark, folder).functions)
    return C.symbol_filter(rows, "LOAD", ".py", "pkg3").select("repository_id", "file_path", "name", "lines")


@query("imports_search", _check("select repository_id, file_path, module from imps where module ilike '%.M12.%'"))
def imports_search(spark, folder):
    return C.ilike_search(source_run(spark, folder).imports, "imports", ".M12.").select("repository_id", "file_path", "module")


# ---- graph building ------------------------------------------------------------------------
SOURCE_NODES = """, g_nodes as (
  select distinct repository_id, concat('repository:', repository_id) as entity_key, 'repository' as entity_type, 'Repository' as label from o
  union all select repository_id, concat('file:', file_path), 'file', file_path from o
  union all select repository_id, concat('file:', pkg, '/__init__.py'), 'file', concat(pkg, '/__init__.py') from packs
  union all select repository_id, concat('package:', pkg), 'package', pkg from packs
  union all select repository_id, concat('module:', module), 'module', module from o
  union all select repository_id, concat('module:', pkg), 'module', pkg from packs
  union all select repository_id, concat('class:', qualified_name), 'class', qualified_name from cls
  union all select repository_id, concat('function:', qualified_name), 'function', qualified_name from fns
  union all select distinct repository_id, 'package:os', 'package', 'os' from o
  union all select distinct repository_id, 'package:unknown', 'package', 'unknown' from o)
"""
SOURCE_EDGES = """, g_fwd as (
  select repository_id, concat('file:', file_path) as src, concat('module:', module) as dst, 'contains' as t from o
  union all select repository_id, concat('file:', pkg, '/__init__.py'), concat('module:', pkg), 'contains' from packs
  union all select repository_id, concat('package:', pkg), concat('module:', module), 'contains' from o
  union all select repository_id, concat('package:', pkg), concat('module:', pkg), 'contains' from packs
  union all select repository_id, concat('module:', module), concat('class:', qualified_name), 'contains' from cls
  union all select repository_id, case when class_name is null then concat('module:', module) else concat('class:', module, '.', class_name) end,
    concat('function:', qualified_name), 'contains' from fns),
g_imports as (
  select distinct repository_id, concat('file:', file_path) as src, concat('file:', prev_file) as dst from o where pk is not null
  union select distinct repository_id, concat('module:', module), concat('module:', prev_module) from o where pk is not null
  union select distinct repository_id, concat('file:', file_path), 'package:os' from o
  union select distinct repository_id, concat('module:', module), 'package:os' from o),
g_uses as (
  select distinct f.repository_id, concat('function:', f.qualified_name) as src, concat('class:', c.qualified_name) as dst
  from fns f join cls c on c.repository_id = f.repository_id and (c.k = f.k or c.k = coalesce(f.pk, f.k)) where f.name = 'run'),
g_edges as (
  select repository_id, src, dst, t as relationship_type from g_fwd
  union all select repository_id, dst, src, 'belongs_to' from g_fwd
  union all select repository_id, concat('repository:', repository_id), concat('file:', file_path), 'contains' from o
  union all select repository_id, concat('repository:', repository_id), concat('file:', pkg, '/__init__.py'), 'contains' from packs
  union all select repository_id, concat('file:', file_path), concat('repository:', repository_id), 'belongs_to' from o
  union all select repository_id, concat('file:', pkg, '/__init__.py'), concat('repository:', repository_id), 'belongs_to' from packs
  union all select repository_id, src, dst, 'imports' from g_imports
  union all select repository_id, dst, src, 'imported_by' from g_imports
  union all select repository_id, src, dst, 'uses' from g_uses
  union all select repository_id, dst, src, 'used_by' from g_uses
  union all select c.repository_id, concat('class:', c.qualified_name), concat('class:', b.qualified_name), 'inherits'
    from cls c join cls b on b.k = c.pk
  union all select repository_id, concat('class:', qualified_name), concat('package:', split_part(module, '.', 1)), 'decorates' from cls)
"""


def _edges_of(types: str) -> str:
    return _check(f"select repository_id, src, dst, relationship_type from g_edges where relationship_type in ({types})", SOURCE_EDGES)


def _built(frame, nodes):
    """Validated and deduplicated edges of one builder."""
    return G.valid_edges(G.dedupe_edges(frame), nodes).select("repository_id", "src", "dst", "relationship_type")


@query("build_nodes", _check("select * from g_nodes", SOURCE_NODES))
def build_nodes(spark, folder):
    run = source_run(spark, folder)
    return G.build_nodes(run.files, run.modules, run.classes, run.functions, run.imports).select(
        "repository_id", "entity_key", "entity_type", "label")


@query("external_packages", _check("""
select distinct repository_id, 'os' as package from o union select distinct repository_id, 'unknown' from o"""))
def external_packages(spark, folder):
    run = source_run(spark, folder)
    return G.external_packages(run.imports, run.modules)


@query("containment_edges", _edges_of("'contains', 'belongs_to'"))
def containment_edges(spark, folder):
    run = source_run(spark, folder)
    return _built(G.containment_edges(run.files, run.modules, run.classes, run.functions), source_graph(spark, folder).nodes)


@query("inherits_edges", _edges_of("'inherits'"))
def inherits_edges(spark, folder):
    return _built(G.inherits_edges(source_run(spark, folder).classes), source_graph(spark, folder).nodes)


@query("uses_edges", _edges_of("'uses', 'used_by'"))
def uses_edges(spark, folder):
    run = source_run(spark, folder)
    return _built(G.uses_edges(run.functions, run.classes), source_graph(spark, folder).nodes)


@query("decorates_edges", _edges_of("'decorates'"))
def decorates_edges(spark, folder):
    run = source_run(spark, folder)
    return _built(G.decorates_edges(run.classes, run.functions), source_graph(spark, folder).nodes)


@query("resolve_imports", _check("""
select repository_id, file_path, module, line_number, case when module like 'pkg%' then split_part(module, '.inner', 1) end as target_module,
  case when module like 'pkg%' then replace(split_part(module, '.inner', 1), '.', '/') || '.py' end as target_file from imps"""))
def resolve_imports(spark, folder):
    run = source_run(spark, folder)
    return G.resolve_imports(run.imports, run.modules).select(
        "repository_id", "file_path", "module", "line_number", "target_module", "target_file")


@query("resolve_relative_imports", _check("""
select repository_id, file_path, line_number, split_part(file_path, '/', 1) as target_module from imps where level = 1"""))
def resolve_relative_imports(spark, folder):
    run = source_run(spark, folder)
    return G.resolve_imports(run.imports, run.modules, resolve_relative=True).where("level = 1").select(
        "repository_id", "file_path", "line_number", "target_module")


@query("imports_edges", _edges_of("'imports', 'imported_by'"))
def imports_edges(spark, folder):
    run = source_run(spark, folder)
    return _built(G.imports_edges(run.imports, run.modules), source_graph(spark, folder).nodes)


@query("import_lines", _check("""
select repository_id, concat('file:', file_path) as src, concat('file:', prev_file) as dst, '3,4' as lines from o where pk is not null"""))
def import_lines(spark, folder):
    run = source_run(spark, folder)
    edges = G.dedupe_edges(G.imports_edges(run.imports, run.modules))
    return edges.where("relationship_type = 'imports' and src like 'file:%' and dst like 'file:%'").select(
        "repository_id", "src", "dst", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("build_edges", _check("""
select repository_id, concat(repository_id, '/', src) as src, concat(repository_id, '/', dst) as dst, relationship_type,
  split_part(src, ':', 1) as source_type, split_part(dst, ':', 1) as target_type, 1 as depth, 1.0 as weight from g_edges""", SOURCE_EDGES))
def build_edges(spark, folder):
    return source_graph(spark, folder).edges.select(
        "repository_id", "src", "dst", "relationship_type", "source_type", "target_type", "depth", "weight")


@query("inverse_edges", _check("""
select repository_id, dst as src, src as dst, case relationship_type when 'imports' then 'imported_by' else 'used_by' end as relationship_type
from g_edges where relationship_type in ('imports', 'uses')""", SOURCE_EDGES))
def inverse_edges(spark, folder):
    edges = source_graph(spark, folder).edges
    bare = lambda c: F.regexp_replace(c, "^[^/]*/", "").alias(c)
    return G.inverse_edges(edges.select("repository_id", bare("src"), bare("dst"), "relationship_type"))


@query("call_edges", with_inputs("""
select 'estate' as repository_id, src, dst, 'calls' as relationship_type from edges where relationship_type = 'calls'
union all select 'estate', dst, src, 'called_by' from edges where relationship_type = 'calls'""", "edges"))
def call_edges(spark, folder):
    calls = load(spark, folder, "edges").where("relationship_type = 'calls'")
    return G.call_edges(calls).drop("line")


@query("source_relationship_distribution", _check("""
select repository_id, relationship_type, count(*) as edge_count from g_edges group by repository_id, relationship_type""", SOURCE_EDGES))
def source_relationship_distribution(spark, folder):
    return D.relationship_distribution(source_graph(spark, folder).edges)


@query("source_graph_counts", _check("""
select n.repository_id, n.c as total_nodes, e.c as total_edges from (select repository_id, count(*) as c from g_nodes group by 1) n
join (select repository_id, count(*) as c from g_edges group by 1) e on e.repository_id = n.repository_id""", SOURCE_NODES + SOURCE_EDGES))
def source_graph_counts(spark, folder):
    graph = source_graph(spark, folder)
    return D.graph_counts(graph.nodes, graph.edges)
