"""Driver tables shaped as operator inputs.

Each input is one SQL text with ``{table}`` placeholders, valid in Spark and in ANSI engines, so
the Spark query and its check start from the same rows. Every text reads its tables whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions.ranking import first_per_group
from sourceloom.operators.components import dependency_depth
from sourceloom.operators.degrees import degrees
from sourceloom.plans.analysis import Analysis, Graph, analyze, build_graph
from sourceloom.session import prepare, stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# ---- the estate graph ----------------------------------------------------------------------
NODES = """
select 'estate' as repository_id, node_id, node_id as entity_key, entity_type, name, label, file_path,
       cast(null as varchar(64)) as module
from (
  select concat('repository:', r_regionkey) as node_id, 'repository' as entity_type, r_name as name,
         r_name as label, cast(null as varchar(200)) as file_path from {region}
  union all select concat('package:', n_nationkey), 'package', n_name, n_name, null from {nation}
  union all select concat('module:', s_suppkey), 'module', s_name, s_name, null from {supplier}
  union all select concat('file:', p_partkey), 'file', p_name, p_name,
    concat(case p_partkey % 11 when 0 then 'src/components/' when 1 then 'api/' when 2 then 'services/'
             when 3 then 'repositories/' when 4 then 'models/' when 5 then 'domain/' when 6 then 'routers/'
             when 7 then 'jobs/' when 8 then 'handlers/' when 9 then 'database/' else 'lib/' end,
           lower(p_type), '_', p_partkey, case p_partkey % 3 when 0 then '.py' when 1 then '.ts' else '.tsx' end)
    from {part}
  union all select concat('class:', c_custkey), 'class',
    concat(c_name, case c_custkey % 6 when 0 then 'Service' when 1 then 'Repository' when 2 then 'Handler'
                     when 3 then 'Repo' else '' end), c_name, null from {customer}
  union all select concat('function:', o_orderkey), 'function', o_orderpriority, o_orderpriority, null from {orders}
) t
"""

EDGES = """
select 'estate' as repository_id, src, dst, relationship_type from (
  select concat('repository:', n_regionkey) as src, concat('package:', n_nationkey) as dst,
         'contains' as relationship_type from {nation}
  union all select concat('package:', n_nationkey), concat('repository:', n_regionkey), 'belongs_to' from {nation}
  union all select concat('package:', s_nationkey), concat('module:', s_suppkey), 'contains' from {supplier}
  union all select distinct concat('module:', l_suppkey), concat('file:', l_partkey), 'contains' from {lineitem}
  union all select distinct concat('file:', x.l_partkey), concat('file:', y.l_partkey), 'imports'
    from {lineitem} x join {lineitem} y on x.l_orderkey = y.l_orderkey and y.l_linenumber = x.l_linenumber + 1
    where x.l_partkey <> y.l_partkey
  union all select concat('class:', c_custkey), concat('class:', cast(floor(c_custkey / 2) as bigint)), 'inherits'
    from {customer} where c_custkey >= 1
  union all select concat('function:', o_orderkey), concat('class:', o_custkey), 'uses' from {orders}
  union all select src, dst, 'calls' from (
    select concat('function:', o_orderkey) as src,
           concat('function:', lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey)) as dst,
           lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as nxt
    from {orders}) t where nxt is not null
) e
"""

# The same rows for Spark: what is told apart are keys, not the longer texts made of them.
_LONG_EDGES = (
    """select distinct concat('module:', l_suppkey), concat('file:', l_partkey), 'contains' from {lineitem}""",
    """select distinct concat('file:', x.l_partkey), concat('file:', y.l_partkey), 'imports'
    from {lineitem} x join {lineitem} y on x.l_orderkey = y.l_orderkey and y.l_linenumber = x.l_linenumber + 1
    where x.l_partkey <> y.l_partkey""")
_SHORT_EDGES = (
    """select concat('module:', l_suppkey), concat('file:', l_partkey), 'contains' from (select distinct l_suppkey, l_partkey from {lineitem}) m""",
    """select concat('file:', a), concat('file:', b), 'imports' from (select distinct x.l_partkey as a, y.l_partkey as b
    from {lineitem} x join {lineitem} y on x.l_orderkey = y.l_orderkey and y.l_linenumber = x.l_linenumber + 1
    where x.l_partkey <> y.l_partkey) i""")


def _by_keys(edges: str) -> str:
    for long, short in zip(_LONG_EDGES, _SHORT_EDGES, strict=True):
        if long not in edges:
            raise ValueError("the edges of lineitem are not told apart as expected")
        edges = edges.replace(long, short)
    return edges


# ---- files and commits ---------------------------------------------------------------------
FILES = """
select doc_id, source as repository_id,
  concat(lang, '/', 'm', doc_id % 7, '/', 'f', doc_id,
    case doc_id % 8 when 0 then '.py' when 1 then '.ts' when 2 then '.jsx' when 3 then '.json'
                    when 4 then '.yml' when 5 then '.md' when 6 then '.txt' else '.pyi' end) as path,
  text
from {documents}
"""

COMMITS = """
select concat('repo', o_custkey % 3) as repository_id, o_orderkey as hash, o_custkey as author, o_orderdate as ts,
       o_orderstatus as branch, o_orderpriority as type from {orders}
"""

COMMIT_FILES = """
select l_orderkey as hash, concat('m', l_partkey % 40, '/f', l_partkey) as path,
       cast(sum(l_quantity) as bigint) as insertions, cast(sum(l_linenumber) as bigint) as deletions
from {lineitem} group by l_orderkey, l_partkey
"""

# ---- Python sources derived from orders ----------------------------------------------------
SOURCES = """
select concat('repo', o.o_orderkey % 8) as repository_id,
  concat('pkg', c.c_nationkey, '/m', o.o_orderkey, '.py') as path,
  concat('\"\"\"Order ', o.o_orderkey, '.\"\"\"', chr(10), 'import os', chr(10),
    case when p.o_orderkey is null then '' else
      concat('import pkg', pc.c_nationkey, '.m', p.o_orderkey, ' as prev', chr(10),
             'from pkg', pc.c_nationkey, '.m', p.o_orderkey, '.inner import thing', chr(10)) end,
    'from . import sibling', chr(10), chr(10),
    '@pkg', c.c_nationkey, '.register', chr(10),
    'class C', o.o_orderkey, case when p.o_orderkey is null then '' else concat('(base.C', p.o_orderkey, ')') end, ':', chr(10),
    '    \"\"\"Class ', o.o_orderkey, '.\"\"\"', chr(10),
    '    def run(self, a: \"C', o.o_orderkey, '\", *args, limit: int = ', c.c_nationkey, ', **extra) -> mod.C',
    case when p.o_orderkey is null then o.o_orderkey else p.o_orderkey end, '[int]:', chr(10),
    '        return a', chr(10), chr(10),
    '    async def _load(self):', chr(10), '        pass', chr(10), chr(10),
    'def helper_', o.o_orderkey, '(x: int = 0) -> int:', chr(10), '    return x', chr(10)) as text
from {orders} o join {customer} c on o.o_custkey = c.c_custkey
left join {orders} p on p.o_orderkey = o.o_orderkey - 8
left join {customer} pc on p.o_custkey = pc.c_custkey
union all
select distinct concat('repo', o.o_orderkey % 8), concat('pkg', c.c_nationkey, '/__init__.py'), ''
from {orders} o join {customer} c on o.o_custkey = c.c_custkey
"""

# ---- catalog -------------------------------------------------------------------------------
MEMBERS = """
select cast(n_regionkey as bigint) as workspace_id, c_custkey as user_id,
       case c_mktsegment when 'BUILDING' then 'owner' when 'MACHINERY' then 'admin' else 'member' end as role
from {customer} join {nation} on c_nationkey = n_nationkey
"""
WORKSPACES = "select cast(r_regionkey as bigint) as workspace_id, r_name as name from {region}"
PROJECTS = """
select cast(n_nationkey as bigint) as project_id, cast(n_regionkey as bigint) as workspace_id, n_name as name,
       coalesce(r, 0) as repository_count, cast(40 + n_nationkey * 2 as bigint) as health_score,
       case when n_nationkey % 5 = 0 then 'Critical' else 'Active' end as status
from {nation} left join (select s_nationkey, count(*) as r from {supplier} group by s_nationkey) s on s_nationkey = n_nationkey
"""
REPOSITORIES = """
select concat('repository:', s_suppkey) as repository_id, cast(s_nationkey as bigint) as project_id,
  cast(n_regionkey as bigint) as workspace_id, s_name as name, concat('balance ', cast(floor(s_acctbal) as bigint)) as description,
  case s_suppkey % 4 when 0 then 'uploaded' when 1 then 'connected' when 2 then 'archived' else 'pending' end as status,
  case s_suppkey % 3 when 0 then 'Private' when 1 then 'Internal' else 'Public' end as visibility,
  case s_suppkey % 2 when 0 then 'zip' else 'git' end as repo_type, s_suppkey as updated_at, -s_suppkey as created_at
from {supplier} join {nation} on s_nationkey = n_nationkey
"""
ACTIVITY = """
select e.event_id, e.ts, e.user_id, e.event_type as action, e.value,
  cast(json_k as bigint) % 30 as project_id, cast((json_k % 25) as bigint) as nation_id
from (select event_id, ts, user_id, event_type, value,
             cast(replace(replace(replace(props, '{{\"k\":', ''), '}}', ''), ' ', '') as bigint) as json_k from {events}) e
"""
RUNS = """
select concat('repo', o_custkey % 50) as repository_id, o_orderkey as id, o_orderdate as started_at,
  case o_orderkey % 6 when 0 then 'pending' when 1 then 'running' when 2 then 'completed'
    when 3 then 'completed_with_warnings' when 4 then 'failed' else 'cancelled' end as status
from {orders}
"""

INPUTS = {"nodes": NODES, "edges": EDGES, "files": FILES, "commits": COMMITS, "commit_files": COMMIT_FILES,
          "sources": SOURCES, "members": MEMBERS, "workspaces": WORKSPACES, "projects": PROJECTS,
          "repositories": REPOSITORIES, "activity": ACTIVITY, "runs": RUNS}
#: Inputs that Spark reads by another text of the same rows.
SPARK_INPUTS = {"edges": _by_keys(EDGES)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One adapted input as a DataFrame."""
    prepare(spark)
    text = SPARK_INPUTS.get(name, INPUTS[name])
    used = {t for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **{t: table(spark, folder, t) for t in used})


def check_inputs(*names: str) -> str:
    """The named inputs as a WITH list for the checking engine."""
    plain = {t: t for t in TABLES}
    return ", ".join(f"{name} as ({INPUTS[name].format(**plain).strip()})" for name in names)


def with_inputs(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql`` (which may start with more CTEs after ``with``) preceded by its inputs."""
    body = sql.strip()
    more = re.match(r"(?is)with\s+", body)
    keyword = "with recursive" if recursive else "with"
    return f"{keyword} {check_inputs(*names)}{', ' + body[more.end():] if more else ' ' + body}"


# ---- inputs that several queries share: built once per session and folder -------------------
_BUILT: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, folder: str, name: str, build):
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _BUILT:
        prepare(spark)
        _BUILT[key] = build()
    return _BUILT[key]


def estate(spark: SparkSession, folder: str) -> Graph:
    """The estate graph written to the shared folder: nodes, and edges split by relationship type."""
    return _once(spark, folder, "estate", lambda: Graph(
        lambda: stored(load(spark, folder, "nodes"), "estate-nodes"),
        lambda: stored(load(spark, folder, "edges"), "estate-edges", ("relationship_type",))))


def roots(spark: SparkSession, folder: str) -> DataFrame:
    """The most connected node of each entity type of the estate graph: (root, entity_type)."""
    def build() -> DataFrame:
        graph = estate(spark, folder)
        best = first_per_group(degrees(graph.nodes, graph.edges), ["entity_type"],
                               F.struct(-F.col("total_degree"), F.col("node_id")), ["node_id"])
        return stored(best.select(F.col("node_id").alias("root"), "entity_type"), "estate-roots")
    return _once(spark, folder, "roots", build)


def estate_depth(spark: SparkSession, folder: str) -> DataFrame:
    """The estate's dependency depth, computed once."""
    graph = estate(spark, folder)
    return _once(spark, folder, "depth", lambda: stored(dependency_depth(graph.nodes, graph.edges), "estate-depth"))


DEGREES = """
with deg as (
  select n.repository_id, n.node_id, n.entity_type, coalesce(i.c, 0) as in_degree, coalesce(o.c, 0) as out_degree,
    coalesce(i.c, 0) + coalesce(o.c, 0) as total_degree
  from nodes n left join (select dst, count(*) as c from edges group by dst) i on i.dst = n.node_id
  left join (select src, count(*) as c from edges group by src) o on o.src = n.node_id),
roots as (
  select node_id as root, entity_type from (
    select *, row_number() over (partition by entity_type order by total_degree desc, node_id) as r from deg) t where r = 1)
"""


def raw_files(spark: SparkSession, folder: str, name: str = "files") -> DataFrame:
    """(repository_id, path, content BINARY) of the prose files or of the Python sources."""
    return load(spark, folder, name).select("repository_id", "path", F.col("text").cast("binary").alias("content"))


def _parse_partitions(spark: SparkSession) -> int:
    """Tasks that parse: some for each core, and more where the session deals its shuffles out to more."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def prose_run(spark: SparkSession, folder: str) -> Analysis:
    return _once(spark, folder, "prose", lambda: analyze(
        raw_files(spark, folder), parse_partitions=_parse_partitions(spark)))


def source_run(spark: SparkSession, folder: str) -> Analysis:
    return _once(spark, folder, "sources", lambda: analyze(
        raw_files(spark, folder, "sources"), parse_partitions=_parse_partitions(spark)))


def source_graph(spark: SparkSession, folder: str) -> Graph:
    return _once(spark, folder, "source-graph", lambda: build_graph(source_run(spark, folder)))
