"""Tenancy, listing, run, dashboard, validation, quality, merge and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.operators import catalog as C
from sourceloom.operators import quality as Q
from sourceloom.plans.workload.adapters import _once, load, table, with_inputs
from sourceloom.plans.workload.registry import query
from sourceloom.session import prepare, scratch_path
from sourceloom.sources import snapshots as SN
from sourceloom.streaming import activity as ST

_BUSIEST = "(select user_id from activity group by user_id order by count(*) desc, user_id limit 1)"


def _busiest_user(spark, folder) -> int:
    """The user with most activity: a parameter of the per-user listings."""
    def find():
        log = load(spark, folder, "activity").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        return log.orderBy(F.desc("n"), "user_id").first()["user_id"]
    return _once(spark, folder, "busiest", find)


def _largest_project(spark, folder) -> int:
    def find():
        repositories = load(spark, folder, "repositories").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
        return repositories.orderBy(F.desc("n"), "project_id").first()["project_id"]
    return _once(spark, folder, "largest-project", find)


_LARGEST = "(select project_id from repositories group by project_id order by count(*) desc, project_id limit 1)"


# ---- tenancy -------------------------------------------------------------------------------
@query("visible_repositories", with_inputs(f"""
select r.repository_id, r.name from repositories r where workspace_id in (select workspace_id from members where user_id = {_BUSIEST})""",
                                           "repositories", "members", "activity"))
def visible_repositories(spark, folder):
    return C.visible_to(load(spark, folder, "repositories"), load(spark, folder, "members"), _busiest_user(spark, folder)).select("repository_id", "name")


@query("tenant_filter", with_inputs("""
select m.user_id, count(*) as visible_rows from members m join repositories r on r.workspace_id = m.workspace_id group by m.user_id""", "repositories", "members"))
def tenant_filter(spark, folder):
    return C.visible_pairs(load(spark, folder, "repositories"), load(spark, folder, "members"))


@query("tenant_filter_write", with_inputs("""
select m.user_id, count(*) as visible_rows from members m join repositories r on r.workspace_id = m.workspace_id
where m.role in ('owner', 'admin') group by m.user_id""", "repositories", "members"))
def tenant_filter_write(spark, folder):
    return C.visible_pairs(load(spark, folder, "repositories"), load(spark, folder, "members"), write=True)


@query("workspace_members", with_inputs(f"""
select w.workspace_id, w.name, (select count(*) from members m where m.workspace_id = w.workspace_id) as member_count
from workspaces w where workspace_id in (select workspace_id from members where user_id = {_BUSIEST})""", "workspaces", "members", "activity"))
def workspace_members(spark, folder):
    return C.workspace_members(load(spark, folder, "members"), load(spark, folder, "workspaces"), _busiest_user(spark, folder))


@query("favorites", with_inputs(f"""
with favorites as (select distinct user_id, nation_id as project_id from activity)
select project_id, name from projects where project_id in (select project_id from favorites where user_id = {_BUSIEST})""", "projects", "activity"))
def favorites(spark, folder):
    marks = load(spark, folder, "activity").select("user_id", F.col("nation_id").alias("project_id")).distinct()
    return C.favorites_of(load(spark, folder, "projects"), marks, _busiest_user(spark, folder), "project_id").select("project_id", "name")


@query("tag_join", with_inputs("""
with tags as (select distinct concat('repository:', l_suppkey) as repository_id, lower(l_returnflag || l_linestatus) as tag from lineitem)
select repository_id, name from repositories where repository_id in (select repository_id from tags where tag = 'ao')""", "repositories"))
def tag_join(spark, folder):
    tags = table(spark, folder, "lineitem").select(
        F.concat(F.lit("repository:"), "l_suppkey").alias("repository_id"), F.lower(F.concat("l_returnflag", "l_linestatus")).alias("tag")).distinct()
    return C.with_tag(load(spark, folder, "repositories"), tags, "AO").select("repository_id", "name")


@query("project_of_activity", with_inputs("""
select a.event_id, a.action, p.name as project_name from activity a left join projects p on p.project_id = a.project_id""", "activity", "projects"))
def project_of_activity(spark, folder):
    return C.with_project_name(load(spark, folder, "activity"), load(spark, folder, "projects")).select("event_id", "action", "project_name")


# ---- runs ----------------------------------------------------------------------------------
def _latest(where: str) -> str:
    return with_inputs(f"""select repository_id, id, status, strftime(started_at, '%Y-%m-%d') as day from (
      select *, row_number() over (partition by repository_id order by started_at desc, id desc) as r from runs where {where}) t where r = 1""", "runs")


def _with_day(frame):
    return frame.select("repository_id", "id", "status", F.date_format("started_at", "yyyy-MM-dd").alias("day"))


@query("latest_run", _latest("true"))
def latest_run(spark, folder):
    return _with_day(C.latest_run(load(spark, folder, "runs")))


@query("latest_completed_run", _latest("status in ('completed', 'completed_with_warnings')"))
def latest_completed_run(spark, folder):
    return _with_day(C.latest_run(load(spark, folder, "runs"), statuses=V.DONE_STATUSES))


@query("active_runs", with_inputs("select repository_id, id, status from runs where status in ('pending', 'running')", "runs"))
def active_runs(spark, folder):
    return C.active_runs(load(spark, folder, "runs")).select("repository_id", "id", "status")


# ---- listings ------------------------------------------------------------------------------
@query("catalog_search", with_inputs("""
select repository_id, name, description from repositories where name ilike '%000001%' or description ilike '%000001%'""", "repositories"))
def catalog_search(spark, folder):
    return C.catalog_search(load(spark, folder, "repositories"), " 000001 ").select("repository_id", "name", "description")


@query("list_repositories", with_inputs(f"""
select repository_id, name, status from repositories where project_id = {_LARGEST} and visibility <> 'Private' and visibility = 'Internal'
  and (name ilike '%supplier%' or description ilike '%supplier%') order by name, repository_id limit 50""", "repositories"))
def list_repositories(spark, folder):
    return C.list_repositories(load(spark, folder, "repositories"), _largest_project(spark, folder), search="SUPPLIER",
                               visibility="Internal", sort="name", order="asc")[0].select("repository_id", "name", "status")


@query("list_repositories_total", with_inputs(f"select count(*) as total from repositories where project_id = {_LARGEST} and repo_type = 'git'", "repositories"))
def list_repositories_total(spark, folder):
    return C.list_repositories(load(spark, folder, "repositories"), _largest_project(spark, folder), repo_type="git", limit=1)[1]


@query("recent_projects", with_inputs("""
select workspace_id, project_id, name, row_number() over (partition by workspace_id order by health_score desc, project_id) as rank from projects qualify rank <= 5""", "projects"))
def recent_projects(spark, folder):
    return C.recent_per(load(spark, folder, "projects"), "workspace_id", "health_score", "project_id", 5).select("workspace_id", "project_id", "name", "rank")


@query("recent_activity", with_inputs("""
select nation_id, event_id, action, row_number() over (partition by nation_id order by ts desc, event_id) as rank from activity qualify rank <= 10""", "activity"))
def recent_activity(spark, folder):
    return C.recent_per(load(spark, folder, "activity"), "nation_id", "ts", "event_id", 10).select("nation_id", "event_id", "action", "rank")


# ---- dashboards ----------------------------------------------------------------------------
@query("last_activity", with_inputs("""
select user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_activity from activity group by user_id""", "activity"))
def last_activity(spark, folder):
    return C.last_activity(load(spark, folder, "activity"), "user_id")


@query("dashboard_overview", with_inputs("""
select w.workspace_id, count(p.project_id) as total_projects, cast(coalesce(sum(p.repository_count), 0) as bigint) as total_repositories,
  cast(coalesce(trunc(avg(p.health_score)), 100) as int) as avg_health,
  coalesce((select strftime(max(a.ts), '%Y-%m-%d %H:%M:%S') from activity a join projects q on q.project_id = a.project_id where q.workspace_id = w.workspace_id), 'Never') as last_activity
from workspaces w left join projects p on p.workspace_id = w.workspace_id group by w.workspace_id""", "workspaces", "projects", "activity"))
def dashboard_overview(spark, folder):
    projects = load(spark, folder, "projects")
    log = load(spark, folder, "activity").join(projects.select("project_id", "workspace_id"), "project_id")
    return C.dashboard_overview(load(spark, folder, "workspaces"), projects, log)


@query("status_counts", with_inputs("""
select project_id, count(*) as total, count(*) filter (where status = 'uploaded') as uploaded, count(*) filter (where status = 'connected') as connected,
  count(*) filter (where status = 'archived') as archived from repositories group by project_id""", "repositories"))
def status_counts(spark, folder):
    return C.status_counts(load(spark, folder, "repositories"))


@query("project_totals", with_inputs("""
select count(*) as projects, cast(coalesce(sum(repository_count), 0) as bigint) as repositories, cast(floor(avg(health_score) + 0.5) as bigint) as avg_health
from projects where contains(lower(name), 'nation_1') and status = 'Active'""", "projects"))
def project_totals(spark, folder):
    return C.project_totals(load(spark, folder, "projects"), "Nation_1", "Active")


@query("catalog_facets", with_inputs("""
select 'status' as facet, status as value from repositories union select 'visibility', visibility from repositories""", "repositories"))
def catalog_facets(spark, folder):
    return C.facets(load(spark, folder, "repositories"), "status", "visibility")


# ---- validation projections ----------------------------------------------------------------
@query("normalize_names_and_tags", """
with t as (select p_partkey, concat('  ', p_name, case p_partkey % 4 when 0 then '!' when 1 then chr(9) || ' v2' else '' end) as name,
    [' ' || p_brand || ' ', lower(p_brand), p_type, case when p_partkey % 5 = 0 then '' else 'x' end] as tags from part),
c as (select p_partkey, trim(regexp_replace(name, '\\s+', ' ', 'g')) as clean_name, list_transform(tags, lambda v: lower(trim(v))) as lowered from t)
select p_partkey, clean_name, not regexp_full_match(clean_name, '[A-Za-z0-9][A-Za-z0-9._ -]{1,118}[A-Za-z0-9]') as bad_name,
  len(list_distinct(lowered)) as tag_count, len(list_filter(lowered, lambda v: not regexp_full_match(v, '[a-z0-9][a-z0-9._-]{0,31}'))) > 0 as bad_tags from c""")
def normalize_names_and_tags(spark, folder):
    prepare(spark)
    kind = F.col("p_partkey") % 4
    part = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("  "), "p_name", F.when(kind == 0, "!").when(kind == 1, "\t v2").otherwise("")).alias("name"),
        F.array(F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.lower("p_brand"), F.col("p_type"),
                F.when(F.col("p_partkey") % 5 == 0, "").otherwise("x")).alias("tags"))
    return C.validated_repositories(part).select(
        "p_partkey", "clean_name", F.col("name_error").isNotNull().alias("bad_name"), F.size("clean_tags").alias("tag_count"),
        F.col("tags_error").isNotNull().alias("bad_tags"))


@query("validate_git_source", """
select page_id, case page_id % 6 when 1 then 'git_url must be an absolute HTTP(S) URL' when 2 then 'credentials must not be embedded in git_url'
  when 3 then 'local Git hosts are not allowed' when 4 then 'invalid Git branch name' end as source_error from pages""")
def validate_git_source(spark, folder):
    prepare(spark)
    kind = F.col("page_id") % 6
    url = (F.when(kind == 1, F.regexp_replace("url", "^https?", "ftp")).when(kind == 2, F.regexp_replace("url", "://", "://user:secret@"))
           .when(kind == 3, F.regexp_replace("url", "://[^/]*", "://LOCALHOST:8080")).otherwise(F.concat(F.lit(" "), "url")))
    return C.validated_sources(table(spark, folder, "pages").select(
        "page_id", url.alias("git_url"), F.when(kind == 4, "feature//x").otherwise("release/2.4").alias("git_branch"))).select("page_id", "source_error")


# ---- quality -------------------------------------------------------------------------------
@query("check_unique", """
select l_orderkey, l_linenumber, count(*) as occurrences from lineitem group by 1, 2 having count(*) > 1""")
def check_unique(spark, folder):
    prepare(spark)
    return Q.check_unique(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@query("check_domain", "select event_id, event_type from events where event_type not in ('click', 'view', 'purchase', 'signup')")
def check_domain(spark, folder):
    prepare(spark)
    return Q.check_domain(table(spark, folder, "events"), "event_type", ("click", "view", "purchase", "signup")).select("event_id", "event_type")


@query("check_foreign_key", with_inputs("""
select event_id, project_id from activity where project_id not in (select project_id from projects)""", "activity", "projects"))
def check_foreign_key(spark, folder):
    return Q.check_foreign_key(load(spark, folder, "activity"), "project_id", load(spark, folder, "projects"), "project_id").select("event_id", "project_id")


@query("cascade_delete", with_inputs("""
select event_id, project_id from activity where project_id in (select project_id from projects where status = 'Active')""", "activity", "projects"))
def cascade_delete(spark, folder):
    return Q.cascade(load(spark, folder, "activity"), "project_id", load(spark, folder, "projects").where("status = 'Active'"), "project_id").select("event_id", "project_id")


@query("unique_name", """
select p_size as project_id, lower(p_name) as name_key, count(*) as occurrences from part group by 1, 2 having count(*) > 1""")
def unique_name(spark, folder):
    prepare(spark)
    return Q.unique_name(table(spark, folder, "part").select(F.col("p_size").alias("project_id"), F.upper("p_name").alias("name")))


@query("violation_summary", with_inputs("""
select 'edge_types' as check_name, count(*) as violations from edges where relationship_type not in ('imports', 'calls')
union all select 'node_keys', count(*) from (select entity_key from nodes group by 1 having count(*) > 1) t
union all select 'edge_sources', count(*) from edges where src not in (select node_id from nodes)""", "nodes", "edges"))
def violation_summary(spark, folder):
    nodes, edges = load(spark, folder, "nodes"), load(spark, folder, "edges")
    return Q.violation_summary({
        "edge_types": Q.check_domain(edges, "relationship_type", ("imports", "calls")),
        "node_keys": Q.check_unique(nodes, "entity_key"),
        "edge_sources": Q.check_foreign_key(edges, "src", nodes, "node_id")})


# ---- graph snapshots -----------------------------------------------------------------------
# The old snapshot holds run 1 of all nodes but those of some classes; the batch is run 2 of all but the functions.
_OLD = "not (entity_type = 'class' and name like '%Service')"
_NEW = "entity_type <> 'function'"


def _snapshot(nodes, run: int):
    return nodes.select(
        "repository_id", "entity_key", F.concat("node_id", F.lit(f"@{run}")).alias("node_id"), "entity_type", "name",
        F.concat("label", F.lit(f" v{run}")).alias("label"), F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.lit(f"m{run}").alias("module"), F.lit(f"p{run}").alias("package"), F.lit("").alias("language"),
        F.lit(run == 2).alias("is_async"), F.lit(f"run-{run}").alias("analysis_run_id"), F.lit(f"dep-{run}").alias("dependency_id"),
        F.lit(run * 100).alias("synced_at"))


def _merged_nodes(spark, folder):
    nodes = load(spark, folder, "nodes")
    return SN.upsert_nodes(_snapshot(nodes.where(_OLD), 1), _snapshot(nodes.where(_NEW), 2))


@query("upsert_nodes", with_inputs(f"""
with m as (select *, {_OLD} as is_old, {_NEW} as is_new from nodes)
select entity_key, concat(node_id, case when is_new then '@2' else '@1' end) as node_id, concat(label, case when is_new then ' v2' else ' v1' end) as label,
  case when is_old then 'm1' else 'm2' end as module, case when is_old then 'p1' else 'p2' end as package, not is_old as is_async,
  case when is_new then 'run-2' else 'run-1' end as analysis_run_id, case when is_new then 200 else 100 end as synced_at from m""", "nodes"))
def upsert_nodes(spark, folder):
    return _merged_nodes(spark, folder).select("entity_key", "node_id", "label", "module", "package", "is_async", "analysis_run_id", "synced_at")


def _edge_snapshot(edges, run: int):
    return edges.select("repository_id", "src", "relationship_type", "dst", F.lit(f"edge-{run}").alias("edge_id"), F.lit(float(run)).alias("weight"),
                        F.lit(run).alias("depth"), F.lit(f"run-{run}").alias("analysis_run_id"), F.lit(run * 100).alias("synced_at"))


@query("upsert_edges", with_inputs("""
with m as (select *, relationship_type <> 'uses' as is_old,
  relationship_type <> 'calls' and src not in (select node_id from nodes where name like '%Repo')
    and dst not in (select node_id from nodes where name like '%Repo') as is_new from edges)
select src, dst, relationship_type, case when is_old then 'edge-1' else 'edge-2' end as edge_id, case when is_new then 2.0 else 1.0 end as weight,
  case when is_new then 'run-2' else 'run-1' end as analysis_run_id from m where is_old or is_new""", "nodes", "edges"))
def upsert_edges(spark, folder):
    nodes, edges = load(spark, folder, "nodes"), load(spark, folder, "edges")
    merged = SN.upsert_edges(_edge_snapshot(edges.where("relationship_type <> 'uses'"), 1), _edge_snapshot(edges.where("relationship_type <> 'calls'"), 2),
                             nodes.where("name not like '%Repo'"))
    return merged.select("src", "dst", "relationship_type", "edge_id", "weight", "analysis_run_id")


def _pruned(spark, folder):
    current = load(spark, folder, "nodes").select("repository_id").distinct().withColumn("current_run", F.lit("run-2"))
    return SN.prune_stale(_merged_nodes(spark, folder), load(spark, folder, "edges"), current)


@query("prune_stale_nodes", with_inputs(f"select entity_key from nodes where {_NEW}", "nodes"))
def prune_stale_nodes(spark, folder):
    return _pruned(spark, folder)[0].select("entity_key")


@query("prune_stale_edges", with_inputs("select src, dst, relationship_type from edges where src not like 'function:%' and dst not like 'function:%'", "edges"))
def prune_stale_edges(spark, folder):
    return _pruned(spark, folder)[1].select("src", "dst", "relationship_type")


@query("prune_summary", with_inputs(f"select repository_id, count(*) as nodes_pruned, 'completed_stale' as status from nodes where not ({_NEW}) group by repository_id", "nodes"))
def prune_summary(spark, folder):
    return _pruned(spark, folder)[2]


@query("report", with_inputs("""
with r as (select repository_id, id, status, row_number() over (partition by repository_id order by started_at desc, id desc) as k from runs),
counts as (select repository_id, status, count(*) as n from runs group by 1, 2)
select r.repository_id, r.id, r.status, string_agg(concat(c.status, '=', c.n), ',' order by c.status) as history
from r join counts c on c.repository_id = r.repository_id where k = 1 group by 1, 2, 3""", "runs"))
def report(spark, folder):
    runs = load(spark, folder, "runs")
    by_status = runs.groupBy("repository_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return C.nested_report(C.latest_run(runs), {"history": by_status}).select(
        "repository_id", "id", "status", F.array_join(F.transform("history", lambda s: F.concat(s["status"], F.lit("="), s["n"])), ",").alias("history"))


# ---- streaming -----------------------------------------------------------------------------
@query("activity_stream", """
select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type as action, count(*) as events from events group by 1, 2""")
def activity_stream(spark, folder):
    prepare(spark)
    source = table(spark, folder, "events").schema
    stream = spark.readStream.schema(source).parquet(f"{folder}/events*.parquet").withColumnRenamed("event_type", "action")
    out = scratch_path(spark, "activity-counts")
    ST.run_to_table(ST.activity_counts(stream), out, scratch_path(spark, "stream-state"), "complete").awaitTermination()
    counts = spark.read.schema("window_start timestamp, action string, events long").parquet(out)
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "action", "events")


@query("node_sync_stream", with_inputs("""
select entity_key, concat(node_id, case when entity_type <> 'function' then '@2' else '@1' end) as node_id, 'm1' as module from nodes""", "nodes"))
def node_sync_stream(spark, folder):
    nodes = load(spark, folder, "nodes")
    batches = scratch_path(spark, "node-batches")
    first = _snapshot(nodes, 1)
    first.write.parquet(f"{batches}/a")
    root, state = scratch_path(spark, "node-sync"), scratch_path(spark, "sync-state")
    stream = lambda: spark.readStream.schema(first.schema).parquet(f"{batches}/*")
    ST.sync_nodes_stream(stream(), root, state).awaitTermination()
    _snapshot(nodes.where(_NEW), 2).write.parquet(f"{batches}/b")
    ST.sync_nodes_stream(stream(), root, state).awaitTermination()
    return spark.read.schema(first.schema).parquet(f"{root}/snapshot=1").select("entity_key", "node_id", "module")
