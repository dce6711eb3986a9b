"""Commit history queries: orders are commits, line items the files they touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions.ranking import first_per_group
from sourceloom.operators import history as H
from sourceloom.plans.workload.adapters import load, source_run, with_inputs
from sourceloom.plans.workload.registry import query
from sourceloom.plans.workload.symbols import SHAPE

DATED = """
with dated as (select c.repository_id, c.author, c.ts, f.* from commit_files f join commits c on c.hash = f.hash),
changes as (select repository_id, path, count(*) as changes, min(ts) as first_ts, max(ts) as last_ts, min_by(hash, (ts, hash)) as first_hash,
  max_by(hash, (ts, hash)) as last_hash from dated group by repository_id, path)
"""


def _check(select: str, more: str = "") -> str:
    return with_inputs(DATED + more + select, "commits", "commit_files")


def _inputs(spark, folder):
    return load(spark, folder, "commits"), load(spark, folder, "commit_files")


def _module():
    return F.substring_index("path", "/", 1)


@query("filter_commits", _check("""
select hash from commits where branch = 'O' and type = '1-URGENT' and ts >= timestamp '1996-01-01' and ts < timestamp '1998-01-01'
and contains(lower(concat_ws(' ', hash, author, branch, type)), 'urgent') and hash in (select hash from commit_files where path like 'm7/%')"""))
def filter_commits(spark, folder):
    commits, files = _inputs(spark, folder)
    tagged = files.withColumn("path", F.when(_module() == "m7", "m7").otherwise(F.col("path")))
    return H.filter_commits(commits, tagged, search="Urgent", branch="O", commit_type="1-URGENT", file="m7",
                            since="1996-01-01", until="1998-01-01").select("hash")


@query("commit_size", _check("""
select c.repository_id, c.hash, count(f.path) as files_changed, coalesce(sum(insertions), 0) as insertions, coalesce(sum(deletions), 0) as deletions
from commits c left join commit_files f on f.hash = c.hash group by 1, 2"""))
def commit_size(spark, folder):
    return H.commit_size(*_inputs(spark, folder))


@query("file_changes", _check("""select repository_id, path, changes, strftime(first_ts, '%Y-%m-%d') as first_day, strftime(last_ts, '%Y-%m-%d') as last_day,
  first_hash, last_hash from changes"""))
def file_changes(spark, folder):
    rows = H.file_changes(*_inputs(spark, folder))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select("repository_id", "path", "changes", day("first_ts").alias("first_day"), day("last_ts").alias("last_day"), "first_hash", "last_hash")


@query("history_stats", _check("""
, sizes as (select c.repository_id, c.hash, coalesce(sum(insertions + deletions), 0) as s from commits c left join commit_files f on f.hash = c.hash group by 1, 2)
select c.repository_id, count(*) as total_commits, count(distinct author) as contributors,
  round(count(*) / (date_diff('day', min(ts), max(ts)) + 1), 1) as commits_per_day,
  (select min_by(branch, (-n, branch)) from (select branch, count(*) as n from commits b where b.repository_id = c.repository_id group by branch) t) as most_active_branch,
  (select min_by(hash, (-s, hash)) from sizes z where z.repository_id = c.repository_id) as largest_commit,
  (select min_by(path, (-changes, path)) from changes h where h.repository_id = c.repository_id) as most_modified_file,
  (select min_by(path, (first_ts, path)) from changes h where h.repository_id = c.repository_id) as oldest_file,
  (select max_by(path, (first_ts, path)) from changes h where h.repository_id = c.repository_id) as newest_file
from commits c group by c.repository_id"""))
def history_stats(spark, folder):
    return H.history_stats(*_inputs(spark, folder))


@query("author_insights", _check("""
, areas as (select repository_id, author, split_part(path, '/', 1) as area, count(*) as n from dated group by 1, 2, 3),
top as (select repository_id, author, string_agg(area, ',' order by r) as active_areas from (
  select *, row_number() over (partition by repository_id, author order by n desc, area) as r from areas) t where r <= 3 group by 1, 2),
files as (select repository_id, author, count(distinct path) as f from dated group by 1, 2)
select c.repository_id, c.author, count(*) as commits, coalesce(max(f.f), 0) as files_modified, max(t.active_areas) as active_areas
from commits c left join files f on f.repository_id = c.repository_id and f.author = c.author
left join top t on t.repository_id = c.repository_id and t.author = c.author group by 1, 2"""))
def author_insights(spark, folder):
    return H.author_insights(*_inputs(spark, folder), _module())


@query("author_timeline", _check("""
select repository_id, author, strftime(date_trunc('week', ts), '%Y-%m-%d') as week, count(*) as commits from commits group by 1, 2, 3"""))
def author_timeline(spark, folder):
    return H.author_timeline(load(spark, folder, "commits")).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("file_hotspots", _check("""
select repository_id, path, changes, case when s >= 0.9 then 'High' when s >= 0.7 then 'Medium' else 'Low' end as risk
from (select *, (rank() over (partition by repository_id order by changes) - 1) / count(*) over (partition by repository_id) as s from changes) t"""))
def file_hotspots(spark, folder):
    return H.file_hotspots(H.file_changes(*_inputs(spark, folder)))


@query("hotspot_report", _check("""
select repository_id, path, changes, row_number() over (partition by repository_id order by changes desc, path) as rank from changes qualify rank <= 10"""))
def hotspot_report(spark, folder):
    return H.hotspot_report(H.file_changes(*_inputs(spark, folder))).drop("risk")


@query("stable_files", _check("""
select repository_id, path, changes, row_number() over (partition by repository_id order by changes, path) as rank from changes qualify rank <= 10"""))
def stable_files(spark, folder):
    return H.stable_files(H.file_changes(*_inputs(spark, folder)))


@query("module_activity", _check("""
, latest as (select repository_id, max(ts) as m from commits group by 1)
select d.repository_id, split_part(path, '/', 1) as module, count(*) filter (where ts >= m - interval 3 days) as recent_changes, count(*) as changes,
  case when count(*) filter (where ts >= m - interval 3 days) > 0 then 'recently_active' else 'stable' end as state
from dated d join latest l on l.repository_id = d.repository_id group by 1, 2"""))
def module_activity(spark, folder):
    return H.module_activity(*_inputs(spark, folder), _module(), days=3)


@query("co_change", _check("""
, best as (select repository_id, min_by(path, (-changes, path)) as target from changes group by 1),
mine as (select distinct b.repository_id, b.target, d.hash from dated d join best b on b.repository_id = d.repository_id and b.target = d.path),
totals as (select repository_id, target, count(*) as n from mine group by 1, 2)
select m.repository_id, m.target, d.path as partner, count(*) as support, max(t.n) as target_changes, round(count(*) * 100 / max(t.n), 2) as confidence
from mine m join dated d on d.repository_id = m.repository_id and d.hash = m.hash join totals t on t.repository_id = m.repository_id and t.target = m.target
where d.path <> m.target group by 1, 2, 3 having count(*) >= 2"""))
def co_change(spark, folder):
    commits, files = _inputs(spark, folder)
    hottest = first_per_group(H.file_changes(commits, files), ["repository_id"], F.struct(-F.col("changes"), F.col("path")), ["path"])
    return H.co_change(commits, files, hottest)


@query("file_lifecycle", _check("""
select repository_id, path, hash, strftime(ts, '%Y-%m-%d') as day, row_number() over (partition by repository_id, path order by ts, hash) as step,
  case when row_number() over (partition by repository_id, path order by ts, hash) = 1 then 'Created' else 'Modified' end as state from dated"""))
def file_lifecycle(spark, folder):
    return H.file_lifecycle(*_inputs(spark, folder)).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).drop("ts")


@query("replay", _check("""
, firsts as (select repository_id, first_hash as hash, count(*) as n from changes group by 1, 2),
mods as (select repository_id, split_part(path, '/', 1) as module, min_by(hash, (ts, hash)) as hash from dated group by 1, 2),
first_mods as (select repository_id, hash, count(*) as n from mods group by 1, 2)
select c.repository_id, row_number() over w - 1 as commit_index, c.hash, coalesce(sum(f.n) over w, 0) as files, coalesce(sum(m.n) over w, 0) as modules
from commits c left join firsts f on f.repository_id = c.repository_id and f.hash = c.hash
left join first_mods m on m.repository_id = c.repository_id and m.hash = c.hash
window w as (partition by c.repository_id order by c.ts, c.hash rows between unbounded preceding and current row)"""))
def replay(spark, folder):
    return H.replay(*_inputs(spark, folder), {"files": F.col("path"), "modules": _module()})


@query("related_commits", _check("""
, sized as (select repository_id, hash, count(*) as n from dated group by 1, 2),
biggest as (select repository_id, min_by(hash, (-n, hash)) as target from sized group by 1),
shared as (select b.repository_id, b.target, o.hash, count(*) as shared_files from biggest b join dated m on m.repository_id = b.repository_id and m.hash = b.target
  join dated o on o.repository_id = b.repository_id and o.path = m.path and o.hash <> b.target group by 1, 2, 3)
select repository_id, target, hash, shared_files, row_number() over (partition by repository_id, target order by shared_files desc, hash) as rank
from shared qualify rank <= 3"""))
def related_commits(spark, folder):
    commits, files = _inputs(spark, folder)
    largest = first_per_group(H.commit_size(commits, files), ["repository_id"], F.struct(-F.col("files_changed"), F.col("hash")), ["hash"])
    return H.related_commits(commits, files, largest)


@query("function_evolution", """
with snap as (select concat('repo', o_orderkey % 8) as repository_id, o_custkey as k, max(o_orderkey) as newest, min(o_orderkey) as oldest, count(*) as n from orders group by 1, 2)
select repository_id, concat('pkg.fn', k) as qualified_name, case when n = 1 and newest % 3 = 0 then 'Removed' when n = 1 and newest % 3 = 1 then 'Created'
  when newest = oldest then 'Unchanged' else 'Modified' end as state from snap""")
def function_evolution(spark, folder):
    """Two snapshots per customer: a lone order exists in one of them or stays as it is."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    snap = orders.groupBy(F.concat(F.lit("repo"), F.col("o_orderkey") % 8).alias("repository_id"), "o_custkey").agg(
        F.max("o_orderkey").alias("newest"), F.min("o_orderkey").alias("oldest"), F.count(F.lit(1)).alias("n"))
    named = snap.withColumn("qualified_name", F.concat(F.lit("pkg.fn"), "o_custkey"))
    lone = (F.col("n") == 1) & (F.col("newest") % 3 < 2)
    before = named.where(~(lone & (F.col("newest") % 3 == 1))).withColumn("body_hash", F.sha2(F.col("oldest").cast("string"), 256))
    after = named.where(~(lone & (F.col("newest") % 3 == 0))).withColumn("body_hash", F.sha2(F.col("newest").cast("string"), 256))
    return H.function_evolution(before, after)


@query("function_evolution_sources", SHAPE.strip() + """
select repository_id, case when name = '_load' then 'Unchanged' else 'Modified' end as state, count(*) as functions from fns group by 1, 2""")
def function_evolution_sources(spark, folder):
    """Parsed functions against themselves with the return type left out of half of them."""
    functions = source_run(spark, folder).functions
    body = F.sha2(F.concat_ws("|", "name", "return_type", F.to_json("parameters")), 256)
    before = functions.withColumn("body_hash", body)
    loose = F.when(F.col("start_line") % 2 == 0, F.lit(None)).otherwise(F.col("return_type"))
    after = functions.withColumn("return_type", loose).withColumn("body_hash", body)
    return H.function_evolution(before, after).groupBy("repository_id", "state").agg(F.count(F.lit(1)).alias("functions"))
