"""File, folder and language queries over the prose files (one file per document)."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.functions import scalars as S
from sourceloom.operators import catalog as C
from sourceloom.operators import rollups as R
from sourceloom.operators import symbols as X
from sourceloom.operators.search import multi_field_search
from sourceloom.plans.workload.adapters import load, prose_run, raw_files, table, with_inputs
from sourceloom.plans.workload.registry import query
from sourceloom.session import prepare, scratch_path
from sourceloom.sources import archives as Z
from sourceloom.sources import snapshots as SN
from sourceloom.sources.tree import collect_warnings, describe_files, scan_source_tree

_LANGUAGE = "case extension " + " ".join(
    f"when '{e}' then '{n}'" for e, n in V.LANGUAGE_BY_EXTENSION.items()) + " else 'Unknown' end"
_BREAKS = r"[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_LINES = (f"len(regexp_extract_all(u, '{_BREAKS}')) + "
          f"case when u = '' or regexp_matches(right(u, 1), '{_BREAKS}') then 0 else 1 end")
DESCRIBED = f"""
with parts as (
  select repository_id, path, text, replace(text, chr(13) || chr(10), chr(10)) as u,
    regexp_extract(path, '[^/]*$') as name,
    case when contains(path, '/') then regexp_extract(path, '^(.*)/[^/]*$', 1) else '' end as folder_path,
    lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) as extension,
    strlen(text) as size_bytes, sha256(text) as content_hash from files),
described as (
  select *, {_LANGUAGE} as language, case when {_LANGUAGE} = 'Unknown' then 0 else {_LINES} end as lines_of_code
  from parts)
"""
_ANCESTORS = """, folders as (
  select d.repository_id, d.size_bytes,
    array_to_string(list_slice(string_split(d.folder_path, '/'), 1, g.n), '/') as path
  from described d, lateral (select unnest(range(0, len(string_split(d.folder_path, '/')) + 1)) as n) g),
rolled as (
  select repository_id, path, count(*) as total_files, sum(size_bytes) as total_size_bytes,
    case when path = '' then 0 else len(string_split(path, '/')) end as depth,
    case when path = '' then '/' else regexp_extract(path, '[^/]*$') end as name,
    case when path = '' then null when contains(path, '/') then regexp_extract(path, '^(.*)/[^/]*$', 1) else '' end as parent_path
  from folders group by repository_id, path)
"""


def _described(spark, folder):
    return describe_files(raw_files(spark, folder))


def _check(select: str, more: str = "") -> str:
    return with_inputs(DESCRIBED + more + select, "files")


@query("scan_source_tree", with_inputs("""
with raw as (select repository_id, case doc_id % 9 when 0 then concat('node_modules/', path) when 1 then concat('src/build/', path)
  when 2 then concat('src/', path, '/build') else path end as path, doc_id % 13 = 0 as is_symlink from files)
select repository_id, path from raw where not is_symlink and path not like 'node_modules/%' and path not like 'src/build/%'""", "files"))
def scan(spark, folder):
    found, _ = scan_source_tree(_links(spark, folder))
    return found.select("repository_id", "path")


def _links(spark, folder):
    """Some paths below skipped folders, one file named like one, some symbolic links."""
    kind = F.col("doc_id") % 9
    path = (F.when(kind == 0, F.concat(F.lit("node_modules/"), "path")).when(kind == 1, F.concat(F.lit("src/build/"), "path"))
            .when(kind == 2, F.concat(F.lit("src/"), "path", F.lit("/build"))).otherwise(F.col("path")))
    return load(spark, folder, "files").select(
        "repository_id", path.alias("path"), F.col("text").cast("binary").alias("content"),
        (F.col("doc_id") % 13 == 0).alias("is_symlink"))


@query("scan_warnings", with_inputs("""
with raw as (select repository_id, case doc_id % 9 when 0 then concat('node_modules/', path) when 1 then concat('src/build/', path)
  when 2 then concat('src/', path, '/build') else path end as path, doc_id % 13 = 0 as is_symlink from files),
w as (select repository_id, path from raw where is_symlink and path not like 'node_modules/%' and path not like 'src/build/%')
select repository_id, path, 'symlink_skipped' as code, 'Symbolic links are not analyzed' as message,
  count(*) over (partition by repository_id) as warnings from w""", "files"))
def scan_warnings(spark, folder):
    _, warnings = scan_source_tree(_links(spark, folder))
    kept, counts = collect_warnings(warnings)
    return kept.join(counts, "repository_id")


@query("fingerprint", _check("select repository_id, path, content_hash from described"))
def fingerprint(spark, folder):
    return _described(spark, folder).select("repository_id", "path", "content_hash")


@query("decode_text", with_inputs("""
select repository_id, path, case when path like '%.txt' then null when strlen(text) > 4000 then 'File exceeds analysis size limit' end as parse_error,
  case when path like '%.txt' or strlen(text) > 4000 then 0 else length(text) end as characters from files""", "files"))
def decode_text(spark, folder):
    return describe_files(raw_files(spark, folder), max_bytes=4000).select(
        "repository_id", "path", "parse_error", F.coalesce(F.length("text"), F.lit(0)).alias("characters"))


@query("detect_language", _check("select path, language from described"))
def detect_language(spark, folder):
    return load(spark, folder, "files").select("path", S.detect_language(S.file_name(F.col("path"))).alias("language"))


@query("path_parts", _check("select path, name, extension, folder_path from described"))
def path_parts(spark, folder):
    name = S.file_name(F.col("path"))
    return load(spark, folder, "files").select("path", name.alias("name"), S.suffix(name).alias("extension"),
                                               S.folder_path(F.col("path")).alias("folder_path"))


@query("count_lines", _check(f"select path, {_LINES} as lines from parts"))
def count_lines(spark, folder):
    return load(spark, folder, "files").select("path", S.count_lines(F.col("text")).alias("lines"))


@query("page_path_parts", """
with p as (select page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '^/', '') as path from pages)
select page_id, path, regexp_extract(path, '[^/]*$') as name,
  case when contains(path, '/') then regexp_extract(path, '^(.*)/[^/]*$', 1) else '' end as folder_path from p""")
def page_path_parts(spark, folder):
    prepare(spark)
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1), "^/", "")
    pages = table(spark, folder, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", "path", S.file_name(F.col("path")).alias("name"), S.folder_path(F.col("path")).alias("folder_path"))


@query("language_stats", _check("""
select repository_id, language, count(*) as file_count, sum(lines_of_code) as lines_of_code, sum(size_bytes) as size_bytes,
  round(sum(size_bytes) * 100 / sum(sum(size_bytes)) over (partition by repository_id), 2) as percentage
from described group by repository_id, language"""))
def language_stats(spark, folder):
    return R.language_stats(_described(spark, folder))


@query("primary_language", _check("""
select repository_id, language as primary_language from (
  select repository_id, language, row_number() over (partition by repository_id order by count(*) desc, min(path)) as r
  from described where language <> 'Unknown' group by repository_id, language) t where r = 1"""))
def primary_language(spark, folder):
    return R.primary_language(_described(spark, folder))


@query("folder_rollup", _check("""
select r.repository_id, r.path, r.name, r.depth, r.parent_path, r.total_files, r.total_size_bytes,
  coalesce(c.n, 0) as children_count
from rolled r left join (select repository_id, parent_path as path, count(*) as n from rolled where parent_path is not null
  group by repository_id, parent_path) c on c.repository_id = r.repository_id and c.path = r.path""", _ANCESTORS))
def folder_rollup(spark, folder):
    return R.folder_rollup(_described(spark, folder))


@query("folder_children", _check("""
select repository_id, parent_path as path, count(*) as children_count from rolled where parent_path is not null
group by repository_id, parent_path""", _ANCESTORS))
def folder_children(spark, folder):
    return R.folder_children(R.folder_rollup(_described(spark, folder)))


@query("largest_file", _check("""
select repository_id, path as largest_file_path, size_bytes as largest_file_size from (
  select *, row_number() over (partition by repository_id order by size_bytes desc, path) as r from described) t where r = 1"""))
def largest_file(spark, folder):
    return R.largest_file(_described(spark, folder))


@query("largest_folder", _check("""
select repository_id, path as largest_folder_path, total_size_bytes as largest_folder_size from (
  select *, row_number() over (partition by repository_id order by total_size_bytes desc, depth, path) as r from rolled) t
where r = 1""", _ANCESTORS))
def largest_folder(spark, folder):
    return R.largest_folder(R.folder_rollup(_described(spark, folder)))


@query("parse_status_counts", _check("""
select repository_id, case language when 'Python' then 'failed' else 'not_applicable' end as parse_status, count(*) as files
from described group by 1, 2"""))
def parse_status_counts(spark, folder):
    return prose_run(spark, folder).files.groupBy("repository_id", "parse_status").agg(F.count(F.lit(1)).alias("files"))


@query("parse_warnings", _check("""
select repository_id, path, 'parse_error' as code, true as explained from described where language = 'Python'"""))
def parse_warnings(spark, folder):
    rows = X.parse_warnings(prose_run(spark, folder).files)
    return rows.select("repository_id", "path", "code", F.col("message").isNotNull().alias("explained"))


@query("ilike_search_files", _check("select repository_id, path from described where path ilike '%m3/F1%'"))
def ilike_search_files(spark, folder):
    return C.ilike_search(_described(spark, folder), "files", "m3/F1").select("repository_id", "path")


@query("files_page", _check("""
select repository_id, path, size_bytes from described order by path, repository_id limit 25 offset 50"""))
def files_page(spark, folder):
    return C.page(_described(spark, folder).select("repository_id", "path", "size_bytes"),
                  [F.col("path"), F.col("repository_id")], 25, 50)[0]


@query("files_page_total", _check("select count(*) as total from described"))
def files_page_total(spark, folder):
    return C.page(_described(spark, folder), [F.col("path"), F.col("repository_id")], 25, 50)[1]


@query("explorer_list", _check("""
select path, name, size_bytes from described where folder_path = 'en/m3' and contains(lower(name), '1') and language = 'Markdown'"""))
def explorer_list(spark, folder):
    return C.explorer_list(_described(spark, folder), "en/m3", search="1", language="Markdown", sort="size_bytes",
                           ascending=False).select("path", "name", "size_bytes")


@query("multi_field_search", _check("""
select repository_id, path from described where contains(lower(concat_ws(' ', repository_id, path, language)), 'src1 en/m2')"""))
def multi_field(spark, folder):
    return multi_field_search(_described(spark, folder), "src1 EN/m2", "repository_id", "path", "language").select("repository_id", "path")


@query("facets", _check("""
select 'language' as facet, language as value from described union select 'folder_path', folder_path from described"""))
def facets(spark, folder):
    return C.facets(_described(spark, folder), "language", "folder_path")


# ---- archives: one ZIP per document, some unsafe, linked, empty or corrupt ------------------
def _zip_documents(batches):
    """Pack each document into an archive; the document id decides which rule it breaks."""
    for batch in batches:
        packed = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                if doc_id % 11 != 4:
                    archive.writestr(f"src/f{doc_id}.txt", text)
                    archive.writestr("../outside.txt" if doc_id % 11 == 1 else "src/lib/readme.md", "x" * int(doc_id % 5))
                if doc_id % 11 == 2:
                    link = zipfile.ZipInfo("src/link")
                    link.external_attr = 0o120777 << 16
                    archive.writestr(link, "src")
            packed.append(b"not a zip" if doc_id % 11 == 3 else buffer.getvalue())
        yield pd.DataFrame({"repository_id": "archive" + batch["doc_id"].astype(str), "content": packed})


def _archives(spark, folder):
    prepare(spark)
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return documents.repartition(spark.sparkContext.defaultParallelism, "doc_id").mapInPandas(
        _zip_documents, "repository_id string, content binary")


@query("archive_entries", """
select concat('archive', doc_id) as repository_id, concat('src/f', doc_id, '.txt') as path, sha256(text) as content_hash
  from documents where doc_id % 11 not in (1, 2, 3, 4)
union all select concat('archive', doc_id), 'src/lib/readme.md', sha256(repeat('x', doc_id % 5)) from documents where doc_id % 11 not in (1, 2, 3, 4)""")
def archive_entries(spark, folder):
    entries, _ = Z.explode_archives(_archives(spark, folder))
    return entries.select("repository_id", "path", S.fingerprint(F.col("content")).alias("content_hash"))


@query("archive_rejects", """
select concat('archive', doc_id) as repository_id, case doc_id % 11 when 1 then 'Archive contains an unsafe path'
  when 2 then 'Symbolic links are not allowed' when 3 then 'Archive is corrupt'
  else 'Archive is empty or contains too many entries' end as reason from documents where doc_id % 11 in (1, 2, 3, 4)""")
def archive_rejects(spark, folder):
    return Z.explode_archives(_archives(spark, folder))[1]


@query("archive_inventory", """
select concat('archive', doc_id) as repository_id, 2 as total_files, 2 as total_folders,
  strlen(text) + doc_id % 5 as extracted_size_bytes from documents where doc_id % 11 not in (1, 2, 3, 4)""")
def archive_inventory(spark, folder):
    return Z.file_inventory(Z.explode_archives(_archives(spark, folder))[0])


@query("archive_fingerprints")
def archive_fingerprints(spark, folder):
    return Z.archive_fingerprints(_archives(spark, folder))


@query("archive_fingerprints_bytes", "select concat('archive', doc_id) as repository_id, sha256(text) as archive_sha256, strlen(text) as archive_bytes from documents")
def archive_fingerprints_bytes(spark, folder):
    """The same over bytes that SQL has too: packing stamps archives with the time."""
    documents = table(prepare(spark), folder, "documents")
    return Z.archive_fingerprints(documents.select(F.concat(F.lit("archive"), "doc_id").alias("repository_id"), F.col("text").cast("binary").alias("content")))


# ---- snapshot sinks ------------------------------------------------------------------------
@query("write_and_load_snapshot", _check("""
select repository_id, 'run-2' as analysis_run_id, path, language from described where language = 'Markdown'"""))
def write_and_load_snapshot(spark, folder):
    files = _described(spark, folder).select("repository_id", "path", "language")
    root = scratch_path(spark, "snapshot")
    SN.write_snapshot({"repository_files": files}, root, "run-1")
    SN.write_snapshot({"repository_files": files.where("language = 'Markdown'")}, root, "run-2")
    return SN.load_snapshot(spark, root, "repository_files",
                            "path string, language string, repository_id string, analysis_run_id string", "run-2")


@query("replace_build", _check("""
select repository_id, 'run-1' as analysis_run_id, path, language from described
where repository_id <> 'src1' or language = 'Markdown'"""))
def replace_build(spark, folder):
    files = _described(spark, folder).select("repository_id", "path", "language").withColumn("analysis_run_id", F.lit("run-1"))
    root = scratch_path(spark, "build")
    SN.replace_build(files, root)
    SN.replace_build(files.where("repository_id = 'src1' and language = 'Markdown'"), root)
    return spark.read.schema("path string, language string, repository_id string, analysis_run_id string").parquet(root)


@query("append_activity", """
select event_type as action, count(*) * 2 as entries from events group by event_type""")
def append_activity(spark, folder):
    prepare(spark)
    root = scratch_path(spark, "activity")
    log = table(spark, folder, "events").select(F.col("event_type").alias("action"), "user_id", "ts")
    SN.append_activity(log, root)
    SN.append_activity(log, root)
    return spark.read.schema(log.schema).parquet(root).groupBy("action").agg(F.count(F.lit(1)).alias("entries"))
