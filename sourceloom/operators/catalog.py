"""Catalog queries: tenancy, listings, paging, latest runs, dashboards and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.functions import scalars as S
from sourceloom.functions.ranking import top_per_group

REPO = "repository_id"


# ---- tenancy -------------------------------------------------------------------------------
def visible_to(rows: DataFrame, members: DataFrame, user_id, write: bool = False) -> DataFrame:
    """Rows of workspaces the user belongs to; writing needs an owner or admin role."""
    mine = members.where(F.col("user_id") == user_id)
    if write:
        mine = mine.where(F.col("role").isin(*V.WRITE_ROLES))
    return rows.join(mine.select("workspace_id"), "workspace_id", "left_semi")


def visible_pairs(rows: DataFrame, members: DataFrame, write: bool = False) -> DataFrame:
    """Number of visible rows per user, for all users at once.

    Rows are counted per workspace before the membership join, so a huge workspace is one row.
    """
    allowed = members.where(F.col("role").isin(*V.WRITE_ROLES)) if write else members
    sizes = rows.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"))
    return allowed.join(sizes, "workspace_id").groupBy("user_id").agg(F.sum("n").alias("visible_rows"))


def workspace_members(members: DataFrame, workspaces: DataFrame, user_id) -> DataFrame:
    """Member count of each workspace the user belongs to."""
    mine = visible_to(workspaces, members, user_id)
    counts = members.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("member_count"))
    return mine.join(counts, "workspace_id")


def favorites_of(rows: DataFrame, favorites: DataFrame, user_id, key: str) -> DataFrame:
    return rows.join(favorites.where(F.col("user_id") == user_id).select(key), key, "left_semi")


def with_tag(repositories: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    return repositories.join(tags.where(F.col("tag") == tag.lower()).select(REPO), REPO, "left_semi")


def with_project_name(activity: DataFrame, projects: DataFrame) -> DataFrame:
    """Activity rows with their project's name, null when there is no project."""
    return activity.join(projects.select("project_id", F.col("name").alias("project_name")), "project_id", "left")


# ---- runs ----------------------------------------------------------------------------------
def latest_run(runs: DataFrame, time_column: str = "started_at", statuses=None) -> DataFrame:
    """Latest run per repository (optionally of some statuses), as one map-side combined aggregate."""
    kept = runs if statuses is None else runs.where(F.col("status").isin(*statuses))
    latest = F.struct(F.col(time_column), F.col("id"))
    columns = [c for c in runs.columns if c != REPO]
    return kept.groupBy(REPO).agg(F.max_by(F.struct(*columns), latest).alias("_r")).select(REPO, "_r.*")


def nested_report(heads: DataFrame, parts: dict[str, DataFrame], key: str = REPO) -> DataFrame:
    """One record per head row with each part's rows of the same key as a sorted list of structs.

    Parts are summary tables (languages, metrics, cycles kept) with few rows per key.
    """
    table = heads
    for name, rows in parts.items():
        entry = F.struct(*[c for c in rows.columns if c != key])
        table = table.join(rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias(name)), key, "left")
    return table


def active_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin(*V.ACTIVE_STATUSES))


# ---- listings ------------------------------------------------------------------------------
SEARCH_COLUMN = {"files": "path", "functions": "name", "classes": "name", "modules": "name", "imports": "module"}


def ilike_search(table: DataFrame, entity: str, term: str) -> DataFrame:
    """Case-insensitive contains on the entity's search column."""
    return table.where(F.col(SEARCH_COLUMN[entity]).ilike(f"%{term}%"))


def catalog_search(table: DataFrame, term: str) -> DataFrame:
    pattern = f"%{term.strip()}%"
    return table.where(F.col("name").ilike(pattern) | F.col("description").ilike(pattern))


def page(table: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one-row total). The order must be total; only offset+limit rows are kept."""
    rows = table.orderBy(*order).offset(offset).limit(limit)
    return rows, table.agg(F.count(F.lit(1)).alias("total"))


SORT_COLUMNS = ("name", "created_at", "updated_at")


def list_repositories(repositories: DataFrame, project_id, *, search=None, status=None, visibility=None, repo_type=None,
                      language=None, tags: DataFrame | None = None, tag=None, favorites: DataFrame | None = None,
                      favorite_user=None, sort: str = "updated_at", order: str = "desc", limit: int = 50,
                      offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A project's repositories with optional filters: (page, total before the limit)."""
    kept = repositories.where(F.col("project_id") == project_id)
    if search:
        kept = catalog_search(kept, search)
    for column, value in (("status", status), ("visibility", visibility), ("repo_type", repo_type), ("language", language)):
        if value is not None:
            kept = kept.where(F.col(column) == value)
    if tag is not None:
        kept = with_tag(kept, tags, tag)
    if favorite_user is not None:
        kept = favorites_of(kept, favorites, favorite_user, REPO)
    column = sort if sort in SORT_COLUMNS else "updated_at"
    return page(kept, [F.col(column).asc() if order == "asc" else F.col(column).desc(), F.col(REPO)], limit, offset)


def recent_per(table: DataFrame, key: str, time_column: str, id_column: str, k: int) -> DataFrame:
    """The ``k`` newest rows per key, e.g. projects or activity of a workspace."""
    return top_per_group(table, [key], [F.desc(time_column), F.col(id_column)], k)


def explorer_list(files: DataFrame, folder: str, *, search=None, language=None, extension=None, sort: str = "name",
                  ascending: bool = True) -> DataFrame:
    """Direct files of a folder with name, language and extension filters, sorted by any column."""
    kept = files.where(F.col("folder_path") == folder)
    if search:
        kept = kept.where(F.lower("name").contains(search.lower()))
    if language:
        kept = kept.where(F.col("language") == language)
    if extension:
        kept = kept.where(F.col("name").endswith(extension))
    return kept.orderBy(F.col(sort).asc() if ascending else F.col(sort).desc(), "path")


def symbol_filter(table: DataFrame, search: str = "", file_type: str | None = None, folder: str | None = None,
                  sort: str = "lines") -> DataFrame:
    """Symbol rows whose name or file contains the text, in the given file type or folder, largest first."""
    kept = table.where(F.lower("name").contains(search.lower()) | F.lower("file_path").contains(search.lower()))
    if file_type:
        kept = kept.where(F.col("file_path").endswith(file_type))
    if folder:
        kept = kept.where(F.col("file_path").startswith(f"{folder.rstrip('/')}/"))
    return kept.orderBy(F.desc(sort), "file_path", "name")


def nodes_page(nodes: DataFrame, limit: int = 5000, offset: int = 0) -> DataFrame:
    return nodes.orderBy("entity_type", "label", "node_id").offset(offset).limit(limit)


def edges_page(edges: DataFrame, limit: int = 10000, offset: int = 0) -> DataFrame:
    return edges.orderBy("relationship_type", "src", "dst").offset(offset).limit(limit)


def graph_extract(nodes: DataFrame, edges: DataFrame, entity_type: str | None = None, limit_nodes: int = 2000,
                  limit_edges: int = 5000) -> tuple[DataFrame, DataFrame]:
    """A page of nodes (optionally of one type) and of edges, both in key order."""
    kept = nodes if entity_type is None else nodes.where(F.col("entity_type") == entity_type)
    return (kept.orderBy("node_id").limit(limit_nodes),
            edges.orderBy("src", "dst", "relationship_type").limit(limit_edges))


# ---- dashboards ----------------------------------------------------------------------------
def last_activity(log: DataFrame, key: str, time_column: str = "ts") -> DataFrame:
    """Formatted time of the newest row per key."""
    return log.groupBy(key).agg(F.date_format(F.max(time_column), "yyyy-MM-dd HH:mm:ss").alias("last_activity"))


def dashboard_overview(workspaces: DataFrame, projects: DataFrame, log: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """Project count, repositories, mean health (100 when empty) and last activity per workspace.

    ``dependencies`` (workspace_id, indexed_dependencies, architecture_graphs) supplies real counts.
    """
    totals = projects.groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("total_projects"), F.sum("repository_count").alias("total_repositories"),
        F.avg("health_score").cast("int").alias("avg_health"))
    table = (workspaces.select("workspace_id").join(totals, "workspace_id", "left")
             .join(last_activity(log, "workspace_id"), "workspace_id", "left"))
    table = table.na.fill(0, ["total_projects", "total_repositories"]).na.fill(100, ["avg_health"]).na.fill("Never", ["last_activity"])
    return table if dependencies is None else table.join(dependencies, "workspace_id", "left").na.fill(
        0, ["indexed_dependencies", "architecture_graphs"])


def status_counts(repositories: DataFrame, statuses=("uploaded", "connected", "archived")) -> DataFrame:
    return repositories.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def project_totals(projects: DataFrame, search: str = "", status: str | None = None) -> DataFrame:
    """Repository sum and rounded mean health over the projects passing the filters."""
    kept = projects.where(F.lower("name").contains(search.lower()) | F.lower("status").contains(search.lower()))
    if status:
        kept = kept.where(F.col("status") == status)
    return kept.agg(F.count(F.lit(1)).alias("projects"), F.coalesce(F.sum("repository_count"), F.lit(0)).alias("repositories"),
                    F.coalesce(F.floor(F.avg("health_score") + 0.5), F.lit(0)).cast("long").alias("avg_health"))


def facets(table: DataFrame, *columns: str) -> DataFrame:
    """(facet, value): distinct non-null values of each column; array columns are exploded."""
    parts = None
    arrays = {f.name for f in table.schema.fields if f.dataType.typeName() == "array"}
    for column in columns:
        value = F.explode(column) if column in arrays else F.col(column)
        part = (table.select(value.alias("value")).where("value is not null").distinct()
                .select(F.lit(column).alias("facet"), F.col("value").cast("string").alias("value")))
        parts = part if parts is None else parts.unionByName(part)
    return parts


# ---- validation projections ----------------------------------------------------------------
def validated_repositories(table: DataFrame) -> DataFrame:
    """Normalised name and tags with the error each row would be refused for."""
    return table.withColumns({
        "clean_name": S.normalized_name(F.col("name")), "name_error": S.name_error(F.col("name")),
        "clean_tags": S.normalized_tags(F.col("tags")), "tags_error": S.tags_error(F.col("tags"))})


def validated_sources(table: DataFrame) -> DataFrame:
    return table.withColumn("source_error", S.git_source_error(F.col("git_url"), F.col("git_branch")))
