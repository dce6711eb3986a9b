"""Commit history analytics over commits and commit_files tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.ranking import running_totals, share_below, top_per_group

REPO = "repository_id"


def filter_commits(commits: DataFrame, commit_files: DataFrame | None = None, *, search: str | None = None,
                   branch: str | None = None, author=None, commit_type: str | None = None, file: str | None = None,
                   since: str | None = None, until: str | None = None) -> DataFrame:
    """Commits passing every given filter; ``file`` is a semi join on the touched paths."""
    kept = commits
    if search:
        kept = kept.where(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("hash", "author", "branch", "type")]))
                          .contains(search.lower()))
    for column, value in (("branch", branch), ("author", author), ("type", commit_type)):
        if value is not None:
            kept = kept.where(F.col(column) == value)
    if since is not None:
        kept = kept.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        kept = kept.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    if file is not None:
        kept = kept.join(commit_files.where(F.col("path") == file).select("hash").distinct(), "hash", "left_semi")
    return kept


def commit_size(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Files and line changes per commit, commits without files kept."""
    sizes = commit_files.groupBy("hash").agg(
        F.count(F.lit(1)).alias("files_changed"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    return commits.select(REPO, "hash").join(sizes, "hash", "left").na.fill(0, ["files_changed", "insertions", "deletions"])


def _dated(commits: DataFrame, commit_files: DataFrame, *columns: str) -> DataFrame:
    """File rows with their commit; files that name their repository only meet that one's commits."""
    keys = [REPO, "hash"] if REPO in commit_files.columns else ["hash"]
    return commit_files.join(commits.select(REPO, "hash", "ts", *columns), keys)


def file_changes(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Change count with first and last change per file."""
    when = F.struct("ts", "hash")
    return _dated(commits, commit_files).groupBy(REPO, "path").agg(
        F.count(F.lit(1)).alias("changes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("hash", when).alias("first_hash"), F.max_by("hash", when).alias("last_hash"))


def history_stats(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Totals, daily average and the extremes of branch, commit and file, per repository."""
    per_author = commits.groupBy(REPO, "author").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    base = per_author.groupBy(REPO).agg(
        F.sum("n").alias("total_commits"), F.count(F.lit(1)).alias("contributors"),
        (F.date_diff(F.max("b"), F.min("a")) + 1).alias("days"))
    base = base.withColumn("commits_per_day", F.round(F.col("total_commits") / F.col("days"), 1)).drop("days")
    branches = commits.groupBy(REPO, "branch").agg(F.count(F.lit(1)).alias("n"))
    branch = branches.groupBy(REPO).agg(F.min_by("branch", F.struct(-F.col("n"), F.col("branch"))).alias("most_active_branch"))
    size = F.col("insertions") + F.col("deletions")
    largest = commit_size(commits, commit_files).groupBy(REPO).agg(
        F.min_by("hash", F.struct(-size, F.col("hash"))).alias("largest_commit"))
    files = file_changes(commits, commit_files).groupBy(REPO).agg(
        F.min_by("path", F.struct(-F.col("changes"), F.col("path"))).alias("most_modified_file"),
        F.min_by("path", F.struct("first_ts", "path")).alias("oldest_file"),
        F.max_by("path", F.struct("first_ts", "path")).alias("newest_file"))
    return base.join(branch, REPO).join(largest, REPO).join(files, REPO, "left")


def author_insights(commits: DataFrame, commit_files: DataFrame, area: Column) -> DataFrame:
    """Commits, distinct files and the three areas with most changes per author."""
    totals = commits.groupBy(REPO, "author").agg(F.count(F.lit(1)).alias("commits"))
    touched = _dated(commits, commit_files, "author")
    per_file = touched.groupBy(REPO, "author", "path").agg(F.count(F.lit(1)).alias("n"))
    files = per_file.groupBy(REPO, "author").agg(F.count(F.lit(1)).alias("files_modified"))
    areas = per_file.groupBy(REPO, "author", area.alias("area")).agg(F.sum("n").alias("n"))
    best = (top_per_group(areas, [REPO, "author"], [F.desc("n"), F.col("area")], 3).groupBy(REPO, "author").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "area"))), lambda s: s["area"]), ",").alias("active_areas")))
    return (totals.join(files, [REPO, "author"], "left").join(best, [REPO, "author"], "left")
            .withColumn("files_modified", F.coalesce("files_modified", F.lit(0))))


def author_timeline(commits: DataFrame) -> DataFrame:
    """Commits per author and week (weeks start on Monday)."""
    return commits.groupBy(REPO, "author", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count(F.lit(1)).alias("commits"))


def file_hotspots(changes: DataFrame) -> DataFrame:
    """Files with change counts and a risk label from the share of files changed less often."""
    shared = share_below(changes.select(REPO, "path", "changes"), [REPO], "changes")
    risk = F.when(F.col("share_below") >= 0.9, "High").when(F.col("share_below") >= 0.7, "Medium").otherwise("Low")
    return shared.select(REPO, "path", "changes", risk.alias("risk"))


def hotspot_report(changes: DataFrame, k: int = 10) -> DataFrame:
    return top_per_group(file_hotspots(changes), [REPO], [F.desc("changes"), F.col("path")], k)


def stable_files(changes: DataFrame, k: int = 10) -> DataFrame:
    """The least changed files per repository."""
    return top_per_group(changes.select(REPO, "path", "changes"), [REPO], [F.col("changes"), F.col("path")], k)


def module_activity(commits: DataFrame, commit_files: DataFrame, module: Column, days: int = 90) -> DataFrame:
    """Changes per module within ``days`` of the repository's latest commit; quiet ones are stable areas."""
    latest = commits.groupBy(REPO).agg(F.max("ts").alias("latest"))
    rows = _dated(commits, commit_files).join(latest, REPO)
    recent = F.col("ts") >= F.col("latest") - F.expr(f"interval {int(days)} days")
    return (rows.groupBy(REPO, module.alias("module")).agg(F.count_if(recent).alias("recent_changes"), F.count(F.lit(1)).alias("changes"))
            .withColumn("state", F.when(F.col("recent_changes") > 0, "recently_active").otherwise("stable")))


def co_change(commits: DataFrame, commit_files: DataFrame, targets: DataFrame, min_support: int = 2) -> DataFrame:
    """Files that change in the same commits as each target: support and confidence percent.

    ``targets`` has repository_id and ``path``; a path that several repositories have is a file of its own in each. The work is the
    targets' commits times their files; pairs are never formed inside a commit except with a target.
    """
    touches = _dated(commits, commit_files).select(REPO, "hash", "path").distinct()
    wanted = touches.join(targets.select(REPO, "path").distinct(), [REPO, "path"], "left_semi").withColumnRenamed("path", "target")
    totals = wanted.groupBy(REPO, "target").agg(F.count(F.lit(1)).alias("target_changes"))
    together = (touches.join(wanted, [REPO, "hash"]).where("path <> target").groupBy(REPO, "target", F.col("path").alias("partner"))
                .agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support))
    return together.join(totals, [REPO, "target"]).withColumn(
        "confidence", F.round(F.col("support") * 100 / F.col("target_changes"), 2))


def file_lifecycle(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Every change of every file numbered in time order with its state and commit.

    Numbers come from daily totals plus the position inside the day, so a file touched by most
    commits is not sorted in one task.
    """
    rows = _dated(commits, commit_files).select(REPO, "path", "hash", "ts")
    numbered = running_totals(rows, [REPO, "path"], F.to_date("ts"), [F.col("ts"), F.col("hash")], {"step": F.lit(1)})
    return numbered.withColumn("state", F.when(F.col("step") == 1, "Created").otherwise("Modified"))


def function_evolution(before: DataFrame, after: DataFrame) -> DataFrame:
    """State of each function between two snapshots (repository_id, qualified_name, body_hash)."""
    old = before.select(REPO, "qualified_name", F.col("body_hash").alias("old_hash"))
    new = after.select(REPO, "qualified_name", F.col("body_hash").alias("new_hash"))
    state = (F.when(F.col("old_hash").isNull(), "Created").when(F.col("new_hash").isNull(), "Removed")
             .when(F.col("old_hash") == F.col("new_hash"), "Unchanged").otherwise("Modified"))
    return old.join(new, [REPO, "qualified_name"], "full_outer").select(REPO, "qualified_name", state.alias("state"))


def replay(commits: DataFrame, commit_files: DataFrame, entities: dict[str, Column]) -> DataFrame:
    """Cumulative number of distinct entities seen up to each commit, with the commit's index.

    Each entity counts at its first commit; first sightings are then summed along the history.
    """
    rows = _dated(commits, commit_files)
    timeline = commits.select(REPO, "hash", "ts")
    for name, entity in entities.items():
        first = (rows.groupBy(REPO, entity.alias("entity")).agg(F.min_by("hash", F.struct("ts", "hash")).alias("hash"))
                 .groupBy(REPO, "hash").agg(F.count(F.lit(1)).alias(f"_new_{name}")))
        timeline = timeline.join(first, [REPO, "hash"], "left")
    measures = {name: F.coalesce(f"_new_{name}", F.lit(0)) for name in entities} | {"commit_index": F.lit(1)}
    summed = running_totals(timeline, [REPO], F.to_date("ts"), [F.col("ts"), F.col("hash")], measures)
    return summed.select(REPO, (F.col("commit_index") - 1).alias("commit_index"), "hash", *entities)


def related_commits(commits: DataFrame, commit_files: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """For each target commit (repository_id, hash) the ``k`` other commits of its repository sharing most files."""
    touches = _dated(commits, commit_files).select(REPO, "hash", "path").distinct()
    wanted = touches.join(targets.select(REPO, "hash").distinct(), [REPO, "hash"], "left_semi").withColumnRenamed("hash", "target")
    shared = (touches.join(wanted, [REPO, "path"]).where("hash <> target").groupBy(REPO, "target", "hash")
              .agg(F.count(F.lit(1)).alias("shared_files")))
    return top_per_group(shared, [REPO, "target"], [F.desc("shared_files"), F.col("hash")], k)
