"""History operators on a small fixture against plain Python."""

import datetime

from pyspark.sql import functions as F

from sourceloom.functions.ranking import running_totals, share_below
from sourceloom.operators import history as H


def inputs(spark):
    day = lambda n: datetime.datetime(2026, 6, n, 10)
    commits = spark.createDataFrame(
        [("r", "c1", "ann", day(1), "main", "Feature"), ("r", "c2", "bob", day(2), "main", "Fix"), ("r", "c3", "ann", day(2), "dev", "Fix"),
         ("r", "c4", "bob", day(5), "main", "Test")], "repository_id string, hash string, author string, ts timestamp_ntz, branch string, type string")
    files = spark.createDataFrame(
        [("c1", "a/x", 5, 0), ("c1", "b/y", 1, 1), ("c2", "a/x", 2, 2), ("c3", "a/x", 1, 0), ("c3", "b/y", 9, 9), ("c4", "c/z", 1, 0)],
        "hash string, path string, insertions long, deletions long")
    return commits, files


def test_lifecycle_and_replay(spark):
    commits, files = inputs(spark)
    steps = {(r["path"], r["hash"]): (r["step"], r["state"]) for r in H.file_lifecycle(commits, files).collect()}
    assert steps[("a/x", "c1")] == (1, "Created") and steps[("a/x", "c2")] == (2, "Modified") and steps[("a/x", "c3")] == (3, "Modified")
    seen = [(r["hash"], r["files"], r["modules"]) for r in H.replay(
        commits, files, {"files": F.col("path"), "modules": F.substring_index("path", "/", 1)}).orderBy("commit_index").collect()]
    assert seen == [("c1", 2, 2), ("c2", 2, 2), ("c3", 2, 2), ("c4", 3, 3)]


def test_statistics_and_co_change(spark):
    commits, files = inputs(spark)
    stats = H.history_stats(commits, files).first()
    assert (stats["total_commits"], stats["contributors"], stats["most_active_branch"], stats["largest_commit"]) == (4, 2, "main", "c3")
    assert (stats["most_modified_file"], stats["oldest_file"], stats["newest_file"], stats["commits_per_day"]) == ("a/x", "a/x", "c/z", 0.8)
    pairs = H.co_change(commits, files, spark.createDataFrame([("r", "a/x")], "repository_id string, path string")).collect()
    assert [(r["target"], r["partner"], r["support"], r["confidence"]) for r in pairs] == [("a/x", "b/y", 2, 66.67)]
    related = H.related_commits(commits, files, spark.createDataFrame([("r", "c1")], "repository_id string, hash string")).orderBy("rank").collect()
    assert [(r["hash"], r["shared_files"]) for r in related] == [("c3", 2), ("c2", 1)]
    found = H.filter_commits(commits, files, author="ann", file="b/y", since="2026-06-02").collect()
    assert [r["hash"] for r in found] == ["c3"]


def test_running_totals_match_a_plain_window(spark):
    rows = spark.range(500).select(F.lit("hot").alias("k"), (F.col("id") % 7).alias("bucket"), F.col("id").alias("v"))
    got = running_totals(rows, ["k"], F.col("bucket"), [F.col("v")], {"total": F.col("v")})
    ordered = sorted((r["bucket"], r["v"], r["total"]) for r in got.collect())
    total = 0
    for _, value, running in ordered:
        total += value
        assert running == total


def test_share_below_is_exact(spark):
    rows = spark.createDataFrame([("k", v) for v in [1, 1, 2, 5, 5, 5, 9, 9]], "k string, v int")
    assert {r["v"]: r["share_below"] for r in share_below(rows, ["k"], "v").collect()} == {1: 0.0, 2: 0.25, 5: 0.375, 9: 0.75}


def test_repositories_that_share_paths_and_hashes_stay_apart(spark):
    """Two repositories with the same paths, and one commit hash that both have."""
    commits = spark.createDataFrame([(r, h, d) for r in "ab" for h, d in (("c1", "2026-01-01"), ("c2", "2026-01-02"), ("c3", "2026-01-03"))],
                                    "repository_id string, hash string, day string").selectExpr("repository_id", "hash", "cast(day as timestamp_ntz) as ts")
    touched = [("a", "c1", "x"), ("a", "c1", "y"), ("a", "c2", "x"), ("a", "c2", "y"), ("a", "c3", "x"), ("b", "c1", "x"), ("b", "c2", "x"), ("b", "c2", "z"), ("b", "c3", "x"), ("b", "c3", "z")]
    files = spark.createDataFrame(touched, "repository_id string, hash string, path string")
    targets = spark.createDataFrame([("a", "x"), ("b", "x")], "repository_id string, path string")
    pairs = {(r["repository_id"], r["partner"], r["support"], r["target_changes"]) for r in H.co_change(commits, files, targets).collect()}
    assert pairs == {("a", "y", 2, 3), ("b", "z", 2, 3)}
    related = H.related_commits(commits, files, spark.createDataFrame([("a", "c1"), ("b", "c2")], "repository_id string, hash string"))
    assert {(r["repository_id"], r["target"], r["hash"], r["shared_files"]) for r in related.collect()} == {
        ("a", "c1", "c2", 2), ("a", "c1", "c3", 1), ("b", "c2", "c3", 2), ("b", "c2", "c1", 1)}
