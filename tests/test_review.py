"""Inputs on which answers were once wrong."""

from pyspark.sql import functions as F

from sourceloom.functions import scalars as S
from sourceloom.operators.traverse import call_chain
from sourceloom.plans.analysis import analyze


def test_scan_warnings_count_and_folder_entries_do_not(spark):
    raw = spark.createDataFrame([("r", "src/", None, False), ("r", "src/a.py", bytearray(b"x = 1\n"), False), ("r", "link", None, True)],
                                "repository_id string, path string, content binary, is_symlink boolean")
    row = analyze(raw).summary().first()
    assert (row.files_discovered, row.errors_count, row.status) == (1, 1, "completed_with_warnings")


def test_tags_lose_line_breaks(spark):
    row = spark.createDataFrame([(["abc\n", " abc", "a b"],)], "tags array<string>").select(
        S.normalized_tags(F.col("tags")).alias("tags"), S.tags_error(F.slice("tags", 1, 2)).alias("error")).first()
    assert row.tags == ["abc", "a b"] and row.error is None


def test_a_depth_of_20_walks_20(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "CALLS") for i in range(30)], "src string, dst string, relationship_type string")
    assert call_chain(edges, spark.createDataFrame([("n0",)], "root string"), 20).count() == 20
