"""Rollups over file and symbol tables, per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.functions import scalars as S

REPO = "repository_id"


def language_stats(files: DataFrame) -> DataFrame:
    """Files, lines, bytes and share of bytes per language; the window only sees language rows."""
    per_language = files.groupBy(REPO, "language").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("lines_of_code").alias("lines_of_code"),
        F.sum("size_bytes").alias("size_bytes"))
    total = F.sum("size_bytes").over(W.partitionBy(REPO))
    share = F.round(F.col("size_bytes") * 100 / F.when(total > 0, total).otherwise(1), 2)
    return per_language.withColumn("percentage", share)


def primary_language(files: DataFrame) -> DataFrame:
    """Language with most files, Unknown excluded; ties go to the first in path order."""
    counted = (files.where(F.col("language") != V.UNKNOWN_LANGUAGE).groupBy(REPO, "language")
               .agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")))
    return counted.groupBy(REPO).agg(
        F.min_by("language", F.struct(-F.col("n"), F.col("first_path"))).alias("primary_language"))


def folder_rollup(files: DataFrame) -> DataFrame:
    """Every folder with recursive file and byte totals and its number of direct sub-folders.

    Files are totalled per folder first, so only distinct folders are expanded to their ancestors.
    """
    direct = files.groupBy(REPO, "folder_path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))
    totals = (direct.select(REPO, F.explode(S.ancestor_folders(F.col("folder_path"))).alias("path"), "n", "bytes")
              .groupBy(REPO, "path").agg(F.sum("n").alias("total_files"), F.sum("bytes").alias("total_size_bytes")))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    named = totals.select(
        REPO, "path", F.when(F.col("path") == "", "/").otherwise(S.file_name(F.col("path"))).alias("name"),
        depth.alias("depth"), F.when(F.col("path") != "", S.folder_path(F.col("path"))).alias("parent_path"),
        "total_files", "total_size_bytes")
    return named.join(folder_children(named), [REPO, "path"], "left").withColumn(
        "children_count", F.coalesce("children_count", F.lit(0)))


def folder_children(folders: DataFrame) -> DataFrame:
    """Number of direct sub-folders per folder that has any."""
    return (folders.where("parent_path is not null").groupBy(REPO, F.col("parent_path").alias("path"))
            .agg(F.count(F.lit(1)).alias("children_count")))


def largest_file(files: DataFrame) -> DataFrame:
    return files.groupBy(REPO).agg(
        F.min_by("path", F.struct(-F.col("size_bytes"), F.col("path"))).alias("largest_file_path"),
        F.max("size_bytes").alias("largest_file_size"))


def largest_folder(folders: DataFrame) -> DataFrame:
    order = F.struct(-F.col("total_size_bytes"), F.col("depth"), F.col("path"))
    return folders.groupBy(REPO).agg(
        F.min_by("path", order).alias("largest_folder_path"),
        F.max("total_size_bytes").alias("largest_folder_size"))


def _count(table: DataFrame, name: str) -> DataFrame:
    return table.groupBy(REPO).agg(F.count(F.lit(1)).alias(name))


def repository_metrics(files: DataFrame, folders: DataFrame, functions: DataFrame, classes: DataFrame,
                       modules: DataFrame, imports: DataFrame) -> DataFrame:
    """The thirteen repository totals; every input is reduced to one row per repository first."""
    base = files.groupBy(REPO).agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("lines_of_code").alias("lines_of_code"),
        F.count_distinct(F.when(F.col("language") != V.UNKNOWN_LANGUAGE, F.col("language"))).alias("languages"),
        F.min_by("path", F.struct(-F.col("size_bytes"), F.col("path"))).alias("largest_file_path"),
        F.max("size_bytes").alias("largest_file_size"))
    tree = folders.groupBy(REPO).agg(F.count_if(F.col("path") != "").alias("total_folders")).join(
        largest_folder(folders), REPO)
    per_module = modules.groupBy(REPO).agg(
        F.count(F.lit(1)).alias("modules"), F.count_if("is_package").alias("packages"))
    joined = (base.join(tree, REPO, "left").join(per_module, REPO, "left")
              .join(_count(functions, "functions"), REPO, "left").join(_count(classes, "classes"), REPO, "left")
              .join(_count(imports, "imports"), REPO, "left"))
    return joined.na.fill(0, ["total_folders", "modules", "packages", "functions", "classes", "imports"])


def run_summary(files: DataFrame, extra_warnings: DataFrame | None = None) -> DataFrame:
    """Discovered and parsed files, warning count and final run status per repository."""
    counted = files.groupBy(REPO).agg(
        F.count(F.lit(1)).alias("files_discovered"),
        F.count_if(F.col("parse_status") == "parsed").alias("files_parsed"),
        F.count_if(F.col("parse_status").isin("failed", "skipped")).alias("errors_count"))
    if extra_warnings is not None:
        counted = (counted.join(_count(extra_warnings, "_more"), REPO, "left")
                   .withColumn("errors_count", F.col("errors_count") + F.coalesce("_more", F.lit(0))).drop("_more"))
    return counted.withColumn("status", F.when(F.col("errors_count") > 0, "completed_with_warnings")
                              .otherwise("completed"))


def import_frequency(imports: DataFrame) -> DataFrame:
    """Imported targets with counts and whether they are relative (internal)."""
    target = F.when(F.col("imported_name").isNotNull(), F.concat_ws(".", "module", "imported_name")).otherwise(F.col("module"))
    return imports.groupBy(REPO, target.alias("target"), S.import_scope(F.col("level")).alias("scope")).agg(
        F.count(F.lit(1)).alias("import_count"))


def symbol_table_functions(functions: DataFrame) -> DataFrame:
    """Functions with line span, parameter count and complexity label."""
    return functions.select(
        REPO, "file_path", "name", "qualified_name", "visibility",
        S.line_span(F.col("start_line"), F.col("end_line")).alias("lines"),
        F.when(F.col("is_async"), "Medium").otherwise("Low").alias("complexity"),
        F.coalesce(F.size("parameters"), F.lit(0)).alias("params"),
        F.coalesce("return_type", F.lit("Unknown")).alias("return_type"))


def symbol_table_classes(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Classes with their method counts and base list."""
    owner = F.concat_ws(".", "module", F.array_join("class_path", "."))
    methods = (functions.where(F.size("class_path") > 0)
               .groupBy(REPO, "file_path", owner.alias("qualified_name")).agg(F.count(F.lit(1)).alias("methods")))
    bases = F.when(F.size("bases") > 0, F.array_join("bases", ", ")).otherwise("None")
    return (classes.select(REPO, "file_path", "name", "qualified_name", bases.alias("inheritance"))
            .join(methods, [REPO, "file_path", "qualified_name"], "left")
            .withColumn("methods", F.coalesce("methods", F.lit(0))))
