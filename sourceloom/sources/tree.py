"""Source trees as tables: scan, decode, fingerprint, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.functions import scalars as S
from sourceloom.functions.ranking import top_per_group

WARNING_SCHEMA = "repository_id string, path string, code string, message string"


def scan_source_tree(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and warnings of a table (repository_id, path, content BINARY[, is_symlink, read_error]).

    Rows below an ignored directory and entries for directories are dropped; symbolic links and unreadable entries become
    warnings. File tables come from a table or from archives: a raw directory read would lose
    dot and underscore names.
    """
    columns = raw.columns
    link = F.col("is_symlink") if "is_symlink" in columns else F.lit(False)
    problem = F.col("read_error") if "read_error" in columns else F.lit(None).cast("string")
    kept = raw.where(~S.in_ignored_directory(F.col("path")) & ~F.col("path").endswith("/"))
    files = kept.where(~link & problem.isNull()).select("repository_id", "path", "content")
    warnings = kept.where(link | problem.isNotNull()).select(
        "repository_id", "path",
        F.when(link, "symlink_skipped").otherwise("file_unreadable").alias("code"),
        F.when(link, F.lit(V.SYMLINK_MESSAGE)).otherwise(problem).alias("message"))
    return files, warnings


def describe_files(files: DataFrame, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    """One projection: path parts, language, size, hash, decoded text, line count, parse status.

    ``content`` is binary. Only files of a known language are decoded.
    """
    name = S.file_name(F.col("path"))
    known = F.col("language") != V.UNKNOWN_LANGUAGE
    too_large = known & (F.col("size_bytes") > max_bytes)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    body = F.col("content").cast("string")
    text = F.when(body.startswith("﻿"), F.substr(body, F.lit(2))).otherwise(body)
    error = (F.when(too_large, V.TOO_LARGE_MESSAGE).when(known & ~valid, V.NOT_UTF8_MESSAGE))
    return (files
            .withColumn("name", name)
            .withColumn("folder_path", S.folder_path(F.col("path")))
            .withColumn("extension", S.suffix(name))
            .withColumn("language", S.detect_language(name))
            .withColumn("size_bytes", F.octet_length("content").cast("long"))
            .withColumn("content_hash", S.fingerprint(F.col("content")))
            .withColumn("parse_error", error)
            .withColumn("text", F.when(known & F.col("parse_error").isNull(), text))
            .withColumn("encoding", F.when(F.col("text").isNotNull(), V.TEXT_ENCODING))
            .withColumn("lines_of_code", S.count_lines(F.col("text")))
            .withColumn("parse_status", F.when(F.col("parse_error").isNotNull(), "skipped")
                        .otherwise("not_applicable"))
            .drop("content"))


def collect_warnings(*streams: DataFrame, keep: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Union the warning streams; returns (all rows, or the first ``keep`` per repository, and full counts)."""
    everything = streams[0].select("repository_id", "path", "code", "message")
    for stream in streams[1:]:
        everything = everything.unionByName(stream.select("repository_id", "path", "code", "message"))
    kept = everything if keep is None else top_per_group(
        everything, ["repository_id"], [F.col("path"), F.col("code"), F.col("message")], keep).drop("rank")
    counts = everything.groupBy("repository_id").agg(F.count(F.lit(1)).alias("warnings"))
    return kept, counts
