"""ZIP archives as a source: one row per member, whole archives rejected by rule."""

from __future__ import annotations

import io
import stat
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.functions import scalars as S
from sourceloom.session import stored

_LISTING = """repository_id string, path string, content binary, mode int, declared_bytes long,
              problem string"""


_COLUMNS = ["repository_id", "path", "content", "mode", "declared_bytes", "problem"]
#: Extracted bytes gathered before a batch is handed back to Spark.
_FLUSH_BYTES = 16 * 1024 * 1024


def _open_archive(repository_id: str, blob: bytes, max_members: int, max_extracted: int) -> Iterator[tuple]:
    """Member rows of one archive; contents are read only when the declared sizes allow it."""
    try:
        with zipfile.ZipFile(io.BytesIO(blob)) as archive:
            listing = archive.infolist()
            readable = len(listing) <= max_members and sum(m.file_size for m in listing) <= max_extracted
            for member in listing:
                body = archive.read(member) if readable and not member.is_dir() else None
                yield (repository_id, member.filename.replace("\\", "/"), body, member.external_attr >> 16, member.file_size, None)
            if not listing:
                yield (repository_id, None, None, 0, 0, None)
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, ValueError, RuntimeError):
        yield (repository_id, None, None, 0, 0, V.ARCHIVE_CORRUPT)


def _members(batches: Iterator[pd.DataFrame], max_members: int, max_extracted: int) -> Iterator[pd.DataFrame]:
    rows, size = [], 0
    for batch in batches:
        for repository_id, blob in zip(batch["repository_id"], batch["content"]):
            for row in _open_archive(repository_id, blob, max_members, max_extracted):
                rows.append(row)
                size += len(row[2] or b"")
                if size > _FLUSH_BYTES or len(rows) >= 5_000:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=_COLUMNS)


def explode_archives(archives: DataFrame, max_members: int = V.MAX_ARCHIVE_MEMBERS,
                     max_extracted: int = V.MAX_EXTRACTED_BYTES,
                     max_archive: int = V.MAX_ARCHIVE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of a table (repository_id, content BINARY), one archive per repository.

    Python only opens the ZIP container, once: its members are written to the shared folder. Every
    rule is a Spark expression and one bad member rejects its whole archive.
    """
    within = F.octet_length("content") <= max_archive
    listed = stored(archives.where(within).select("repository_id", "content").mapInPandas(
        lambda batches: _members(batches, max_members, max_extracted), _LISTING), "archive-members")
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    link = F.col("mode").bitwiseAND(0o170000) == stat.S_IFLNK
    verdicts = listed.groupBy("repository_id").agg(
        F.max("problem").alias("problem"), F.count("path").alias("members"),
        F.sum("declared_bytes").alias("declared"),
        F.coalesce(F.bool_or(unsafe), F.lit(False)).alias("unsafe"),
        F.coalesce(F.bool_or(link), F.lit(False)).alias("link"))
    reason = (F.when(F.col("problem").isNotNull(), F.col("problem"))
              .when((F.col("members") == 0) | (F.col("members") > max_members), V.ARCHIVE_BAD_COUNT)
              .when(F.col("unsafe"), V.ARCHIVE_UNSAFE_PATH)
              .when(F.col("link"), V.ARCHIVE_SYMLINK)
              .when(F.col("declared") > max_extracted, V.ARCHIVE_EXPANDS_TOO_BIG))
    rejects = (verdicts.select("repository_id", reason.alias("reason")).where("reason is not null")
               .unionByName(archives.where(~within).select(
                   "repository_id", F.lit(V.ARCHIVE_TOO_BIG).alias("reason"))))
    entries = (listed.where(F.col("path").isNotNull())
               .join(rejects.select("repository_id"), "repository_id", "left_anti")
               .select("repository_id", "path", "content"))
    return entries, rejects


def archive_fingerprints(archives: DataFrame) -> DataFrame:
    return archives.select("repository_id", S.fingerprint(F.col("content")).alias("archive_sha256"),
                           F.octet_length("content").alias("archive_bytes"))


def file_inventory(entries: DataFrame) -> DataFrame:
    """Files, folders and extracted bytes per archive; folder entries have null content."""
    path = F.regexp_replace("path", "/+$", "")
    is_file = ~F.col("path").endswith("/")
    facts = entries.select("repository_id", is_file.alias("is_file"),
                           F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes"), path.alias("path"))
    totals = facts.groupBy("repository_id").agg(
        F.count_if("is_file").alias("total_files"), F.sum("bytes").alias("extracted_size_bytes"))
    below = F.when(F.col("is_file"), S.folder_path(F.col("path"))).otherwise(F.col("path"))
    folders = (facts.select("repository_id", below.alias("folder")).distinct()
               .select("repository_id", F.explode(S.ancestor_folders(F.col("folder"))).alias("folder"))
               .where("folder <> ''").distinct()
               .groupBy("repository_id").agg(F.count(F.lit(1)).alias("total_folders")))
    return (totals.join(folders, "repository_id", "left")
            .withColumn("total_folders", F.coalesce("total_folders", F.lit(0))))
