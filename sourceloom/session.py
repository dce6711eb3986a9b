"""Session settings, lineage cuts and stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A counted side of at most this many short rows may be broadcast (a few MB).
BROADCAST_ROWS = 100_000

#: Bytes of a row group in tables split by types, whose writers are open at once and hold one group each.
SPLIT_ROW_GROUP = 16 * 1024 * 1024

_RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Archives and files reach Python in batches bounded by bytes, whatever their number.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
    # Tables split by a few types are written to that many files at once instead of being sorted by type first.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    # Steps are written as tables or checkpoints and read from there, so what a job shuffled goes as the job ends.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on and make sure lineage can be cut."""
    for key, value in _RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    checkpoint_folder(spark)
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, wherever the session was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sourceloom-")) / "sourceloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own, or a temporary one in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="sourceloom-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably so later steps do not replay its plan."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def cut_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Checkpoint ``df`` and return it with aggregate ``metrics`` measured by the same job."""
    checkpoint_folder(df.sparkSession)
    seen = Observation()
    kept = df.observe(seen, *[metric.alias(name) for name, metric in metrics.items()]).checkpoint()
    return kept, dict(seen.get)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpoint ``df`` and return it with its row count, both from the same job."""
    kept, measured = cut_observed(df, rows=F.count(F.lit(1)))
    return kept, int(measured["rows"])


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for a side whose counted size allows it; otherwise leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (columnar, prunable)."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("parquet.block.size", str(SPLIT_ROW_GROUP))
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    out.stored_at = path
    return out


def stored_observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``stored``, with aggregate ``metrics`` measured by the job that writes the table."""
    seen = Observation()
    out = stored(df.observe(seen, *[metric.alias(key) for key, metric in metrics.items()]), name)
    return out, dict(seen.get)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned, once nothing that is still to be computed reads them. Other frames are left alone."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def row_key(df: DataFrame, name: str) -> DataFrame | None:
    """``df`` with a struct column ``name`` that tells its rows apart however often and in whatever splits they are read: the file and
    the row's number in it. None unless ``df`` is a table of Parquet files as they are, all of its rows once."""
    try:
        place = df.metadataColumn("_metadata")
        keyed = df.select("*", F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row")).alias(name))
        files = df.select(place["file_path"].alias("path"), place["row_index"].alias("row"))
    except AnalysisException:
        return None
    counts = files.groupBy("path").agg(F.count("row").alias("n"), F.max("row").alias("last"), F.sum(F.col("row").cast("decimal(38, 0)")).alias("all"))
    sound = F.bool_and((F.col("n") == F.col("last") + 1) & (2 * F.col("all") == F.col("n").cast("decimal(19, 0)") * F.col("last")))
    found = counts.agg(sound.alias("sound"), F.count("path").alias("files"), F.count_distinct(F.xxhash64("path")).alias("names")).first()
    return keyed if found.files == found.names and found.sound is not False else None


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
