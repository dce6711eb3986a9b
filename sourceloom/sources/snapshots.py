"""Snapshot tables: write, replace, load, and merge into the next graph snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_KEYS = ("repository_id", "analysis_run_id")
NODE_KEYS = ("repository_id", "entity_key")
EDGE_KEYS = ("repository_id", "src", "relationship_type", "dst")
NODE_REFRESHED = ("node_id", "name", "label", "file_path", "language", "analysis_run_id",
                  "dependency_id", "synced_at")
EDGE_REFRESHED = ("weight", "depth", "analysis_run_id", "synced_at")


def write_snapshot(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Append every entity table of a run below ``root``, partitioned by repository and run."""
    for name, table in tables.items():
        (table.withColumn("analysis_run_id", F.lit(run_id))
         .write.mode("append").partitionBy(*RUN_KEYS).parquet(f"{root}/{name}"))


def load_snapshot(spark: SparkSession, root: str, name: str, schema, run_id: str,
                  repository_id: str | None = None) -> DataFrame:
    """One run's table; both filters prune partitions."""
    table = spark.read.schema(schema).parquet(f"{root}/{name}").where(F.col("analysis_run_id") == run_id)
    return table if repository_id is None else table.where(F.col("repository_id") == repository_id)


def replace_build(table: DataFrame, path: str) -> None:
    """Write a build again: only the (repository, run) partitions present in ``table`` are replaced."""
    (table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*RUN_KEYS).parquet(path))


def append_activity(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def _merge(target: DataFrame, batch: DataFrame, keys, refreshed) -> DataFrame:
    """Full outer merge: new rows whole, matched rows with only ``refreshed`` columns overwritten."""
    old = target.withColumn("_old", F.lit(True)).alias("o")
    new = batch.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, list(keys), "full_outer")
    has_old, has_new = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    values = []
    for column in target.columns:
        if column in keys:
            values.append(F.col(column))
        elif column in refreshed:
            values.append(F.when(has_new, F.col(f"n.{column}")).otherwise(F.col(f"o.{column}")).alias(column))
        else:
            values.append(F.when(has_old, F.col(f"o.{column}")).otherwise(F.col(f"n.{column}")).alias(column))
    return joined.select(*values)


def upsert_nodes(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Next node snapshot: merge on (repository, entity key)."""
    return _merge(target, batch, NODE_KEYS, NODE_REFRESHED)


def upsert_edges(target: DataFrame, batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """Next edge snapshot: batch edges need both endpoints; merge on (source, type, target)."""
    keys = nodes.select("repository_id", "entity_key").distinct()
    anchored = (batch
                .join(keys.withColumnRenamed("entity_key", "src"), ["repository_id", "src"], "left_semi")
                .join(keys.withColumnRenamed("entity_key", "dst"), ["repository_id", "dst"], "left_semi"))
    return _merge(target, anchored, EDGE_KEYS, EDGE_REFRESHED)


def prune_stale(nodes: DataFrame, edges: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop nodes of superseded runs with their edges.

    ``current`` has (repository_id, current_run). Repositories not listed are left alone. Returns
    (nodes, edges, summary) with pruned counts and the sync status per listed repository.
    """
    marked = nodes.join(current, "repository_id", "left")
    stale = F.col("current_run").isNotNull() & ~F.col("analysis_run_id").eqNullSafe(F.col("current_run"))
    kept = marked.where(~stale).drop("current_run")
    gone = marked.where(stale).select("repository_id", "entity_key")
    kept_edges = edges
    for end in ("src", "dst"):
        kept_edges = kept_edges.join(gone.withColumnRenamed("entity_key", end), ["repository_id", end], "left_anti")
    summary = (marked.where("current_run is not null").groupBy("repository_id")
               .agg(F.count_if(stale).alias("nodes_pruned"))
               .withColumn("status", F.when(F.col("nodes_pruned") > 0, "completed_stale").otherwise("completed")))
    return kept, kept_edges.select(*edges.columns), summary
