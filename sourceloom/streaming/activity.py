"""Activity stream counts and incremental graph sync with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourceloom.sources.snapshots import upsert_nodes


def activity_counts(stream: DataFrame, time_column: str = "ts", window: str = "1 day", lateness: str = "1 day",
                    keys: tuple[str, ...] = ("action",)) -> DataFrame:
    """Tumbling-window counts per key; state older than the watermark is dropped."""
    timed = stream.withColumn("_ts", F.col(time_column).cast("timestamp")).withWatermark("_ts", lateness)
    return (timed.groupBy(F.window("_ts", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").alias("window_start"), *keys, "events"))


def run_to_table(counts: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drain what is available into a Parquet table; ``complete`` rewrites it per batch."""
    writer = counts.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").start(path)
    return writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()


def sync_nodes_stream(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Merge node batches into numbered snapshots below ``root``; batch n reads snapshot n-1.

    A replayed batch overwrites its own snapshot, so restarts are idempotent.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = (spark.read.schema(batch.schema).parquet(f"{root}/snapshot={batch_id - 1}") if batch_id
                  else batch.limit(0))
        upsert_nodes(target.select(*batch.columns), batch).write.mode("overwrite").parquet(f"{root}/snapshot={batch_id}")

    return (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(merge).start())
