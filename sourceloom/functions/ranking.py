"""Ranking and running totals that stay parallel when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceloom.session import BROADCAST_ROWS, stored, stored_observed


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank_column: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    For k up to 1000 Spark trims every input partition to k rows per group before the shuffle
    (WindowGroupLimit), so a group never lands in one task whole.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_column, F.row_number().over(window)).where(F.col(rank_column) <= k)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per group, as a map-side combined aggregate."""
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_first"))
            .select(*keys, "_first.*"))


def _repeated(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """``df`` with a hash of its keys, the hashes that come more than once, and their number. Rows whose hash comes once have a key of their own."""
    marked = df.withColumn("_key", F.xxhash64(*keys))
    counted = marked.select("_key").repartition("_key").groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    hashes, measured = stored_observed(counted.where("n > 1").select("_key"), "repeated", rows=F.count(F.lit(1)))
    return marked, hashes, int(measured["rows"])


def first_of_repeated(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """``first_per_group`` for keys most of which come once: only rows that share the hash of their key are dealt out and compared.

    Hashes are counted by a job of their own, so ``df`` should be cheap to make twice. Many repeated keys go through a shuffle of all rows.
    """
    marked, hashes, rows = _repeated(df, keys)
    if rows > BROADCAST_ROWS:
        return first_per_group(df.repartition(*keys), keys, order, columns)
    if rows == 0:
        return df.select(*keys, *columns)
    once = marked.join(F.broadcast(hashes), "_key", "left_anti").select(*keys, *columns)
    again = marked.join(F.broadcast(hashes), "_key", "left_semi").drop("_key")
    return once.unionByName(first_per_group(again, keys, order, columns))


def distinct_of_repeated(df: DataFrame) -> DataFrame:
    """``df.distinct()`` for rows most of which come once: see ``first_of_repeated``."""
    marked, hashes, rows = _repeated(df, df.columns)
    if rows > BROADCAST_ROWS:
        return df.distinct()
    if rows == 0:
        return df
    once = marked.join(F.broadcast(hashes), "_key", "left_anti").drop("_key")
    return once.unionByName(marked.join(F.broadcast(hashes), "_key", "left_semi").drop("_key").distinct())


def running_totals(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                   measures: dict[str, Column]) -> DataFrame:
    """Cumulative sums of ``measures`` per group in ``order``.

    ``bucket`` must be monotone in ``order`` (a day for time-ordered rows). Buckets are totalled
    first, the totals are accumulated over the small bucket table, and only rows of one bucket
    meet in one task; a group holding most of the data is spread over its buckets.
    """
    staged = df.withColumn("_bucket", bucket)
    for name, measure in measures.items():
        staged = staged.withColumn(f"_m_{name}", measure)
    totals = staged.groupBy(*keys, "_bucket").agg(
        *[F.sum(f"_m_{name}").alias(f"_t_{name}") for name in measures])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in measures])
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = staged.join(offsets, [*keys, "_bucket"])
    for name in measures:
        joined = joined.withColumn(name, F.col(f"_o_{name}") + F.sum(f"_m_{name}").over(inside))
    return joined.drop("_bucket", *[f"_{p}_{n}" for n in measures for p in ("m", "o")])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with the row number (from 1) of each row in its group by ``order``, however many rows a group has.

    Rows are sorted over range partitions, written, counted by group and partition, and numbered from there; no group
    has to fit a task. Rows that tie in ``order`` are numbered in any order.
    """
    at, part = "_ranked_at", "_ranked_part"
    sorted_ = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    sorted_ = stored(sorted_.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "ranked")
    counts = sorted_.groupBy(*[F.col(k).alias(f"_ranked_{i}") for i, k in enumerate(keys)], F.col(part).alias("_ranked_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    before = W.partitionBy(*[f"_ranked_{i}" for i in range(len(keys))]).orderBy("_ranked_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_ranked_{i}")) for i, k in enumerate(keys)]
    met = sorted_.join(offsets, [*same, F.col(part) == F.col("_ranked_p")] if keys else F.col(part) == F.col("_ranked_p"))
    return met.select(*df.columns, (F.col(at) - F.col("_first") + F.col("_before") + 1).alias(name))


def share_below(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact share of the group's rows with a strictly smaller ``value``, as column ``share_below``.

    The distribution is counted per distinct value first, so the ordered window sees one row per
    distinct value instead of one per input row.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    below = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    shares = counted.select(*keys, value, (
        F.coalesce(F.sum("_n").over(below), F.lit(0)) / F.sum("_n").over(whole)).alias("share_below"))
    return df.join(shares, [*keys, value])
