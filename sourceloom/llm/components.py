"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.session import cut_observed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star operation: every node hands its larger (or its smaller and equal) neighbours to the smallest one."""
    if large:
        around = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    told = around.join(least, "a")
    if large:
        out = told.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = told.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; ``links`` has columns a, b; the component is its smallest node.

    Large and small stars alternate until the links no longer change; every round is checkpointed and its links counted and
    fingerprinted by the job that writes them. A hot centre is aggregated before its shuffle and joined with skew splitting.
    """
    def marks() -> dict:
        return {"rows": F.count(F.lit(1)), "mark": F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))}

    current, seen = cut_observed(links.where("a <> b").select(F.col("a"), F.col("b")), **marks())
    while True:
        current, now = cut_observed(_star(_star(current, True), False), **marks())
        if now == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
