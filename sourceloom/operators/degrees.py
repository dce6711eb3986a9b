"""Degree tables and the graph statistics built on them, per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.functions import scalars as S
from sourceloom.functions.ranking import top_per_group

REPO = "repository_id"


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree of every node, zero degrees kept.

    Edge ends are counted by a map-side combined hash aggregate, so a hub arrives as one partial row
    per input partition; the counts are then already partitioned for the join with the nodes.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ends = F.array(F.struct(F.col("src").alias("node_id"), zero.alias("i"), one.alias("o")),
                   F.struct(F.col("dst").alias("node_id"), one.alias("i"), zero.alias("o")))
    counts = (edges.select(F.explode(ends).alias("e")).groupBy(F.col("e.node_id").alias("node_id"))
              .agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree")))
    return (nodes.select("node_id", REPO, "entity_type").join(counts, "node_id", "left")
            .na.fill(0, ["in_degree", "out_degree"])
            .withColumn("total_degree", F.col("in_degree") + F.col("out_degree")))


def most_referenced(degree_table: DataFrame, entity_types: tuple[str, ...] = ("file", "function")) -> DataFrame:
    """The node with most incoming edges per entity type; ties go to the smallest id."""
    return (degree_table.where(F.col("entity_type").isin(*entity_types) & (F.col("in_degree") > 0))
            .groupBy(REPO, "entity_type").agg(
                F.min_by("node_id", F.struct(-F.col("in_degree"), F.col("node_id"))).alias("node_id"),
                F.max("in_degree").alias("in_degree")))


def density(edge_count: Column, node_count: Column) -> Column:
    return F.when(node_count > 1, F.round(edge_count / (node_count * (node_count - 1)), 6)).otherwise(F.lit(0.0))


def dependency_metrics(degree_table: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """Counts, fan-in/out, density and most referenced file and function, one row per repository."""
    def best(kind: str) -> Column:
        eligible = (F.col("entity_type") == kind) & (F.col("in_degree") > 0)
        order = F.when(eligible, F.struct(-F.col("in_degree"), F.col("node_id")))
        return F.min_by(F.when(eligible, F.col("node_id")), order).alias(f"most_referenced_{kind}")

    table = degree_table.groupBy(REPO).agg(
        F.count(F.lit(1)).alias("total_nodes"), F.sum("out_degree").alias("total_edges"),
        F.sum("in_degree").alias("incoming_dependency_count"),
        F.sum("out_degree").alias("outgoing_dependency_count"),
        F.max("in_degree").alias("fan_in"), F.max("out_degree").alias("fan_out"), best("file"), best("function"))
    table = table.withColumn("dependency_density", density(F.col("total_edges"), F.col("total_nodes")))
    return table if depth is None else table.join(depth, REPO, "left").withColumn(
        "dependency_depth", F.coalesce("dependency_depth", F.lit(0)))


def node_distribution(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(REPO, "entity_type").agg(F.count(F.lit(1)).alias("node_count"))


def relationship_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy(REPO, "relationship_type").agg(F.count(F.lit(1)).alias("edge_count"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct nodes and edges that stay inside the repository."""
    owner = nodes.select("node_id", REPO).distinct()
    inside = (edges.select("src", "dst")
              .join(owner.select(F.col("node_id").alias("src"), REPO), "src")
              .join(owner.select(F.col("node_id").alias("dst"), REPO), ["dst", REPO], "left_semi")
              .groupBy(REPO).agg(F.count(F.lit(1)).alias("total_edges")))
    total = owner.groupBy(REPO).agg(F.count(F.lit(1)).alias("total_nodes"))
    return total.join(inside, REPO, "left").withColumn("total_edges", F.coalesce("total_edges", F.lit(0)))


def graph_statistics(degree_table: DataFrame) -> DataFrame:
    """Average degree, most connected node and density in one aggregate."""
    table = degree_table.groupBy(REPO).agg(
        F.count(F.lit(1)).alias("total_nodes"), F.sum("out_degree").alias("total_relationships"),
        F.sum("total_degree").alias("_ends"),
        F.min_by("node_id", F.struct(-F.col("total_degree"), F.col("node_id"))).alias("most_connected_node"),
        F.max("total_degree").alias("most_connected_degree"))
    return (table.withColumn("average_degree", F.round(F.col("_ends") / F.col("total_nodes"), 6))
            .withColumn("graph_density", density(F.col("total_relationships"), F.col("total_nodes"))).drop("_ends"))


def type_statistics(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = (
        "function", "class", "module", "file", "package")) -> DataFrame:
    """Nodes of each listed type and edges per node with one decimal."""
    counted = nodes.groupBy(REPO).agg(
        F.count(F.lit(1)).alias("nodes"), *[F.count_if(F.col("entity_type") == t).alias(f"{t}_count") for t in types])
    links = edges.groupBy(REPO).agg(F.count(F.lit(1)).alias("edges"))
    joined = counted.join(links, REPO, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return joined.withColumn("avg_connections", F.round(F.col("edges") / F.col("nodes"), 1))


def hotspots(degree_table: DataFrame, k: int = 10) -> DataFrame:
    return top_per_group(degree_table, [REPO], [F.desc("total_degree"), F.col("node_id")], k)


def most_targeted(edges: DataFrame, edge_type: str, k: int = 5) -> DataFrame:
    """Nodes with most incoming edges of one type, e.g. IMPORTS or CALLS."""
    counted = (edges.where(S.edge_type(F.col("relationship_type")) == edge_type)
               .groupBy(REPO, F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("edge_count")))
    return top_per_group(counted, [REPO], [F.desc("edge_count"), F.col("node_id")], k)


def node_role() -> Column:
    """orphan, entry_point, sink or inner, from the degree columns."""
    return (F.when(F.col("total_degree") == 0, "orphan")
            .when(F.col("in_degree") == 0, "entry_point")
            .when(F.col("out_degree") == 0, "sink").otherwise("inner"))


ROLE_CAPS = {"orphan": 100, "entry_point": 50, "sink": 50}


def role_counts(degree_table: DataFrame) -> DataFrame:
    """Full and capped number of orphans, entry points and sinks."""
    role = node_role()
    counts = degree_table.groupBy(REPO).agg(*[F.count_if(role == r).alias(f"{r}_total") for r in ROLE_CAPS])
    return counts.withColumns({f"{r}_count": F.least(F.col(f"{r}_total"), F.lit(cap)) for r, cap in ROLE_CAPS.items()})


def role_members(degree_table: DataFrame) -> DataFrame:
    """Every orphan, entry point and sink."""
    return degree_table.withColumn("role", node_role()).where("role <> 'inner'")


def role_report(degree_table: DataFrame) -> DataFrame:
    """The first members of each role up to its report length, in id order."""
    most = max(ROLE_CAPS.values())
    ranked = top_per_group(role_members(degree_table), [REPO, "role"], [F.col("node_id")], most)
    cap = F.element_at(F.create_map(*[F.lit(x) for pair in ROLE_CAPS.items() for x in pair]), F.col("role"))
    return ranked.where(F.col("rank") <= cap)


def graph_summary(nodes: DataFrame, edges: DataFrame, degree_table: DataFrame) -> DataFrame:
    """One record per repository: counts, hotspots, roles, most imported and most called nodes.

    The nested lists come from already cut top-k tables, so each has a fixed small length.
    """
    def listed(table: DataFrame, name: str, *columns: str) -> DataFrame:
        entry = F.struct("rank", *columns)
        return table.groupBy(REPO).agg(F.array_sort(F.collect_list(entry)).alias(name))

    roles = role_report(degree_table)
    pieces = [
        listed(hotspots(degree_table), "hotspots", "node_id", "in_degree", "out_degree", "total_degree"),
        *[listed(roles.where(F.col("role") == r), f"{r}s", "node_id") for r in ROLE_CAPS],
        listed(most_targeted(edges, "IMPORTS"), "most_imported", "node_id", "edge_count"),
        listed(most_targeted(edges, "CALLS"), "most_called", "node_id", "edge_count"),
        role_counts(degree_table),
    ]
    summary = graph_counts(nodes, edges)
    for piece in pieces:
        summary = summary.join(piece, REPO, "left")
    return summary
