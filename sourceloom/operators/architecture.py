"""Architecture inference: frameworks, layers, components, metrics, findings and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V
from sourceloom.functions.ranking import top_per_group
from sourceloom.functions.scalars import any_match

REPO = "repository_id"


def detect_frameworks(nodes: DataFrame, patterns: dict = V.FRAMEWORK_PATTERNS) -> DataFrame:
    """(repository_id, frameworks): frameworks with a pattern hit on any path, else Unknown.

    One aggregate with a boolean per framework; patterns are matched per path.
    """
    path = F.lower(F.coalesce(F.nullif("file_path", F.lit("")), "entity_key", "name"))
    hits = nodes.select(REPO, path.alias("p")).groupBy(REPO).agg(*[
        F.bool_or(any_match(F.col("p"), regexes)).alias(name.replace(".", "_")) for name, regexes in patterns.items()])
    listed = F.array_compact(F.array(*[F.when(F.col(name.replace(".", "_")), F.lit(name)) for name in patterns]))
    return hits.select(REPO, F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(V.UNKNOWN_FRAMEWORK))).alias("frameworks"))


def build_status(frameworks: DataFrame) -> DataFrame:
    """Completed, or completed with a warning when no framework was recognised."""
    unknown = F.col("frameworks") == F.array(F.lit(V.UNKNOWN_FRAMEWORK))
    return frameworks.select(
        REPO, "frameworks", F.when(unknown, "completed_with_warnings").otherwise("completed").alias("status"),
        F.when(unknown, F.lit(V.NO_FRAMEWORK_WARNING)).alias("warning"))


def haystack() -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in ("entity_type", "name", "label", "file_path", "module")]
    return F.lower(F.concat_ws(" ", *parts))


def classify(nodes: DataFrame, rules=V.LAYER_RULES) -> DataFrame:
    """Adds component_type, layer and confidence: first matching rule, else by entity type."""
    text = nodes.withColumn("_text", haystack())
    verdict = F.struct(F.col("entity_type").alias("t"), F.lit(V.OTHER_FALLBACK[0]).alias("l"), F.lit(V.OTHER_FALLBACK[1]).alias("c"))
    for kind, (layer, confidence) in V.FALLBACK_LAYERS.items():
        verdict = F.when(F.col("entity_type") == kind, F.struct(
            F.lit(kind).alias("t"), F.lit(layer).alias("l"), F.lit(confidence).alias("c"))).otherwise(verdict)
    for kind, layer, patterns in reversed(rules):
        verdict = F.when(any_match(F.col("_text"), patterns), F.struct(
            F.lit(kind).alias("t"), F.lit(layer).alias("l"), F.lit(V.RULE_CONFIDENCE).alias("c"))).otherwise(verdict)
    return (text.withColumn("_v", verdict).withColumn("component_type", F.col("_v.t"))
            .withColumn("layer", F.col("_v.l")).withColumn("confidence", F.col("_v.c")).drop("_text", "_v"))


def detect_components(nodes: DataFrame, frameworks: DataFrame | None = None, rules=V.LAYER_RULES) -> DataFrame:
    """Components of the eligible entity types; unmatched classes and functions are judged by name."""
    ruled = classify(nodes.where(F.col("entity_type").isin(*V.COMPONENT_ENTITY_TYPES)), rules)
    name = F.lower("name")
    open_kind = F.col("entity_type").isin("class", "function") & F.col("component_type").isin("class", "function")
    by_name = (F.when(name.contains("service"), "service")
               .when(name.contains("repository") | name.endswith("repo"), "repository")
               .when(name.contains("controller") | name.contains("handler"), "controller"))
    renamed = ruled.withColumn("_n", F.when(open_kind, by_name))
    parts = renamed.select(
        REPO, "node_id", "entity_type", F.coalesce(F.nullif("label", F.lit("")), "name").alias("name"),
        F.coalesce("_n", "component_type").alias("component_type"), F.coalesce("_n", "layer").alias("layer"),
        F.col("file_path").alias("path"),
        F.when(F.col("_n").isNotNull(), V.NAME_RULE_CONFIDENCE).otherwise(F.col("confidence")).alias("confidence"))
    if frameworks is None:
        return parts
    first = F.filter("frameworks", lambda f: f != V.UNKNOWN_FRAMEWORK)
    return parts.join(frameworks.select(REPO, F.try_element_at(first, F.lit(1)).alias("framework")), REPO, "left")


def component_links(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between two components with both layers and names."""
    def side(end: str) -> DataFrame:
        return components.select(F.col("node_id").alias(end), F.col("layer").alias(f"{end}_layer"), F.col("name").alias(f"{end}_name"))

    return (edges.select("src", "dst", "relationship_type").join(side("src"), "src").join(
        components.select(REPO, F.col("node_id").alias("dst"), F.col("layer").alias("dst_layer"), F.col("name").alias("dst_name")), "dst"))


def layer_metrics(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Coupling, cohesion, complexity and health per repository with counts by type and layer."""
    crossing = F.col("src_layer") != F.col("dst_layer")
    links = component_links(components, edges).groupBy(REPO).agg(
        F.count_if(crossing).alias("cross_layer_edges"), F.count_if(~crossing).alias("internal_edges"))
    is_type = lambda t: F.count_if(F.col("component_type") == t)
    counts = components.groupBy(REPO).agg(
        F.count(F.lit(1)).alias("component_count"), F.count_distinct("layer").alias("layer_count"),
        is_type("service").alias("service_count"), is_type("controller").alias("controller_count"),
        is_type("repository").alias("repository_count"), F.count_if(F.col("layer") == "api").alias("api_count"),
        F.count_if(F.col("layer") == "data").alias("database_count"))
    joined = counts.join(links, REPO, "left").na.fill(0, ["cross_layer_edges", "internal_edges"])
    considered = F.col("cross_layer_edges") + F.col("internal_edges")
    joined = (joined
              .withColumn("layer_coupling", F.when(considered > 0, F.round(F.col("cross_layer_edges") / considered, 3)).otherwise(0.0))
              .withColumn("layer_cohesion", F.when(considered > 0, F.round(F.col("internal_edges") / considered, 3)).otherwise(1.0)))
    complexity = F.round(F.col("layer_count") * 2 + F.col("layer_coupling") * 30 + F.col("component_count") / 25, 2)
    joined = joined.withColumn("architecture_complexity", complexity)
    raw = 100 - F.col("layer_coupling") * 35 - F.greatest(F.lit(0.0), F.col("architecture_complexity") - 20)
    return joined.withColumn("health_score", F.greatest(F.lit(0), F.least(F.lit(100), raw.cast("int"))))


def _finding(table: DataFrame, pattern: str, severity: str, title: Column | None = None, count: Column | None = None) -> DataFrame:
    return table.select(REPO, F.lit(pattern).alias("pattern_type"), F.lit(severity).alias("severity"),
                        (F.lit(V.FINDING_TITLES[pattern]) if title is None else title).alias("title"),
                        (F.lit(0) if count is None else count).cast("long").alias("evidence_count"))


def illegal_access(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from an entry layer straight to the data layer."""
    return component_links(components, edges).where(F.col("src_layer").isin(*V.ENTRY_LAYERS) & (F.col("dst_layer") == "data"))


def illegal_access_evidence(illegal: DataFrame, most: int = 10) -> DataFrame:
    return top_per_group(illegal.select(REPO, F.col("src_name").alias("source"), F.col("dst_name").alias("target"), "relationship_type"),
                         [REPO], [F.col("source"), F.col("target"), F.col("relationship_type")], most)


def large_layers(components: DataFrame, above: int = 50) -> DataFrame:
    return components.groupBy(REPO, "layer").agg(F.count(F.lit(1)).alias("components")).where(F.col("components") > above)


def anti_patterns(components: DataFrame, edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """All findings with severity, title and number of pieces of evidence."""
    direct = illegal_access(components, edges).groupBy(REPO).agg(F.count(F.lit(1)).alias("n"))
    large_title = F.concat(F.lit("Large "), F.col("layer"), F.lit(" layer"))
    parts = [
        _finding(direct, "direct_database_access", "high", count=F.col("n")),
        _finding(metrics.where("repository_count = 0 and database_count > 0"), "missing_repository_pattern", "medium"),
        _finding(metrics.where("layer_coupling > 0.65"), "high_coupling", "high", count=F.lit(1)),
        _finding(large_layers(components), "large_layer", "medium", large_title, F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, parts)


def architecture_health(metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """Health score after penalties, risk band and the reasons."""
    penalty = F.coalesce(F.try_element_at(F.create_map(*[
        F.lit(x) for pair in V.SEVERITY_PENALTIES.items() for x in pair]), F.col("severity")), F.lit(V.OTHER_PENALTY))
    summed = findings.groupBy(REPO).agg(F.sum(penalty).alias("penalty"), F.array_sort(F.collect_set("title")).alias("reasons"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("health_score") - F.coalesce("penalty", F.lit(0))))
    risk = (F.when(F.col("score") >= 85, "low").when(F.col("score") >= 65, "medium")
            .when(F.col("score") >= 40, "high").otherwise("critical"))
    return (metrics.select(REPO, "health_score").join(summed, REPO, "left").withColumn("score", score.cast("int")).select(
        REPO, "score", risk.alias("risk"), F.coalesce("reasons", F.array(F.lit(V.HEALTHY_REASON))).alias("reasons")))


def list_components(components: DataFrame, layer: str | None = None, component_type: str | None = None) -> DataFrame:
    """Components in (layer, name) order, optionally of one layer or type."""
    kept = components
    if layer:
        kept = kept.where(F.col("layer") == layer)
    if component_type:
        kept = kept.where(F.col("component_type") == component_type)
    return kept.orderBy("layer", "name", "node_id")


def component_counts(components: DataFrame) -> DataFrame:
    return components.groupBy(REPO, "layer", "component_type").agg(F.count(F.lit(1)).alias("components"))


def routes(components: DataFrame) -> DataFrame:
    """API-layer components followed by controllers; a component that is both appears twice."""
    return components.where("layer = 'api'").union(components.where("component_type = 'controller'"))


def list_anti_patterns(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("severity"), "pattern_type", "title")
