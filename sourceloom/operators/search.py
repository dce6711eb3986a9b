"""Node search: scored token search, contains search and multi-field filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.ranking import top_per_group

REPO = "repository_id"
SEARCH_FIELDS = ("name", "label", "entity_key")


def tokens_of(fields=SEARCH_FIELDS) -> Column:
    """Distinct lower-cased alphanumeric tokens of the searched fields."""
    text = F.lower(F.concat_ws(" ", *fields))
    return F.array_distinct(F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != ""))


def search_nodes(nodes: DataFrame, query: str, entity_type: str | None = None, limit: int = 50, fields=SEARCH_FIELDS) -> DataFrame:
    """Best nodes per repository: score is the summed inverse document frequency of matched query tokens.

    Token frequencies are two small aggregates over flags; the token lists themselves are never
    shuffled. The type filter applies before the cut.
    """
    words = sorted({w for w in re.split("[^a-z0-9]+", query.lower()) if w})
    if not words:
        return nodes.select(REPO, "node_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    hit = lambda w: F.array_contains("_tokens", w)
    tokenized = nodes.withColumn("_tokens", tokens_of(fields))
    stats = tokenized.groupBy(REPO).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(hit(w)).alias(f"_df{i}") for i, w in enumerate(words)])
    matched = tokenized.where(F.arrays_overlap("_tokens", F.array(*[F.lit(w) for w in words])))
    if entity_type:
        matched = matched.where(F.col("entity_type") == entity_type)
    score = sum((F.when(hit(w), F.log(1 + F.col("_n") / F.col(f"_df{i}"))).otherwise(0.0) for i, w in enumerate(words)), F.lit(0.0))
    scored = matched.join(stats, REPO).select(REPO, "node_id", F.round(score, 6).alias("score"))
    return top_per_group(scored, [REPO], [F.desc("score"), F.col("node_id")], limit)


def search_nodes_contains(nodes: DataFrame, query: str, entity_type: str | None = None, limit: int = 50, fields=SEARCH_FIELDS) -> DataFrame:
    """Case-insensitive contains on any field, first ``limit`` per repository in id order."""
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.contains(F.lower(field), F.lit(query.lower()))
    kept = nodes.where(hit)
    if entity_type:
        kept = kept.where(F.col("entity_type") == entity_type)
    return top_per_group(kept.select(REPO, "node_id", "entity_type"), [REPO], [F.col("node_id")], limit)


def multi_field_search(table: DataFrame, term: str, *fields: str) -> DataFrame:
    """Rows whose joined fields (array fields included) contain the term, ignoring case."""
    return table.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(term.lower())))
