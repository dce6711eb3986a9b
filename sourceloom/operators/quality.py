"""Constraints as set-based checks: each returns the offending rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_unique(table: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def check_domain(table: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is missing or outside the allowed set."""
    return table.where(F.col(column).isNull() | ~F.col(column).isin(*values))


def check_foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows that point to no parent."""
    keys = parent.select(F.col(key).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def cascade(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows that survive when rows without a parent are deleted with it."""
    return child.join(parent.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def unique_name(table: DataFrame, group: str = "project_id", name: str = "name") -> DataFrame:
    """Names used more than once in a group, ignoring case."""
    return (table.groupBy(group, F.lower(name).alias("name_key")).agg(F.count(F.lit(1)).alias("occurrences"))
            .where("occurrences > 1"))


def violation_summary(checks: dict[str, DataFrame]) -> DataFrame:
    """(check_name, violations) over several checks, each reduced to one row where it runs."""
    return reduce(DataFrame.unionByName, [
        rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        for name, rows in checks.items()])
