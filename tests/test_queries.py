"""Every registered query against its SQL at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle_tool import TABLES, compare

FOLDER = entry.SMOKE_FOLDER
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(FOLDER).exists():
        pytest.skip("driver tables are not here")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    verdict, _, _, _, detail = compare(spark, duck, name, QUERIES[name], CHECKS.get(name), FOLDER)
    assert verdict in ("match", "rows only"), detail


def test_entry(spark):
    assert entry.entry(spark).count() > 0
