"""Run registered queries against their SQL in DuckDB and compare rows.

Usage: python tests/oracle_tool.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sourceloom.plans.workload.adapters import TABLES  # noqa: E402


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    number = float(value)
    return None if math.isnan(number) else round(number, 9)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((repr([_plain(row[i]) for i in order]) for row in rows))


def compare(spark, connection, name, query, sql, folder):
    started = time.time()
    frame = query(spark, folder)
    got = normalized(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - started
    if sql is None:
        return "rows only", len(got[1]), spent, 0.0, ""
    started = time.time()
    cursor = connection.execute(sql)
    want = normalized([d[0] for d in cursor.description], cursor.fetchall())
    check = time.time() - started
    if got == want:
        return "match", len(got[1]), spent, check, ""
    detail = f"columns {got[0]} vs {want[0]}; rows {len(got[1])} vs {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            detail += f"\n   spark {a[:300]}\n   duck  {b[:300]}"
            break
    return "DIFFERS", len(got[1]), spent, check, detail


def main(arguments):
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = "sf0.01"
    if "--sf" in arguments:
        at = arguments.index("--sf")
        sf = arguments[at + 1]
        del arguments[at:at + 2]
    folder = f"/root/testdata/{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    queries, checks = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not arguments or any(q == a or (a.endswith("*") and q.startswith(a[:-1])) for a in arguments)]
    bad = 0
    for name in wanted:
        try:
            verdict, rows, spent, check, detail = compare(spark, connection, name, queries[name], checks.get(name), folder)
        except Exception as problem:
            verdict, rows, spent, check, detail = "ERROR", 0, 0.0, 0.0, str(problem)[:1200]
        bad += verdict in ("DIFFERS", "ERROR")
        print(f"{verdict:10} {name:32} rows={rows:<8} spark={spent:6.2f}s check={check:6.2f}s {detail}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
