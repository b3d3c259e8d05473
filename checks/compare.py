"""Run registered queries with both engines and report differences.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return db


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark_df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if columns and rows (in any order) agree, else what differs."""
    found = db.execute(sql)
    columns = [column[0] for column in found.description]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(columns)}"
    expected = rows_of(columns, found.fetchall())
    actual = rows_of(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    if actual == expected:
        return None
    only_spark = [row for row in actual if row not in expected][:3]
    only_sql = [row for row in expected if row not in actual][:3]
    return f"{len(actual)} / {len(expected)} rows, {only_spark} / {only_sql}"


def main() -> int:
    from checks import oracle, registry
    from dayzero import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("compare", "local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    sqls = oracle.oracle_sql()
    failed = 0
    for name, build in registry.queries().items():
        if names and name not in names:
            continue
        start = time.perf_counter()
        try:
            df = build(spark, sf_dir)
            problem = difference(df, db, sqls[name])
            n_rows = len(db.execute(sqls[name]).fetchall())
        except Exception as error:  # report and go on with the next query
            problem, n_rows = f"{type(error).__name__}: {str(error)[:400]}", -1
        failed += problem is not None
        took = time.perf_counter() - start
        print(f"{name:36} {took:6.2f}s {n_rows:6d} rows  {problem or 'ok'}", flush=True)
    print(f"{failed} differ")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
