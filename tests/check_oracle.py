"""Run queries against DuckDB: ``python tests/check_oracle.py [sf_dir] [names...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(lines, key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str) -> str:
    got = fn(spark, sf_dir)
    left = rows_of(got.columns, got.collect())
    want = con.execute(sql)
    right = rows_of([c[0] for c in want.description], want.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        a, b = set(left[1]), set(right[1])
        return (
            f"{len(left[1])} vs {len(right[1])} rows; only here {sorted(a - b, key=repr)[:3]}; "
            f"only there {sorted(b - a, key=repr)[:3]}"
        )
    return "" if left[1] else "empty"


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, queries()[name], sqls[name])
            else:
                problem = "" if queries()[name](spark, sf_dir).count() else "empty"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
