"""Run queries beside their SQL in DuckDB and compare the rows: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def compare(spark, sf_dir: str, run, sql: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    want = db.sql(sql)
    got = run(spark, sf_dir)
    if sorted(want.columns) != sorted(got.columns):
        return f"columns {got.columns} for {want.columns}"
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    if a != b:
        return f"{len(a)} rows for {len(b)}; e.g. {list(set(a) - set(b))[:3]} for {list(set(b) - set(a))[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    runs, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or oracles:
        start = time.time()
        try:
            said = compare(session, sys.argv[1], runs[name], oracles[name])
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said or 'equal'} ({time.time() - start:.1f} s)", flush=True)
