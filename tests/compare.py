"""Run queries against their SQL on one scale: python tests/compare.py [sf] [name ...]"""

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, float):
        return (1, v + 0.0)
    return (2 if isinstance(v, str) else 1, v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf):
    """None when equal, else a message."""
    df = entry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(rows), df.dtypes
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    left, a = normal(df.columns, rows)
    right, b = normal(names, result.fetchall())
    if left != right:
        return f"columns {left} != {right}", len(rows), df.dtypes
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(rows), df.dtypes
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, e.g. {wrong[:2]}", len(rows), df.dtypes
    want = {"double": "DOUBLE", "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR"}
    odd = [(c, t, kinds[c]) for c, t in df.dtypes if want.get(t, kinds[c]) != kinds[c]]
    return (f"types {odd}" if odd else None), len(rows), df.dtypes


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in sys.argv[2:] or list(entry.queries()):
        start = time.time()
        try:
            message, n, _ = compare(spark, con, name, sf)
        except Exception as error:  # report and go on
            message, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += message is not None
        kind = "sql " if name in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if message is None else 'FAIL'} {kind} {name} n={n} {time.time() - start:.1f}s {message or ''}", flush=True)
    print("failures:", bad)
