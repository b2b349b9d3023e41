"""Run queries against their SQL on the same tables: python -m tests.differential [folder] [name...]."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter


def canonical(rows, columns) -> Counter:
    """Rows as a multiset, columns sorted by name, floats to nine digits."""

    def value(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, float):
            return "nan" if math.isnan(v) else float(f"{v:.9g}")
        if isinstance(v, (list, tuple)):
            return tuple(value(x) for x in v)
        if isinstance(v, datetime.datetime):
            return v.isoformat()
        if hasattr(v, "is_finite"):
            return float(v)
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def compare(spark, con, folder: str, query, sql: str) -> tuple[int, int, list, list]:
    """Row counts of both sides and up to three rows that only one side has."""
    df = query(spark, folder)
    ours = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    theirs = canonical(cur.fetchall(), [c[0] for c in cur.description])
    assert sorted(df.columns) == sorted(c[0] for c in cur.description), (df.columns, [c[0] for c in cur.description])
    return sum(ours.values()), sum(theirs.values()), list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    folder = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(folder), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            if name in sql:
                a, b, x, y = compare(spark, con, folder, queries[name], sql[name])
                ok = not x and not y
                print(f"{'ok  ' if ok else 'DIFF'} {name}: {a} rows, {b} by SQL, {time.time() - began:.1f} s", "" if ok else f"\n  only Spark: {x}\n  only SQL:   {y}", flush=True)
            else:
                ok = True
                print(f"rows {name}: {queries[name](spark, folder).count()}, {time.time() - began:.1f} s", flush=True)
        except Exception as e:  # noqa: BLE001
            ok = False
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
        bad += not ok
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
