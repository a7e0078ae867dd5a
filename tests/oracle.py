"""Run registered queries beside their SQL checks and compare the results as multisets.

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str:
    """'' when both sides agree, else what differs."""
    rows = df.collect()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    odd = {c: k for c, k in kinds.items() if "DECIMAL" in k or "HUGEINT" in k or "DATE" in k or "TIMESTAMP" in k}
    if odd:
        return f"SQL types to cast: {odd}"
    ours, theirs = multiset(df.columns, rows), multiset(names, cursor.fetchall())
    if ours == theirs:
        return "" if rows else "no rows"
    return (f"{sum(ours.values())} / {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; "
            f"only SQL {list((theirs - ours).items())[:3]}")


def main(argv):
    import __spark_entry__ as entry
    spark, con = session(), duck(argv[0])
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        begin = time.time()
        try:
            if name in sql:
                verdict = compare(queries[name](spark, argv[0]), con, sql[name])
            else:
                verdict = "" if queries[name](spark, argv[0]).count() else "no rows"
        except Exception as exc:
            verdict = f"{type(exc).__name__}: {str(exc)[:400]}"
        bad += bool(verdict)
        mark = "ok " if not verdict else "BAD"
        print(f"{mark} {name} {'' if name in sql else '(rows only) '}{time.time() - begin:.1f}s {verdict}", flush=True)
    print(f"{len(argv[1:] or queries)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
