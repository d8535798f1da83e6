"""Runs registered queries beside their SQL: python tests/oracle.py [sf_dir] [name...]"""

import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connection(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        name = f.removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def difference(spark, con, sf_dir, f, sql):
    """Empty if both give the same columns and rows."""
    df = f(spark, sf_dir)
    con.execute(sql)
    names = [d[0] for d in con.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in con.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    if got == want:
        return ""
    a, b = [r for r in got if r not in set(want)][:3] if len(want) < 20000 else [], [r for r in want if r not in set(got)][:3] if len(got) < 20000 else []
    return f"{len(got)} and {len(want)} rows; only ours {a}; only SQL {b}"


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connection(sf_dir), e.oracle_sql()
    for name, f in e.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            if name in sql:
                said = difference(spark, con, sf_dir, f, sql[name]) or "same"
            else:
                said = f"no SQL, {f(spark, sf_dir).count()} rows"
        except Exception as x:
            said = f"FAILED {type(x).__name__}: {str(x)[:600]}"
        print(f"{name}: {said[:900]} ({time.time() - t:.1f} s)", flush=True)
