"""Run registered queries beside their SQL on DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, key, query, sql, sf_dir, con):
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} against {sorted(cols)}", len(got)
    types = dict(con.execute(f"DESCRIBE {sql}").fetchall() and [
        (r[0], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()])
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    bad = [(c, t, types[c]) for c, t in df.dtypes if pairs.get(t, "") != types[c]]
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"rows {len(a)} against {len(b)}; first difference {diff}", len(got)
    if bad:
        return f"types {bad}", len(got)
    if not got:
        return "empty", 0
    return "", len(got)


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def session(cores="8"):
    from pyspark.sql import SparkSession
    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for key, fn in qs.items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if key in sqls:
                msg, n = compare(spark, key, fn, sqls[key], sf_dir, con)
            else:
                n = len(fn(spark, sf_dir).collect())
                msg = ""
        except Exception as ex:  # show every failure of a run, not only the first
            msg, n = f"{type(ex).__name__}: {str(ex)[:600]}", -1
        bad += bool(msg)
        print(f"{'ok  ' if not msg else 'BAD '} {key:28s} {n:8d} rows {time.time() - t:6.2f}s "
              f"{'' if key in sqls else '(rows only) '}{msg[:700]}", flush=True)
    print("bad:", bad)
