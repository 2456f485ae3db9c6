"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def key(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(key(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{key(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(key(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    t = time.time()
    df = fn(spark, folder)
    got = [tuple(r.asDict(True).values()) if not hasattr(r, "__fields__") else tuple(r.asDict(True)[c] for c in df.columns) for r in df.collect()]
    t1 = time.time() - t
    if sql is None:
        return f"rows-only {len(got)} rows {t1:.1f}s", bool(got)
    t = time.time()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    t2 = time.time() - t
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS differ spark={sorted(df.columns)} sql={sorted(names)}", False
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        return (f"VALUES differ spark={len(a)} sql={len(b)} rows; only spark ({len(sa - sb)}): {sorted(sa - sb)[:2]} only sql ({len(sb - sa)}): {sorted(sb - sa)[:2]} "
                f"columns={sorted(names)}"), False
    return f"ok {len(a)} rows spark {t1:.1f}s duckdb {t2:.1f}s", True


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("compare").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="plumbline-")).getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main():
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    import __spark_entry__ as e
    qs, sq = e.queries(), e.oracle_sql()
    spark, con = session(), duck(folder)
    bad = []
    for name in args or list(qs):
        try:
            text, ok = compare(spark, con, name, qs[name], sq.get(name), folder)
        except Exception as exc:
            text, ok = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", False
        if not ok:
            bad.append(name)
        print(f"{name:36s} {text}", flush=True)
    print(f"{len(args or qs) - len(bad)} good, bad: {bad}")


if __name__ == "__main__":
    main()
