"""Run registered queries in Spark and their reference SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dealweave.fixtures import BASE_TABLES  # noqa: E402

DATA = os.environ.get("TEST_DATA", "/root/testdata")


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return v if v is None or isinstance(v, (str, bool)) else str(v)


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(cell(r[i])) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark, con, key, fn, sql, sf_dir, show=3):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got, cols = normal([tuple(r) for r in df.collect()], df.columns)
    t1 = time.time()
    rel = con.execute(sql)
    want, wcols = normal(rel.fetchall(), [d[0] for d in rel.description])
    t2 = time.time()
    problems = []
    if cols != wcols:
        problems.append(f"columns {cols} != {wcols}")
    elif got != want:
        extra = [r for r in got if r not in set(want)][:show]
        lack = [r for r in want if r not in set(got)][:show]
        problems.append(f"rows {len(got)} vs {len(want)}; spark only {extra}; sql only {lack}")
    return len(got), t1 - t0, t2 - t1, problems


def main(argv):
    from dealweave.session import local_session
    import __spark_entry__ as e

    sf_dir = f"{DATA}/{os.environ.get('SF', 'sf0.01')}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = e.queries(), e.oracle_sql()
    keys = [k for k in queries if not argv or any(k.startswith(a) for a in argv)]
    bad = 0
    for k in keys:
        try:
            if k in oracle:
                n, a, b, problems = compare(spark, con, k, queries[k], oracle[k], sf_dir)
            else:
                t0 = time.time()
                n, problems = queries[k](spark, sf_dir).count(), []
                a, b = time.time() - t0, 0
            flag = "ok " if not problems else "BAD"
            print(f"{flag} {k:8s} rows={n} spark={a:.2f}s duck={b:.2f}s {'' if k in oracle else '(no sql)'} {' '.join(problems)[:900]}", flush=True)
            bad += bool(problems)
        except Exception as ex:
            bad += 1
            print(f"ERR {k:8s} {type(ex).__name__}: {str(ex)[:700]}", flush=True)
    print("failures:", bad, "of", len(keys))


if __name__ == "__main__":
    main(sys.argv[1:])
