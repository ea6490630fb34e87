"""Compare registered Spark queries with their DuckDB oracle (like the driver's gate).

Usage: ``python tests/oracle_harness.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from lexiprop.fixtures import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        # as strict as a hash of the values: a negative zero in an array isn't zero
        return tuple("-0.0" if isinstance(x, float) and x == 0 and math.copysign(1, x) < 0 else _norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def compare(spark_df, con, sql: str):
    s_cols = spark_df.columns
    s_rows = [tuple(_norm(r[c]) for c in sorted(s_cols)) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    idx = [d_cols.index(c) for c in sorted(d_cols)]
    d_rows = [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    ss = sorted(s_rows, key=repr)
    ds = sorted(d_rows, key=repr)
    if ss != ds:
        diff_s = [r for r in ss if r not in set(ds)][:3]
        diff_d = [r for r in ds if r not in set(ss)][:3]
        problems.append(f"values differ; spark-only {diff_s} duck-only {diff_d}")
    return problems, len(s_rows)


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from lexiprop.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name not in sqls:
                n = df.count()
                print(f"ROWS-ONLY {name}: {n} rows ({time.time() - t0:.1f}s)")
                continue
            problems, n = compare(df, con, sqls[name])
        except Exception as exc:  # report and continue
            problems, n = [f"error {type(exc).__name__}: {str(exc)[:800]}"], -1
        status = "OK  " if not problems else "FAIL"
        bad += bool(problems)
        print(f"{status} {name}: {n} rows ({time.time() - t0:.1f}s) {' | '.join(problems)}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
