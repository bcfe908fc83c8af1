"""Run registered queries in Spark and their SQL oracles in DuckDB and
compare row counts, column names and order-insensitive values.

usage: python tools/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from veilspark.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(records, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in records), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, builder, sql, sf_dir):
    t0 = time.time()
    sdf = builder(spark, sf_dir)
    s_cols = sorted(sdf.columns)
    s_rows = [r.asDict(recursive=True) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, spark_rows=len(s_rows), spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    d_cols_raw = [c[0] for c in res.description]
    d_rows = [dict(zip(d_cols_raw, r)) for r in res.fetchall()]
    t2 = time.time()
    d_cols = sorted(d_cols_raw)
    info = dict(name=name, spark_rows=len(s_rows), duck_rows=len(d_rows), spark_s=round(t1 - t0, 2),
                duck_s=round(t2 - t1, 2))
    if s_cols != d_cols:
        info.update(ok=False, why=f"columns {s_cols} vs {d_cols}")
        return info
    a, b = rows_of(s_rows, s_cols), rows_of(d_rows, d_cols)
    if a != b:
        diff_a = [x for x in a if x not in set(b)][:3]
        diff_b = [x for x in b if x not in set(a)][:3]
        info.update(ok=False, why=f"values differ; spark-only {diff_a} duck-only {diff_b}")
        return info
    info["ok"] = True
    return info


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    from veilspark.plans import catalog
    from veilspark.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name, b in qs.items():
        if only and name not in only:
            continue
        try:
            info = compare(spark, con, name, b, sqls.get(name), sf_dir)
        except Exception as e:  # report and continue
            info = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        if info.get("ok") is False:
            bad += 1
        print(info, flush=True)
    print(f"FAILED {bad}")


if __name__ == "__main__":
    main()
