"""Run registered queries in Spark and their SQL in DuckDB; compare results.

    python tests/oracle.py [sf_dir] [name ...] [--json report.json]

Rows are compared order-insensitively after sorting columns by name; floats
are compared exactly and, as a fallback, at 6 decimals.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from blockpipe import suite  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in suite.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits) if digits is not None else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def rows(pdf: pd.DataFrame, digits=None):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v, digits) for v in rec))
    return cols, sorted(out, key=repr)


def compare(spark, con, name: str, sf_dir: str, queries=suite.QUERIES, oracle_sql=suite.ORACLE_SQL) -> dict:
    t0 = time.time()
    sdf = queries[name](spark, sf_dir)
    got = sdf.toPandas()
    t1 = time.time()
    res = {"name": name, "rows": len(got), "spark_sec": round(t1 - t0, 2)}
    sql = oracle_sql.get(name)
    if sql is None:
        res["status"] = "rows-only"
        return res
    want = con.sql(sql).df()
    gc, gr = rows(got)
    wc, wr = rows(want)
    if gc != wc:
        res["status"] = f"COLUMNS {gc} vs {wc}"
    elif len(gr) != len(wr):
        res["status"] = f"ROWCOUNT {len(gr)} vs {len(wr)}"
    elif gr == wr:
        res["status"] = "ok"
    elif rows(got, 6)[1] == rows(want, 6)[1]:
        res["status"] = "ok@6"
    else:
        bad = [(a, b) for a, b in zip(rows(got, 6)[1], rows(want, 6)[1]) if a != b][:3]
        res["status"] = f"VALUES {bad}"
    res["spark_types"] = dict(sdf.dtypes)
    res["duck_types"] = dict(zip(want.columns, [str(t) for t in want.dtypes]))
    return res


def main(argv):
    report_path = None
    if "--json" in argv:
        i = argv.index("--json")
        report_path = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")] or list(suite.QUERIES)
    report = {}
    from blockpipe.session import get_session

    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as exc:  # report and go on
            r = {"name": n, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        ok = r["status"] in ("ok", "ok@6", "rows-only")
        bad += not ok
        report[n] = {k: r.get(k) for k in ("status", "rows", "spark_sec")}
        print(f"{'PASS' if ok else 'FAIL'} {n}: {r['status']} rows={r.get('rows')} t={r.get('spark_sec')}", flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    if report_path:
        import json

        with open(report_path, "w") as fh:
            json.dump({"sf_dir": sf_dir, "passed": len(names) - bad, "total": len(names), "queries": report}, fh,
                      indent=1)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
