"""Run every registered query the way a driver might: a plain default
session (200 shuffle partitions, no blockpipe defaults, no checkpoint folder)
in a chosen session time zone, each compared with its DuckDB SQL.

    python tests/driver_check.py [sf_dir] [time_zone] [name ...]
"""

from __future__ import annotations

import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, duck  # noqa: E402


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    tz = argv[2] if len(argv) > 2 else "America/Los_Angeles"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", tz)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    print("entry rows:", entry.entry(spark).count())
    con = duck(sf)
    bad = []
    queries, sql = entry.queries(), entry.oracle_sql()
    names = argv[3:] or list(queries)
    for name in names:
        status = compare(spark, con, name, sf, queries, sql)["status"]
        if status not in ("ok", "ok@6", "rows-only"):
            bad.append((name, status[:200]))
    print(f"checked {len(names)} queries in {tz}; mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
