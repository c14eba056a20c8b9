"""Benchmark: every registered query at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full through the ``noop`` sink (every row is
computed, nothing is collected). One warm-up pass over all queries, then
``BENCH_RUNS`` timed passes (default 3); a query's time is its median.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

REPO = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, REPO)
# Python workers are separate processes: let them import the package too
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (REPO, os.environ.get("PYTHONPATH")) if p)

from blockpipe import suite  # noqa: E402
from blockpipe.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = get_session(
        f"local[{cpus}]",
        app_name="blockpipe-bench",
        conf={
            "spark.sql.shuffle.partitions": str(max(cpus, 8)),
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
            "spark.sql.warehouse.dir": f"{scratch}/warehouse",
            "spark.checkpoint.dir": f"{scratch}/checkpoint",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = only or list(suite.QUERIES)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    errors: dict[str, str] = {}
    for name in names:  # warm-up: JIT, file listing, Python workers
        try:
            run(name)
        except Exception as exc:  # a failing query is reported, not fatal
            errors[name] = f"{type(exc).__name__}: {str(exc)[:300]}"
    times: dict[str, list[float]] = {n: [] for n in names if n not in errors}
    for _ in range(runs):
        for name in list(times):
            try:
                times[name].append(run(name))
            except Exception as exc:
                errors[name] = f"{type(exc).__name__}: {str(exc)[:300]}"
                del times[name]
    per_query = {n: round(statistics.median(t), 3) for n, t in times.items()}
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "sum_of_median_query_seconds",
                "value": round(sum(per_query.values()), 3),
                "unit": "sec",
                "queries": per_query,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "runs": runs,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                "errors": errors,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
