"""Summarize the final physical plan of every registered query.

    python tests/plan_report.py [sf_dir] > PLANS.md

Each query is run once (so adaptive execution settles its plan); the final
plan is then read from the query execution.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from blockpipe import suite  # noqa: E402
from blockpipe.session import get_session  # noqa: E402

NODES = {
    "shuffles": r"(?:^|[-:+] )(?:\*\(\d+\) )?(?:Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin)",
    "broadcasts": r"(?:^|[-:+] )(?:\*\(\d+\) )?BroadcastExchange\b",
    "smj": r"(?:^|[-:+] )(?:\*\(\d+\) )?SortMergeJoin\b",
    "bhj": r"(?:^|[-:+] )(?:\*\(\d+\) )?BroadcastHashJoin\b",
    "nested_loop": r"(?:^|[-:+] )(?:\*\(\d+\) )?(?:BroadcastNestedLoopJoin|CartesianProduct)\b",
    "windows": r"(?:^|[-:+] )(?:\*\(\d+\) )?Window\b",
    "python": r"(?:^|[-:+] )(?:\*\(\d+\) )?(?:ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas|PythonMapInArrow)\b",
    "subqueries": r"(?:^|[-:+] )(?:\*\(\d+\) )?Subquery\b",
    "checkpoint_scans": r"(?:^|[-:+] )(?:\*\(\d+\) )?Scan ExistingRDD\b|(?:^|[-:+] )(?:\*\(\d+\) )?Scan \w+RDD\b",
}


def final_plan(df) -> str:
    """The executed plan; for adaptive plans, the final one."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    return plan.toString()


def summarize(plan: str) -> dict:
    out = {k: len(re.findall(p, plan, flags=re.M)) for k, p in NODES.items()}
    scans = []
    for fmt, cols, rest in re.findall(r"FileScan (\w+) \[([^\]]*)\]([^\n]*)", plan):
        loc = re.search(r"Location: [^\[]*\[([^\]]*)", rest)
        path = loc.group(1).split(",")[0] if loc else "?"
        name = path.rstrip("/").rsplit("/", 1)[-1] or path
        scans.append(f"{name}({len(cols.split(','))} cols)")
    out["scans"] = sorted(set(scans))
    out["pushed"] = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))
    return out


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    print("# Physical plans of the registered queries\n")
    print(f"Final adaptive plans after one run at `{sf}`, `local[8]`, 8 shuffle partitions. ")
    print("Counts are plan nodes; checkpoint scans read data a ranking step materialized.\n")
    print("| query | shuffles | broadcasts | SMJ | BHJ | nested loop | windows | python | scalar subqueries | checkpoint scans | scans | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in suite.QUERIES.items():
        df = fn(spark, sf)
        df.collect()
        s = summarize(final_plan(df))
        print(
            f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['smj']} | {s['bhj']} | {s['nested_loop']} | "
            f"{s['windows']} | {s['python']} | {s['subqueries']} | {s['checkpoint_scans']} | {', '.join(s['scans'])} | "
            f"{'; '.join(s['pushed'])[:120]} |"
        )


if __name__ == "__main__":
    main(sys.argv)
