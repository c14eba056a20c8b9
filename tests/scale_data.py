"""Write a larger copy of a driver scale factor, for scaling checks.

    python tests/scale_data.py /root/testdata/sf0.1 /tmp/sfx 10

``lineitem``, ``orders`` and ``events`` are replicated ``copies`` times with
their keys shifted per copy (so lineitem still matches orders); the other
tables are linked unchanged. ``events_skewed`` adds a version of the
replicated events in which one user holds a third of the rows.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from blockpipe.session import get_session  # noqa: E402
from blockpipe.suite import TABLES  # noqa: E402

SHIFT = {"lineitem": ["l_orderkey"], "orders": ["o_orderkey"], "events": ["event_id"]}


def main(src: str, dst: str, copies: int) -> None:
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "64"})
    spark.sparkContext.setLogLevel("ERROR")
    os.makedirs(dst, exist_ok=False)
    for t in TABLES:
        path = f"{src}/{t}.parquet"
        if t not in SHIFT:
            os.symlink(path, f"{dst}/{t}.parquet")
            continue
        df = spark.read.parquet(path)
        span = df.agg(*[F.max(c) for c in SHIFT[t]]).first()[0] + 1
        copy = spark.range(copies).select(F.col("id").alias("_copy"))
        big = df.crossJoin(F.broadcast(copy)).withColumns(
            {c: F.col(c) + F.col("_copy") * span for c in SHIFT[t]}
        ).drop("_copy")
        big.write.parquet(f"{dst}/{t}.parquet")
        if t == "events":
            hot = F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id"))
            spark.read.parquet(f"{dst}/events.parquet").withColumn("user_id", hot).write.parquet(
                f"{dst}/events_skewed.parquet"
            )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]))
