"""The row-local blocks run unchanged on a streaming DataFrame."""

import os
import shutil

from blockpipe import operators as ops

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_row_local_blocks_on_a_stream(spark, tmp_dir):
    schema = spark.read.parquet(EVENTS).schema
    src = os.path.join(tmp_dir, "events")  # a file stream reads a folder
    os.makedirs(src)
    shutil.copy(EVENTS, os.path.join(src, "part-0.parquet"))
    stream = spark.readStream.schema(schema).parquet(src)
    df = ops.drop_missing(stream)
    df = ops.construct(df, {"day": "date_format(ts, 'yyyy-MM-dd')"})
    df = ops.parse_time(df, "day", "yyyy-MM-dd", out="day_start")
    df = ops.map_values(df, "event_type", {"click": "CLICK"})
    df = ops.reduce_rows(df, 0.5, "event_id", seed=1)
    q = (
        df.writeStream.format("memory").queryName("bp_stream_check")
        .option("checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = spark.table("bp_stream_check")
    batch = ops.reduce_rows(
        ops.map_values(spark.read.parquet(EVENTS), "event_type", {"click": "CLICK"}), 0.5, "event_id", seed=1
    )
    assert got.count() == batch.count() > 0
    assert got.where("event_type = 'click'").count() == 0
