from pyspark.sql import functions as F

from blockpipe.plans.sizing import broadcast_if_small, broadcast_limit_bytes
from blockpipe.session import checkpoint_root, scratch_path


def test_broadcast_threshold_parsing(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for raw, want in [("10MB", 10 << 20), ("-1", -1), ("1048576", 1 << 20), ("64k", 64 << 10), ("2g", 2 << 30)]:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", raw)
            assert broadcast_limit_bytes(spark.range(1)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_broadcast_only_when_measured_small(spark):
    small, is_small = broadcast_if_small(spark.range(10))
    assert is_small and small.count() == 10
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100b")
        big, is_small = broadcast_if_small(spark.range(1000).withColumn("s", F.lit("x")))
        assert not is_small and big.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scratch_paths_live_under_the_checkpoint_folder(spark):
    root = checkpoint_root(spark)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a.startswith(root.rstrip("/")) and a != b
