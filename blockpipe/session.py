"""Session defaults and the shared scratch folder.

Everything here is configuration a Spark user would set anyway; nothing is
hard-wired into the operators, which only ever receive DataFrames.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings applied only when the caller (or the cluster) has not set them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of ranking steps are deleted once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(
    master: str | None = None,
    app_name: str = "blockpipe",
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return the active session, or build one with the defaults above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # spark-submit / spark-defaults settings win over our defaults
    submitted = SparkConf()
    for key, value in DEFAULT_CONF.items():
        if not submitted.contains(key):
            builder = builder.config(key, value)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a folder every executor can reach). Only a
    local-mode session without one gets a private folder, as in tests.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect client has no context; the server checkpoints
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder shared by the cluster")
        return root
    root = sc.getCheckpointDir()
    if root:
        return root
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; name a folder shared by the cluster"
            )
        configured = tempfile.mkdtemp(prefix="blockpipe-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
