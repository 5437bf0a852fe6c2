"""Session settings and the shared folder used for data that has to outlive a task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# All of these are ordinary Spark settings. AQE merges small shuffle partitions but never
# adds any, so their number before merging follows the input: see ``build_session``.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Java compiles no method above 8000 bytes of code: larger ones run better unfused.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PARTITION_BYTES = 128 << 20


def initial_partitions(input_bytes: int, least: int = 200, most: int = 1_000_000) -> int:
    """Shuffle partitions to start with, so that one holds about 128 MB if all input is shuffled."""
    return max(least, min(most, -(-input_bytes // PARTITION_BYTES)))


def build_session(
    app_name: str = "runledger", master: str | None = None, input_bytes: int | None = None, **settings: str
) -> SparkSession:
    """A session with this library's settings; ``settings`` use ``__`` for dots.

    ``input_bytes`` is about how much the largest query reads; it sets the number of shuffle
    partitions before small ones are merged (100 TB: about 800,000).
    """
    builder = SparkSession.builder.appName(app_name)
    if input_bytes is not None:
        builder = builder.config(INITIAL_PARTITIONS, str(initial_partitions(input_bytes)))
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master, where driver and executors share one disk, may fall back
    to a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    if folder:
        return folder
    if not local:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="runledger-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
