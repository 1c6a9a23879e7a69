"""Session defaults and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults for a local/test session. On a cluster the deployment sets these;
# builder.config only applies when this process creates the session.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
    # partitioned writes on low-cardinality columns (the detail by expense category)
    # keep one writer per value open instead of sorting each task's rows first
    "spark.sql.maxConcurrentOutputFileWriters": "8",
    # checkpoints (ranks, DP rounds, gate summaries) are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tallyframe") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory := os.environ.get("TALLY_DRIVER_MEMORY"):      # else the deployment's setting
        builder = builder.config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster). Only when it is
    unset on a local master -- local runs and tests -- a fresh scratch folder
    is created; on a cluster an unset setting is an error, never a
    machine-local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: point it at a folder shared by all executors")
        d = tempfile.mkdtemp(prefix="tally-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
    except Exception:  # noqa: BLE001  (no SparkContext on a Connect session; the server's setting applies)
        pass
    return d


def session_id(spark: SparkSession) -> str:
    """An id that no other session has, also not a later one at the same place in memory."""
    return f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
