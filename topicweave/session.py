"""Spark session helpers.

Cluster settings (checkpoint dir, shuffle partitions, memory) come from the cluster's own
configuration; the defaults here only fill gaps for local runs and tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "8g",
}


def get_spark(master: str | None = None, app: str = "topicweave", **conf: str) -> SparkSession:
    """The active session untouched (a cluster's own settings win), or a new one.

    Local-run defaults (8 shuffle partitions, driver memory, no UI) apply only to ``local[...]``
    masters; on a cluster the partition count is left to the cluster config and AQE.
    """
    active = SparkSession.getActiveSession()
    if active is not None and not conf:
        return active
    builder = SparkSession.builder.appName(app)
    settings = dict(conf)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            settings = {**_LOCAL_DEFAULTS, **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and small state tables.

    Uses ``spark.checkpoint.dir`` as the cluster names it; only when it is unset on a
    ``local[...]`` master (local runs, tests) a fresh scratch folder is created and registered.
    On a cluster a machine-local folder would not be shared by the executors, so an unset
    setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster's file system)")
        configured = tempfile.mkdtemp(prefix="topicweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured
