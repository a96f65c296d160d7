"""Session helpers: UTC clock, AQE on, UI off, a shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sondage") -> SparkSession:
    """Return the active session, or build a local one for tests and benches.

    On a cluster the session already exists (spark-submit); we only pin the
    settings the engine's semantics depend on (UTC session zone).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        active.conf.set("spark.sql.session.timeZone", "UTC")
        return active
    builder = (
        SparkSession.builder.appName(app_name)
        .master(master or os.environ.get("SONDAGE_MASTER", "local[8]"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SONDAGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, for what a job may lose when it ends.

    A cluster must name one: its driver and executors share no other folder,
    so an unset name is an error there.  With a local master (tests, benches) a
    fresh private folder is taken.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sondage-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def tables_dir(spark: SparkSession) -> str:
    """The folder of tables that stay: ``sondage`` in the session's warehouse."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/sondage"
