"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session time (timestamps compare equal to the
# oracle), adaptive execution (coalesces small shuffles, splits skewed join
# partitions at run time) and no web UI.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Parquet row groups are read in parallel; 128 MB splits keep a task's input
    # bounded whatever the table size.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "deskflow") -> SparkSession:
    """Return the active session, or build a local one with the defaults above.

    On a cluster the session already exists (created by the launcher), so only
    settings that are unset are filled in; nothing the cluster chose is changed.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        _fill_unset(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("DESKFLOW_MASTER", "local[*]"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("DESKFLOW_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _fill_unset(spark)
    return spark


def _fill_unset(spark: SparkSession) -> None:
    """Set what no one has set: a session time zone the caller chose stays."""
    for k in ("spark.sql.session.timeZone",):
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, "UTC")
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster to shared storage).
    Only a local session without that setting (tests) gets a scratch folder of
    its own; a cluster without it is refused, since its executors would write
    to folders that the others cannot see.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        path = tempfile.mkdtemp(prefix="deskflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-path of the shared checkpoint folder for a written table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
