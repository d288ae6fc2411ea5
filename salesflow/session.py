"""Session helpers.

On a cluster the caller owns the ``SparkSession`` and its settings; nothing
here overrides them. ``local_session`` is for tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings of local (test / bench) sessions. The plans do not depend on them:
# dates are timestamp_ntz and every lossy cast is a try_ form, so a cluster
# session's own time zone and ANSI setting give the same results.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "salesflow") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SALESFLOW_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    A cluster names it in ``spark.checkpoint.dir``; it is only invented here
    when the session has none (local tests), never on top of a cluster value.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no driver-side context, use the configuration only
        return _configured_dir(spark)
    current = sc.getCheckpointDir()
    if current:
        return current
    sc.setCheckpointDir(_configured_dir(spark))
    return sc.getCheckpointDir()


def _configured_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a local temporary folder for a local session only."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        app = spark.conf.get("spark.app.id", None)
        return conf_dir.rstrip("/") + (f"/{app}" if app else "")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir (or salesflow.warehouse.dir) to a folder "
                           "shared by the cluster; a machine-local folder cannot be used")
    return tempfile.mkdtemp(prefix="salesflow-ckpt-")


def parallelism(spark: SparkSession) -> int:
    """Task slots of the session (default parallelism)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # Spark Connect
        return int(spark.conf.get("spark.default.parallelism", str(os.cpu_count() or 8)))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder next to the session's checkpoint data, for written tables."""
    explicit = spark.conf.get("salesflow.warehouse.dir", None)
    base = explicit or ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name
