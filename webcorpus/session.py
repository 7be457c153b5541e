"""Session helpers.

The library never creates its own cluster settings when a session already exists:
``get_session`` only fills defaults that are unset, so a cluster's configuration
(shuffle partitions, checkpoint folder, AQE) always wins.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults for local runs and tests. On a cluster these come from spark-defaults.
LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "webcorpus",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one with library defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("WEBCORPUS_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates (crawl rounds, stream sinks).

    Uses the cluster's ``spark.checkpoint.dir``. Where it is unset, a local session
    (one machine) gets a fresh scratch folder; on a cluster that is an error, since a
    folder of one machine is not seen by the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    local = tempfile.mkdtemp(prefix="webcorpus-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # static conf on some deployments; the context setting suffices
        pass
    spark.sparkContext.setCheckpointDir(local)
    return local


PAGES_PER_BATCH = 200


@contextmanager
def pages_per_batch(spark: SparkSession, rows: int = PAGES_PER_BATCH):
    """Arrow batches of at most ``rows`` rows for what runs inside: whole pages go to the Python workers and
    back, and with Spark's 10,000 rows a batch of them takes most of an executor's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship_python_code() -> None:
    """Make the library's Python functions used inside Pandas UDFs travel with the
    task (pickled by value), so executors need no installed copy of the package."""
    import webcorpus
    try:
        from pyspark import cloudpickle
        if "webcorpus" not in getattr(cloudpickle.cloudpickle, "_PICKLE_BY_VALUE_MODULES", set()):
            cloudpickle.register_pickle_by_value(webcorpus)
    except Exception:  # older pickler: fall back to shipping the package on the path
        pass
