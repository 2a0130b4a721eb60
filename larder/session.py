"""SparkSession construction and the shared checkpoint location.

Every job in the library is lazy DataFrame code; this module only decides how
the session is configured.  The settings that matter at scale:

* AQE on, with partition coalescing and skew-join splitting, so a hot key (a
  listing claimed by a third of all receivers) is split across tasks at run
  time instead of landing in one reducer.
* ``autoBroadcastJoinThreshold`` left at Spark's size check: dimension-like
  tables (providers, receivers, listings) grow with the data, so whether they
  are broadcast is decided from measured sizes, never forced.
* The checkpoint directory is taken from the cluster's ``spark.checkpoint.dir``
  when present; a private folder is created only when nothing is configured
  (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole documents go through the title-case pandas UDF: 1,000 rows of up
    # to ~150 KB keep an Arrow batch far below the 2 GB string-offset limit.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


# Settings for a large cluster (hundreds of executors, inputs in the 100 TB
# range).  Shuffle partition counts start high and AQE coalesces them towards
# the advisory size, so one setting serves both the 20,000-way lineitem
# aggregation of the load and the small per-city reports; skewed partitions
# (5x the median and over 512 MB) are split at run time.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    # Lost executors: retry tasks and recompute lost shuffle output from
    # lineage rather than failing the stage.  (Where the cluster runs the
    # external shuffle service, enabling it also keeps shuffle files alive.)
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "8",
}


def get_session(
    master: str | None = None,
    app_name: str = "larder",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
    cluster: bool = False,
) -> SparkSession:
    """Return (or create) a session with the library's defaults.

    On a cluster pass ``master=None`` and ``cluster=True`` and let
    spark-submit decide the rest; tests pass ``local[*]`` and a small
    ``shuffle_partitions``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if cluster:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only if unset.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that value
    always wins.  Only when nothing is configured and the master is local (a
    test session) is a private temporary folder created; on a cluster a
    missing setting is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # A folder on the driver's disk is invisible to the executors.
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="larder-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{os.urandom(6).hex()}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read back from there.

    For what several later steps read: they scan the columns they need instead
    of deriving the rows again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
