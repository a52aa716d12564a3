"""Spark session defaults and the shared checkpoint location."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Session settings every job relies on: AQE for runtime re-planning (size-checked
# broadcast, partition coalescing, skew-join splitting), UTC for timestamp parity,
# small Arrow batches because rows carry whole source texts.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # target shuffle partition size after AQE coalescing / skew splitting
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # remove reliable-checkpoint files once their DataFrames are unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "quarry", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A private scratch folder is made only where the session names none *and*
    the master is ``local`` (tests, benches): one machine then sees it. On any
    other master a missing setting is an error, because executors could not
    read what the driver or another executor wrote. The folder is registered
    with the context once, so ``checkpoint()`` adds one sub-folder per session.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_ROOTS.get(sc.applicationId)
    if not configured and sc.getCheckpointDir() is not None:
        # set by the user through setCheckpointDir(): its session sub-folder is shared
        return sc.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="quarry-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def session_root(spark: SparkSession) -> str:
    """This application's own folder below the shared one, removed by Hadoop's
    file system when the driver's JVM ends in order."""
    sc = spark.sparkContext
    root = f"{checkpoint_root(spark).rstrip('/')}/quarry-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of this session's shared folder for written intermediate tables."""
    return f"{session_root(spark)}/{name}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove one written intermediate table."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
