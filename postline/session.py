"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import threading

from pyspark.sql import SparkSession

# Settings every job in this package relies on.  AQE re-plans joins with
# runtime sizes (the only broadcast decisions made for data-derived sides)
# and splits skewed partitions (hot keys such as company 'Unknown' or url '').
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # state of streams on disk, with incremental checkpoints
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # JSON with a repeated key: the last value wins, as Python's json.loads does
    # (by default VARIANT parsing rejects such text)
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "postline") -> SparkSession:
    """A session with the defaults above.  Partition numbers, memory and all
    other sizing stay as the cluster (or spark-submit) configures them unless the
    caller says otherwise; a local session without configuration gets driver
    memory for tests and the benchmark."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local") or "POSTLINE_DRIVER_MEM" in os.environ:
        builder = builder.config("spark.driver.memory", os.environ.get("POSTLINE_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` (or already set on the
    context) wins.  Only a local session, whose executors are the driver
    itself, may go without: it uses a folder under its warehouse directory.  On a cluster
    the setting is required, since a machine-local folder would be lost
    with its machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_postline_checkpoints"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


_LOCAL = threading.local()
_LEFT: list[str] = []           # all folders not dropped yet, of any thread


def scratch_tables() -> list[str]:
    """Lineage-cut tables written by the current thread (a streaming
    micro-batch runs in one thread, so concurrent queries keep apart)."""
    if not hasattr(_LOCAL, "paths"):
        _LOCAL.paths = []
    return _LOCAL.paths


def remember_scratch(path: str) -> str:
    """Note a scratch folder: ``drop_scratch`` deletes it, at the latest when
    the process ends with its session still running."""
    if not _LEFT:
        atexit.register(_drop_left)
    scratch_tables().append(path)
    _LEFT.append(path)
    return path


def _drop_left() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        scratch_tables()[:] = list(_LEFT)
        with contextlib.suppress(Exception):    # the JVM may have ended first
            drop_scratch(spark)


def written(df, name: str):
    """Cut lineage by writing ``df`` as a table in the shared checkpoint
    folder and reading it back: one pass over ``df`` (a reliable RDD
    checkpoint may compute it twice), a plan leaf of constant size for
    everything downstream, and a copy that survives executor loss.  The
    folder is remembered for ``drop_scratch``."""
    import uuid
    path = scratch_path(df.sparkSession, f"{name}_{uuid.uuid4().hex}")
    df.write.parquet(remember_scratch(path))
    return df.sparkSession.read.parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the lineage-cut tables this thread wrote.  Call it only once
    every result that reads them has been written out (DataFrames built on
    them are unusable afterwards).  Returns the number of folders removed."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    removed = 0
    paths = scratch_tables()
    while paths:
        path = paths.pop()
        if path in _LEFT:
            _LEFT.remove(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p) and fs.delete(p, True):
            removed += 1
    return removed
