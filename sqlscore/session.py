"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sqlscore", driver_memory: str | None = None) -> SparkSession:
    """Session with the settings every job here assumes (UTC, AQE, Arrow, no UI).
    ``driver_memory`` only matters in local mode, where the driver JVM is the
    executor too (it must be set before the JVM starts)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # jobs of several driver threads (score_results) share the executors
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.ui.showConsoleProgress", "false")
        # checkpoint files of frames that are no longer referenced are removed,
        # so the shared checkpoint folder does not grow without bound
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, stream state and materialised tables.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset a
    private temporary folder is used, but only in local mode, where driver and
    executors are one process; on a cluster that would be the driver's own
    disk, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sqlscore-ckpt-"))
        path = sc.getCheckpointDir()  # the same on every call
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


_folder: ContextVar[str | None] = ContextVar("scratch folder", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing path under the checkpoint root (in a
    ``scratch_folder`` under that folder) for one job's output or stream
    checkpoint (unique name, so reruns never collide)."""
    import uuid
    return f"{_folder.get() or checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete what was written to a path that ``scratch_path`` gave out."""
    if not path.startswith(f"{checkpoint_root(spark)}/"):
        raise ValueError(f"{path} is not below the checkpoint folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[None]:
    """Scratch paths that this thread asks for inside lie in one folder, which is
    deleted at the end: write what is still needed to a path from outside.  After a
    failure the folder stays."""
    path = scratch_path(spark, name)
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
    drop_scratch(spark, path)


def stash(df, name: str, path: str | None = None):
    """Cut lineage with a table written once into the shared folder (to a fresh
    path unless one is given) and read back: several jobs then reuse the stored
    rows, and a lost executor costs a re-read.  Unlike ``checkpoint()`` the file is
    columnar, so later steps read only the columns they need."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df):
    """Cut lineage for a frame that several actions reuse: a reliable
    ``checkpoint()`` into the shared checkpoint folder (never a local one),
    so a lost executor costs a re-read, not a recomputation of the plan."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
