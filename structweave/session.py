"""Session helpers: where intermediate tables may be written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether shuffle files go as soon as their query has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    (tests) gets a folder of its own; on a cluster a missing setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder all executors share")
    own = tempfile.mkdtemp(prefix="structweave-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut, safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
    # Spark removes the shuffle files of a finished plan once the driver's JVM has collected it; do not wait for that.
    df.sparkSession._jvm.System.gc()
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written_at = path
    return written


def discard(df: DataFrame) -> None:
    """Delete a table that ``saved`` wrote, once nothing reads it any more."""
    path = getattr(df, "_written_at", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table with fewer splits than cores one partition per core; larger tables stay as they are.

    ``keys`` must identify rows, so that placement is even and the same on every attempt.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
