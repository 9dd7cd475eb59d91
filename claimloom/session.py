"""Session defaults, lineage cuts and lookup tables of known size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("claimloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        # Recording a call site for every expression triples the time it takes to build one.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names, or a fresh local one in tests."""
    context = spark.sparkContext
    known = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not known:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return context.getCheckpointDir()


#: Folders that this process has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder; :func:`drop_cuts` deletes what is written there."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut_lineage(df: DataFrame, *by: str) -> DataFrame:
    """Write the table to the shared folder once, in folders by the columns ``by``, and continue from the written copy.

    Used where a costly result feeds several branches, or where row placement must not change on a retry.  The copy
    is columnar: later steps read only the columns they need, and a lost executor recomputes nothing before it.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Write a lookup table once, so that Spark plans its joins by the size it really has.

    A written table below ``spark.sql.autoBroadcastJoinThreshold`` is broadcast; a larger one is joined by shuffle,
    where both sides are then plain exchanges that adaptive execution can split when a key is hot.  No hint is given.
    """
    return cut_lineage(df)


def drop_cuts(spark: SparkSession) -> int:
    """Deletes what was written under :func:`scratch_path` names; call it when no result of it is needed any more."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)
