"""Reliable scratch storage and lineage cuts for iterative plans."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session does not set it, and only on a single machine (tests, the
    benchmark), a local folder is used instead; a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a replicated checkpoint; lost executors cost nothing."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared scratch folder, deleted when the application ends."""
    path = f"{checkpoint_root(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as Parquet under the shared scratch folder and read it back.

    Unlike checkpoint() the copy is columnar and compressed, keeps statistics
    for the planner, and allows column pruning.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._stored_at = path  # for discard()
    return kept


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that no later step reads."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lookup(df: DataFrame, name: str, most_rows: int = 1_000_000) -> DataFrame:
    """df stored, and marked for broadcast if its rows, counted, are at most most_rows.

    For narrow tables that are joined onto something already partitioned as
    needed; larger ones join by shuffles.
    """
    kept = stored(df, name)
    return F.broadcast(kept) if kept.count() <= most_rows else kept


def files(df: DataFrame) -> tuple[tuple[str, int, int], ...]:
    """Path, size and time of change of each file that df reads: what a result kept for later depends on."""
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


_MADE: dict[tuple, object] = {}


def once(spark: SparkSession, key: tuple, make: Callable[[], object]) -> object:
    """What make() gave for this key in this application before, or now gives; key has to name the state of all that it reads."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def made(spark: SparkSession, key: tuple) -> object | None:
    """What once() has for this key, if anything."""
    return _MADE.get((spark.sparkContext.applicationId, *key))
