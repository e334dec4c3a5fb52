"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from larder.errors import LarderError


def build_session(app="larder", master=None, shuffle_partitions=None, **conf) -> SparkSession:
    """Session with adaptive execution; sizes are left to the cluster unless given.

    Broadcast joins are never forced in this package: Catalyst and AQE choose them when
    the measured size of a side is below the threshold set here, and otherwise
    fall back to a sort-merge join with skew splitting.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.sql.parquet.aggregatePushdown", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local, as in tests, a temporary folder of this machine takes its place
    and is removed at the end of the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise LarderError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="larder-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses; ``drop_scratch`` removes it."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _SCRATCH.add(path)
    return path


def discard(spark: SparkSession, path: str) -> bool:
    """Delete one ``scratch_path`` that nothing will read again."""
    _SCRATCH.discard(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def drop_scratch(spark: SparkSession) -> int:
    """Delete everything that this process wrote below the shared folder, once its results are stored or shown."""
    dropped = 0
    while _SCRATCH:
        dropped += discard(spark, next(iter(_SCRATCH)))
    return dropped


def settle(df: DataFrame, name="settled") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later uses do not recompute it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
