"""Shared, fault-tolerant working storage.

Anything read more than once, produced by a side effect, or needing its
lineage cut is written as a table under the folder the session names in
``spark.checkpoint.dir``.  Lost executors then re-read files, not lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh local one only in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="dustpan-"))
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


def new_location(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def new_mounted_dir(spark: SparkSession, name: str) -> str:
    """Same, as a plain path for tasks that use the file system directly."""
    parts = urlparse(new_location(spark, name))
    if parts.scheme not in ("", "file"):
        raise RuntimeError(f"{SETTING} must be a mounted file system for tree work")
    return parts.path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once, read back: one pass over the source however often it is used."""
    path = new_location(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal out an input that has fewer partitions than there are cores.

    Only a small input is ever moved: at most one scan partition per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
