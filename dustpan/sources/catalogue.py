"""Inventories kept per session and device, so later questions need no rescan.

Writing a session again replaces it.  Sessions and devices are text, also where
they look like numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _read(spark: SparkSession, folder: str) -> DataFrame:
    """The table with its folder columns as text: '007' stays '007'."""
    found = spark.read.parquet(folder).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("session_id", "device") else f for f in found])
    return spark.read.schema(schema).parquet(folder)


def _write(rows: DataFrame, folder: str, *parts: str) -> None:
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(folder))


def write_catalogue(inventory: DataFrame, folder: str, session_id: str) -> None:
    """Write one session's inventory, partitioned by session and device."""
    # Rebalanced by device so that a large device is split, a small one is one file.
    _write(inventory.withColumn("session_id", F.lit(session_id)).hint("rebalance", "device"), folder, "session_id", "device")


def read_catalogue(spark: SparkSession, folder: str, session_id: str | None = None,
                   device: str | None = None) -> DataFrame:
    """Filters on session and device select folders before any file is opened."""
    rows = _read(spark, folder)
    if session_id is not None:
        rows = rows.where(F.col("session_id") == session_id)
    if device is not None:
        rows = rows.where(F.col("device") == device)
    return rows


def write_devices(devices: DataFrame, folder: str, session_id: str) -> None:
    """Write the devices (mount, device, device_type) a session works on."""
    _write(devices.withColumn("session_id", F.lit(session_id)), folder, "session_id")


def read_devices(spark: SparkSession, folder: str, session_id: str) -> DataFrame:
    return _read(spark, folder).where(F.col("session_id") == session_id)


def catalogue_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status, size_before, size_after): what two sessions' inventories differ in, and what they share.

    'added' and 'gone' paths are in one of them only; 'changed' ones differ in
    size or time of modification; the others are the 'same'.
    """
    side = lambda rows, name: rows.select(
        "path", F.struct("size", "mtime").alias(name)).dropDuplicates(["path"])
    both = side(before, "b").join(side(after, "a"), "path", "full_outer")
    status = (F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "gone")
              .when(F.col("b").eqNullSafe(F.col("a")), "same").otherwise("changed"))
    return both.select("path", status.alias("status"), F.col("b.size").alias("size_before"), F.col("a.size").alias("size_after"))
