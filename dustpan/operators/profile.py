"""How much there is, where it lies, and how long it may take."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustpan.operators.roots import prefix_lookup
from dustpan.plans.ordered import with_running

# Parameters' defaults: upper bounds in bytes of the size classes.
SIZE_CLASSES = (("tiny", 256), ("small", 1024), ("medium", 4096), ("large", 16384))
LARGEST_CLASS = "xxx-large"


def scan_summary(**counts: DataFrame) -> DataFrame:
    """One row of counts, one column per report, without joining the reports."""
    names = list(counts)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
             for name, df in counts.items()]
    return reduce(DataFrame.unionByName, parts).agg(
        *[F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name)
          for name in names])


def with_device(inventory: DataFrame, mounts: DataFrame) -> DataFrame:
    """Add device and its type from the longest mount that contains the file."""
    known = mounts.select(F.when(F.col("mount") == "/", "").otherwise(F.col("mount")).alias("mount"),
                          F.struct("device", "device_type").alias("dev"))
    folders = inventory.select(F.col("parent").alias("path"))
    found = prefix_lookup(folders, known, "mount", F.max_by("dev", F.length("mount")).alias("dev"))
    return (inventory.drop("device").join(found.withColumnRenamed("path", "parent"), "parent", "left")
            .withColumns({"device": F.col("dev.device"), "device_type": F.col("dev.device_type")})
            .drop("dev"))


def device_profile(inventory: DataFrame, root: str = "root") -> DataFrame:
    """Files and bytes per device and root, per device and overall.

    ``level`` is 0 for a device and root, 1 for a device, 3 overall, so totals
    differ from rows without a known device.
    """
    return (inventory.rollup("device", root)
            .agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("files"),
                 F.sum("size").cast("bigint").alias("bytes")))


def size_class_profile(files: DataFrame, classes=SIZE_CLASSES) -> DataFrame:
    fits = [F.when(F.col("size") < bound, F.lit(name)) for name, bound in classes]
    return (files.groupBy(F.coalesce(*fits, F.lit(LARGEST_CLASS)).alias("size_class"))
            .agg(F.count("*").alias("files"), F.sum("size").cast("bigint").alias("bytes")))


def throughput(work: DataFrame, every: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Files and bytes per second in each time window of (ts, bytes) rows."""
    per_window = (work.groupBy(F.window("ts", every).alias("w"))
                  .agg(F.count("*").alias("files"), F.sum("bytes").cast("bigint").alias("bytes")))
    return per_window.select(F.col("w.start").alias("window_start"), "files", "bytes",
                             (F.col("files") / seconds).alias("files_per_sec"),
                             (F.col("bytes") / seconds).alias("bytes_per_sec"))


def completion_estimate(rates: DataFrame, total_files: int, total_bytes: int,
                        seconds: int = 60) -> DataFrame:
    """Seconds still to go at the mean rate of the windows in which work was done.

    Work left times time spent passes the range of a long, so it is multiplied
    as doubles; the totals may be of any size.
    """
    done = rates.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"),
                     (F.count("*") * seconds).alias("spent"))

    def to_go(total: int, what: str) -> Column:
        left = F.greatest(F.lit(Decimal(total)) - F.col(what).cast("decimal(20,0)"), F.lit(0))
        return left.cast("double") * F.col("spent") / F.col(what)

    return done.select(
        F.col("files").alias("files_done"), F.col("bytes").alias("bytes_done"),
        F.greatest(to_go(total_files, "files"), to_go(total_bytes, "bytes")).alias("eta_seconds"))


def job_gate(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Totals against the limits of a session, as ok/warn flags."""
    total = files.agg(F.count("*").alias("files"),
                      F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))
    return total.select("files", "bytes",
                        F.when(F.col("files") > max_files, "warn").otherwise("ok").alias("files_flag"),
                        F.when(F.col("bytes") > max_bytes, "warn").otherwise("ok").alias("bytes_flag"))


def size_batches(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Number the work batches of each device in discovery order.

    A batch starts at most ``max_files`` files, and at most ``max_bytes`` bytes
    before its last file.
    """
    rows = files.select("device", "ord", "path", "size")
    running = with_running(rows, ["device"], [F.col("ord"), F.col("path")],
                           {"nth": F.lit(1), "so_far": F.col("size")})
    batch = F.expr(f"(so_far - size) div {int(max_bytes)} + (nth - 1) div {int(max_files)}")
    return running.select("device", "path", "size", batch.cast("bigint").alias("batch"))
