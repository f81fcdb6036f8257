"""Checks against a manifest of expected digests, and newest-N retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed value: versions kept when the caller does not say.
KEEP = 3


def verify_checksums(hashed: DataFrame, expected: DataFrame) -> DataFrame:
    """Per path: ok, mismatch, missing (expected only), unexpected (found only) or unreadable (found without a digest)."""
    found = hashed.select("path", F.lower("hash").alias("actual"), F.lit(True).alias("is_found"))
    wanted = expected.select("path", F.lower("hash").alias("wanted"), F.lit(True).alias("is_wanted"))
    status = (F.when(F.col("is_found").isNull(), "missing").when(F.col("is_wanted").isNull(), "unexpected")
               .when(F.col("actual").isNull(), "unreadable")
               .when(F.col("actual").eqNullSafe(F.col("wanted")), "ok").otherwise("mismatch"))
    return found.join(wanted, "path", "full_outer").select("path", status.alias("status"))


def retain_newest(files: DataFrame, by: str, keep: int = KEEP) -> DataFrame:
    """KEEP for the newest ``keep`` per key, DELETE for the rest.

    The rank filter is applied per task before the shuffle (window group
    limit), so a key holding most rows ships at most ``keep`` per task; the
    rest is what does not join.
    """
    newest = W.partitionBy(by).orderBy(F.col("mtime").desc(), F.col("path"))
    kept = (files.select(by, "mtime", "path").withColumn("rank", F.row_number().over(newest))
            .where(F.col("rank") <= keep).select("path", F.lit(True).alias("stays")))
    return files.select(by, "path", "mtime").join(kept, "path", "left").select(
        by, "path", F.when(F.col("stays"), "KEEP").otherwise("DELETE").alias("action"))
