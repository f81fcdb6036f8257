"""Files of identical content: groups, summaries and keep/delete plans.

Ranks come from ``min`` aggregates joined back, not from windows: a window
would sort a hot content group in one task, an aggregate is combined before
the shuffle and the join is split by adaptive execution.  The minimum is taken
of ``ord`` alone (unique per file): a fixed-width minimum is a hash aggregate,
one of a path or structure has to sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("keep_all", "keep_device", "keep_first", "keep_same_device",
            "keep_one_per_device", "manual")


def size_candidates(files: DataFrame) -> DataFrame:
    """Files whose size occurs more than once: only these can have copies."""
    shared = files.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    return files.join(shared, "size", "left_semi")


def _counted(hashed: DataFrame, include_empty: bool) -> DataFrame:
    """Files that can be compared: one that could not be read is nobody's copy."""
    readable = hashed.where("hash IS NOT NULL")
    return readable if include_empty else readable.where("size > 0")


def duplicate_groups(hashed: DataFrame, include_empty: bool = True) -> DataFrame:
    """One row per content held by two or more files, with its first copy."""
    rows = _counted(hashed, include_empty)
    groups = (rows.groupBy("hash")
              .agg(F.count("*").alias("copies"), F.max("size").alias("size"), F.min("ord").alias("ord"))
              .where("copies > 1"))
    return groups.join(rows.select("hash", "ord", "path"), ["hash", "ord"]).select(
        "hash", "copies", "size", F.col("ord").alias("first_ord"), F.col("path").alias("first_path"),
        ((F.col("copies") - 1) * F.col("size")).alias("redundant_bytes"))


def duplicate_members(hashed: DataFrame, include_empty: bool = True) -> DataFrame:
    """Every file of every group, as rows: a group may be too large for one cell."""
    groups = duplicate_groups(hashed, include_empty).select("hash", "copies")
    return hashed.select("hash", "ord", "path").join(groups, "hash")


def same_name_duplicates(hashed: DataFrame) -> DataFrame:
    """Groups that agree on content and on file name."""
    rows = _counted(hashed, True)
    groups = (rows.groupBy("hash", "name").agg(F.count("*").alias("copies"), F.min("ord").alias("ord"))
              .where("copies > 1"))
    return groups.join(rows.select("hash", "ord", "path"), ["hash", "ord"]).select(
        "hash", "name", "copies", F.col("path").alias("first_path"))


def duplicate_summary(hashed: DataFrame) -> DataFrame:
    groups = (_counted(hashed, True).groupBy("hash")
              .agg(F.count("*").alias("copies"), F.max("size").alias("size")).where("copies > 1"))
    return groups.agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("redundant_files"),
        F.coalesce(F.sum((F.col("copies") - 1) * F.col("size")), F.lit(0)).alias("redundant_bytes"))


def _labelled(rows: DataFrame, keep: Column) -> DataFrame:
    return rows.select("hash", F.substring("hash", 1, 16).alias("hash_prefix"), "ord", "path",
                       "device", "size", F.when(keep, "KEEP").otherwise("DELETE").alias("action"))


def _one_per_device(hashed: DataFrame) -> DataFrame:
    per_device = hashed.groupBy("hash", "device").agg(F.count("*").alias("n"), F.min("ord").alias("keeper"))
    shared = per_device.groupBy("hash").agg(F.sum("n").alias("copies")).where("copies > 1")
    keepers = per_device.join(shared, "hash", "left_semi").select(
        F.col("hash").alias("__hash"), F.col("device").alias("__device"), "keeper")
    # Files on no known device form a device of their own.
    rows = hashed.join(keepers, (F.col("hash") == F.col("__hash")) & F.col("device").eqNullSafe(F.col("__device")))
    return _labelled(rows, F.col("ord") == F.col("keeper"))


def _manual(hashed: DataFrame, manual: DataFrame) -> DataFrame:
    chosen = manual.groupBy("path").agg(F.min("action").alias("chosen"))
    groups = hashed.groupBy("hash").agg(
        F.count("*").alias("copies"), F.min("ord").alias("first")).where("copies > 1")
    rows = hashed.join(groups, "hash").join(chosen, "path", "left")
    is_first = F.col("ord") == F.col("first")
    keep = F.coalesce(F.col("chosen") == "KEEP", is_first)
    # A group none of whose files would stay keeps its first copy.
    safe = rows.where(keep).select("hash").distinct().withColumn("safe", F.lit(True))
    guarded = rows.join(safe, "hash", "left")
    return _labelled(guarded, keep | (F.col("safe").isNull() & is_first))


def dup_plan(hashed: DataFrame, policy: str = "keep_first", device: str | None = None,
             manual: DataFrame | None = None) -> DataFrame:
    """KEEP or DELETE for every file of a duplicate group; no group loses all copies.

    ``hashed``: hash, ord, path, device, size.  It is read more than once, so
    pass a written table where computing the hash is expensive.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; one of {', '.join(POLICIES)}")
    if policy == "keep_one_per_device":
        return _one_per_device(hashed)
    if policy == "manual":
        return _manual(hashed, manual)
    hashed = hashed.where("hash IS NOT NULL")
    on_device = F.coalesce(F.col("device") == F.lit(device), F.lit(False))
    facts = [F.count("*").alias("copies"), F.min("ord").alias("first")]
    if policy == "keep_device":
        facts.append(F.coalesce(F.max(on_device), F.lit(False)).alias("has_device"))
    if policy == "keep_same_device":
        facts.append(F.min_by("device", "ord").alias("first_device"))
    groups = hashed.groupBy("hash").agg(*facts).where("copies > 1")
    is_first = F.col("ord") == F.col("first")
    keep = {"keep_all": lambda: F.lit(True),
            "keep_first": lambda: is_first,
            "keep_device": lambda: F.when(F.col("has_device"), on_device).otherwise(is_first),
            "keep_same_device": lambda: F.col("device").eqNullSafe(F.col("first_device")) | is_first}[policy]()
    return _labelled(hashed.join(groups, "hash"), keep)


def select_deletable(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("action") == "DELETE").select("path", "size")
