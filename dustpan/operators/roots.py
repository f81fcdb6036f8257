"""Scan roots: clean-up, attribution of paths, protection, union of scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustpan.functions.paths import as_ancestor, clean_path, parent_of, resolved_path, self_and_ancestors

# Fixed value: folder name of the purge lock, skipped wherever it occurs.
LOCK_NAME = ".purge.lock"


def ancestors_of(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, ancestor) for each distinct path, itself and '' (the top) included."""
    steps = F.array_union(F.array(F.lit("")), self_and_ancestors(path))
    return paths.select(path).distinct().select(path, F.explode(steps).alias("ancestor"))


def prefix_lookup(paths: DataFrame, keys: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Aggregate, per distinct path, over all keys that contain it."""
    return (ancestors_of(paths).join(keys, F.col("ancestor") == F.col(key))
            .groupBy("path").agg(*aggregates))


def normalize_roots(roots: DataFrame, existing_dirs: DataFrame | None = None) -> DataFrame:
    """(root_idx, root, status): kept, repeat, missing or nested below another root.

    '.' and '..' are resolved by name, '/' lies above every other root.
    """
    cleaned = roots.select("root_idx", resolved_path("root").alias("root"))
    first = cleaned.groupBy("root").agg(F.min("root_idx").alias("first_idx"))
    if existing_dirs is None:
        present = first.withColumn("present", F.lit(True))
    else:
        found = existing_dirs.select(F.col("path").alias("root")).distinct()
        present = first.join(found.withColumn("present", F.lit(True)), "root", "left")
    usable = present.where("present").select(F.col("root").alias("path"))
    above = usable.select(as_ancestor("path").alias("outer"))
    nested = (ancestors_of(usable).where("ancestor <> path AND path <> '/'")
              .join(above, F.col("ancestor") == F.col("outer"), "left_semi")
              .select(F.col("path").alias("root"), F.lit(True).alias("nested")).distinct())
    judged = present.join(nested, "root", "left")
    status = (F.when(F.col("root_idx") != F.col("first_idx"), "repeat")
               .when(F.col("present").isNull(), "missing")
               .when(F.col("nested"), "nested").otherwise("kept"))
    return cleaned.join(judged, "root").select("root_idx", "root", status.alias("status"))


def kept_roots(normalized: DataFrame) -> DataFrame:
    return normalized.where("status = 'kept'").select("root_idx", "root")


def attribute_to_root(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Add the index of the first listed root that is or contains the entry.

    Ancestors are expanded for distinct parents only, never per file.
    """
    listed = (roots.select(as_ancestor(clean_path("root")).alias("root"), F.col("root_idx").alias("idx"))
              .groupBy("root").agg(F.min("idx").alias("idx")))
    parents = entries.select(parent_of("path").alias("path"))
    above = prefix_lookup(parents, listed, "root", F.min("idx").alias("above_idx"))
    return (entries.drop("root_idx").withColumn("__parent", parent_of("path"))
            .join(above.withColumnRenamed("path", "__parent"), "__parent", "left")
            .join(listed.select(F.col("root").alias("path"), F.col("idx").alias("own_idx")),
                  "path", "left")
            .withColumn("root_idx", F.least("above_idx", "own_idx"))
            .drop("__parent", "above_idx", "own_idx"))


def found_under_roots(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per entry and containing root, as separate scans of each would list.

    A folder listed again is the same root: it is scanned once, under its first
    index.  So an entry has at most as many rows as it has ancestors, however
    long the list is.
    """
    # In a struct, as an unknown index comes first, like in ``union_roots``.
    listed = (roots.groupBy(as_ancestor(clean_path("root")).alias("root"))
              .agg(F.min(F.struct(F.col("root_idx").alias("idx")))["idx"].alias("idx")))
    parents = entries.select(F.col("parent").alias("path"))
    pairs = (ancestors_of(parents).join(listed, F.col("ancestor") == F.col("root"))
             .select(F.col("path").alias("parent"), F.col("idx").alias("root_idx")))
    return entries.drop("root_idx").join(pairs, "parent")


def union_roots(*scans: DataFrame) -> DataFrame:
    """Results of several scans, one row per path; the first root listing it wins."""
    rows = reduce(DataFrame.unionByName, scans)
    others = [c for c in rows.columns if c not in ("path", "root_idx")]
    return (rows.groupBy("path")
            .agg(F.min(F.struct("root_idx", *others)).alias("row"))
            .select("path", "row.*"))


def exclude_protected(dirs: DataFrame, roots: DataFrame, lock_name: str = LOCK_NAME) -> DataFrame:
    """Drop every root the user listed, dropped ones included, and lock folders."""
    listed = roots.select(clean_path("root").alias("path")).distinct()
    return dirs.where(F.col("name") != lock_name).join(listed, "path", "left_anti")
