"""Directories that are empty, or become empty once their empty children go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustpan.functions.paths import clean_path, depth_of, parent_of, self_and_ancestors
from dustpan.operators.roots import LOCK_NAME, ancestors_of, exclude_protected
from dustpan.plans.ordered import with_row_number


def _dirs(inventory: DataFrame) -> DataFrame:
    dirs = inventory.where(F.col("entry_type") == "dir")
    return dirs.where(F.col("error").isNull()) if "error" in inventory.columns else dirs


def leaf_empty_dirs(inventory: DataFrame, include_links: bool = False) -> DataFrame:
    """Directories no entry names as its parent.

    ``include_links`` adds links that lead to an empty directory, which a
    report shows but a purge never visits.
    """
    used = inventory.select(F.col("parent").alias("path")).distinct()
    columns = ["path", "parent", "name", "depth"]
    empty = _dirs(inventory).select(*columns).join(used, "path", "left_anti")
    if include_links:
        links = inventory.where((F.col("entry_type") == "link") & (F.col("link_target") == "empty_dir"))
        empty = empty.unionByName(links.select(*columns))
    return empty


def _blocked(inventory: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Directories with something below them that will stay."""
    held = inventory.where(F.col("entry_type") != "dir").select(F.col("parent").alias("path"))
    if "error" in inventory.columns:
        unreadable = (F.col("entry_type") == "dir") & F.col("error").isNotNull()
        held = held.unionByName(inventory.where(unreadable).select("path"))
    if roots is not None:
        held = held.unionByName(roots.select(clean_path("root").alias("path")))
    # Distinct folders first: ancestors are expanded per folder, never per file.
    return held.distinct().select(F.explode(self_and_ancestors("path")).alias("path")).distinct()


def below(paths: DataFrame, tops: DataFrame, include_self: bool) -> DataFrame:
    """Rows of ``paths`` that lie below one of ``tops`` (path)."""
    pairs = ancestors_of(paths)
    if not include_self:
        pairs = pairs.where("ancestor <> path")
    inside = pairs.join(tops.select(F.col("path").alias("ancestor")).distinct(), "ancestor", "left_semi")
    return paths.join(inside.select("path").distinct(), "path", "left_semi")


def cascade_empty_dirs(inventory: DataFrame, roots: DataFrame | None = None,
                       selected: DataFrame | None = None, scope: str = "roots",
                       max_rounds: int | None = None) -> DataFrame:
    """Directories a repeated purge removes, with the round each goes in.

    ``max_rounds`` leaves out what a purge stopped after so many would; there
    is no such limit unless asked for.

    Closed form of the fixpoint: a directory goes iff nothing that stays lies
    below it; its round is the height of its subtree.  ``scope='roots'`` purges
    all of it below the roots holding the selection, ``'selected'`` only the
    selected directories and what lies below them.
    """
    gone = _dirs(inventory).select("path").join(_blocked(inventory, roots), "path", "left_anti")
    heights = (gone.select("path", depth_of("path").alias("depth"),
                           F.explode(self_and_ancestors("path")).alias("top"))
               .groupBy(F.col("top").alias("path"))
               .agg(F.max("depth").alias("deepest"),
                    F.max(F.col("path") == F.col("top")).alias("is_gone"))
               .where("is_gone"))
    depth = depth_of("path")
    rounds = heights.select("path", depth.alias("depth"),
                            (F.col("deepest") - depth + 1).cast("bigint").alias("round"))
    if max_rounds is not None:
        rounds = rounds.where(F.col("round") <= max_rounds)
    if selected is None:
        return rounds
    if scope == "selected":
        return below(rounds, selected, include_self=True)
    holding = selected_roots(selected, roots)
    return below(rounds, holding, include_self=False)


def selected_roots(selected: DataFrame, roots: DataFrame) -> DataFrame:
    """The first listed root of each selected path."""
    listed = roots.select(clean_path("root").alias("root"), "root_idx")
    first = (ancestors_of(selected).join(listed, F.col("ancestor") == F.col("root"))
             .groupBy("path").agg(F.min(F.struct("root_idx", "root")).alias("first")))
    return first.select(F.col("first.root").alias("path")).distinct()


def purge_rounds(cascade: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Directories per round, with the total and the rounds run (the last finds none)."""
    run = F.max("round") + 1
    if max_rounds is not None:
        run = F.least(run, F.lit(max_rounds))
    per_round = cascade.groupBy("round").agg(F.count("*").alias("dirs"))
    # One row per level of the deepest empty chain from here on.
    overall = per_round.agg(F.sum("dirs").alias("total_dirs"),
                            run.cast("bigint").alias("rounds_run"),
                            F.collect_list(F.struct("round", "dirs")).alias("rows"))
    return overall.select(F.explode("rows").alias("r"), "total_dirs", "rounds_run").select(
        "r.round", "r.dirs", "total_dirs", "rounds_run")


def quarantine_plan(inventory: DataFrame, roots: DataFrame, session_id: str,
                    lock_name: str = LOCK_NAME) -> DataFrame:
    """New names for leaf-empty directories; the same session repeats the same names."""
    tag = F.substring(F.sha2(F.concat(F.lit(session_id), F.col("path")), 256), 1, 8)
    return exclude_protected(leaf_empty_dirs(inventory), roots, lock_name).select(
        "path", F.concat("path", F.lit(".purge."), tag).alias("quarantine_path"), "depth")


def deletion_order(items: DataFrame) -> DataFrame:
    """Position of each item on its device: deepest first, then by path."""
    rows = items.select("device", "path", depth_of("path").alias("depth"))
    return with_row_number(rows, ["device"], [F.col("depth").desc(), F.col("path")])


def purge_status(quarantined: DataFrame, removed: DataFrame) -> DataFrame:
    """One row per directory touched; removal outranks quarantine."""
    state = F.when(F.col("r"), "removed").otherwise("quarantined")
    return (quarantined.select("path", F.lit(True).alias("q"))
            .join(removed.select("path", F.lit(True).alias("r")), "path", "full_outer")
            .select("path", state.alias("status")))


def tree_report(status: DataFrame, root: str = "") -> DataFrame:
    """Indented lines relative to ``root``, shallow directories first."""
    start = len(root) + 2
    rel = F.substring(F.col("path"), F.lit(start), F.length("path"))
    parts = F.size(F.split(rel, "/"))
    return status.select(
        "path", "status", depth_of("path").alias("depth"),
        F.concat(F.repeat(F.lit("  "), parts - 1), "status", F.lit(": "), rel).alias("line")
    ).orderBy("depth", "path")


def affected_parents(changed: DataFrame) -> DataFrame:
    return changed.select(parent_of("path").alias("parent")).distinct()
