"""From a reviewed plan to deletions, and back to a table of what happened."""

from __future__ import annotations

import errno
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustpan.functions.paths import depth_of, parent_of
from dustpan.operators.emptydirs import below
from dustpan.operators.journal import RESULTS, Journal, planned
from dustpan.operators.roots import ancestors_of
from dustpan.sources.lister import list_entries
from dustpan.storage import materialize


def apply_selection(report: DataFrame, chosen: DataFrame) -> DataFrame:
    return report.join(chosen.select("path").distinct(), "path", "left_semi")


def revalidate_plan(planned: DataFrame, fresh: DataFrame) -> DataFrame:
    """Planned directories that still exist and hold nothing but planned ones."""
    plan = planned.select("path").distinct()
    present = fresh.where(F.col("entry_type") == "dir").select("path").distinct()
    others = fresh.select("path").join(plan, "path", "left_anti")
    folders = others.select(parent_of("path").alias("path")).distinct()
    occupied = ancestors_of(folders).select(F.col("ancestor").alias("path")).distinct()
    return (planned.join(present, "path", "left_semi").join(occupied, "path", "left_anti"))


def _chosen_dirs(chosen: DataFrame) -> DataFrame:
    return chosen.where(F.col("entry_type") == "dir").select("path").distinct()


def deletion_closure(inventory: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every entry that goes when the chosen files and directories go."""
    folders = inventory.select(F.col("parent").alias("path")).distinct()
    gone = below(folders, _chosen_dirs(chosen), include_self=True).select(F.col("path").alias("parent"))
    inside = inventory.join(gone, "parent", "left_semi").select("path", "entry_type")
    named = inventory.join(chosen.select("path").distinct(), "path", "left_semi").select("path", "entry_type")
    return inside.unionByName(named).distinct()


def effective_delete_roots(chosen: DataFrame) -> DataFrame:
    """The choice without items that already go with a chosen directory above them."""
    rows = chosen.withColumn("__parent", parent_of("path"))
    folders = rows.select(F.col("__parent").alias("path")).distinct()
    covered = below(folders, _chosen_dirs(chosen), include_self=True).select(F.col("path").alias("__parent"))
    return rows.join(covered, "__parent", "left_anti").select("path", "entry_type").distinct()


def _remove_file(path: str) -> str:
    try:
        os.unlink(path)
    except FileNotFoundError:
        return "absent"
    return "deleted"


def _remove_named(path: str) -> str:
    """A file that was asked for by its own name; a link to a directory is neither file nor directory."""
    if os.path.islink(path) and os.path.isdir(path):
        raise OSError(errno.EPERM, "link to a directory")
    return _remove_file(path)


def _remove_empty(path: str) -> str:
    """Only a directory that is empty at this moment goes."""
    try:
        os.rmdir(path)
    except FileNotFoundError:
        return "absent"
    return "deleted"


def _with_links(items: DataFrame) -> DataFrame:
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(is_link=[os.path.islink(path) for path in rows["path"]])

    return items.select("path", "entry_type").mapInPandas(look, "path string, entry_type string, is_link boolean")


def _items(rows: DataFrame) -> DataFrame:
    """(path, entry_type and, if given, device) of distinct items."""
    columns = ["path", "entry_type", *(["device"] if "device" in rows.columns else [])]
    return rows.select(columns).distinct()


def apply_deletes(items: DataFrame, dry_run: bool = True, journal: Journal | None = None) -> DataFrame:
    """Delete files, and directories with all they hold; one result row per item.

    A directory is listed first; what it holds goes spread over all tasks,
    files and links before directories, and directories deepest first.  A
    ``device`` column deals the items by device.  With the ``journal`` of an
    attempt that broke off, the job goes on where it was.
    """
    if dry_run:
        return planned(materialize(_items(items), "items"))
    journal = journal or Journal(items.sparkSession)
    items = journal.fixed("items", lambda: _items(items))
    dirs = items.where(F.col("entry_type") == "dir")
    # A link to a directory is not followed: its target's files are not below it.
    tops = lambda: _with_links(dirs).where("not is_link").select(F.lit(0).alias("root_idx"), F.col("path").alias("root"))
    inside = journal.fixed("inside", lambda: list_entries(tops()).where("entry_type <> 'root'").select("path", "entry_type"))
    done = journal.act("below", lambda: inside.where("entry_type <> 'dir'").distinct(), _remove_file)
    done = done.unionByName(journal.act("named", lambda: items.where("entry_type <> 'dir'").join(inside, "path", "left_anti"), _remove_named))
    folders = journal.fixed("folders", lambda: inside.where("entry_type = 'dir'").unionByName(dirs.select("path", "entry_type"))
                            .distinct().withColumn("depth", depth_of("path")))
    for row in folders.select("depth").distinct().orderBy(F.desc("depth")).collect():  # levels of the trees
        level = folders.where(F.col("depth") == row["depth"])
        done = done.unionByName(journal.act(f"depth={row['depth']}", lambda level=level: level, _remove_empty))
    return done.join(items.select("path"), "path", "left_semi")


def apply_purge(cascade: DataFrame, dry_run: bool = True, journal: Journal | None = None) -> DataFrame:
    """Remove a cascade plan round by round, so children go before their parents."""
    rows = lambda: cascade.select("path", F.lit("dir").alias("entry_type"), "round")
    if dry_run:
        return planned(materialize(rows(), "cascade"))
    journal = journal or Journal(cascade.sparkSession)
    plan = journal.fixed("cascade", rows)
    results = cascade.sparkSession.createDataFrame([], RESULTS)
    for number in [r[0] for r in plan.select("round").distinct().orderBy("round").collect()]:  # levels of the deepest empty chain
        results = results.unionByName(journal.act(
            f"round={number}", lambda number=number: plan.where(F.col("round") == number), _remove_empty))
    return results


def _rename(pair: str) -> str:
    old, new = pair.split("\0")
    if os.path.isdir(new) and not os.path.exists(old):
        return "renamed"
    if not os.path.isdir(old):
        return "absent"
    if os.listdir(old):
        return "occupied"
    os.rename(old, new)
    return "renamed"


def apply_quarantine(plan: DataFrame, dry_run: bool = True, journal: Journal | None = None) -> DataFrame:
    """Rename still-empty directories to their quarantine names."""
    pairs = lambda: plan.select(
        F.concat("path", F.lit("\0"), "quarantine_path").alias("path"), F.lit("dir").alias("entry_type"))
    done = planned(pairs()) if dry_run else (journal or Journal(plan.sparkSession)).act("rename", pairs, _rename)
    both = F.split("path", "\0")
    return done.select(both[0].alias("path"), both[1].alias("quarantine_path"), "outcome", "error", "ts")


def remove_quarantined(renamed: DataFrame, dry_run: bool = True, journal: Journal | None = None) -> DataFrame:
    rows = lambda: renamed.select(F.col("quarantine_path").alias("path"), F.lit("dir").alias("entry_type"))
    return planned(rows()) if dry_run else (journal or Journal(renamed.sparkSession)).act("remove", rows, _remove_empty)


def audit_rows(results: DataFrame, deleted_dir: str = "deleted_dir") -> DataFrame:
    """Audit rows (ts, kind, path, error) of what was done or failed; absent and planned items are no events."""
    kind: Column = (F.when(F.col("outcome") == "failed", "failed")
                    .when((F.col("outcome") == "deleted") & (F.col("entry_type") == "dir"), deleted_dir)
                    .when(F.col("outcome") == "deleted", "deleted_file"))
    return results.select("ts", kind.alias("kind"), "path", "error").where("kind IS NOT NULL")


def deletion_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("outcome") == "deleted").alias("deleted"),
                       F.count_if(F.col("outcome") == "failed").alias("failed"))


def deletion_failures(results: DataFrame) -> DataFrame:
    return results.where(F.col("outcome") == "failed").select("path", "error")


def results_of_audit(audit: DataFrame) -> DataFrame:
    """Deletion results as told by parsed audit lines."""
    outcome = (F.when(F.col("kind").isin("deleted_file", "deleted_dir"), "deleted")
                .when(F.col("kind") == "failed", "failed"))
    kind = F.when(F.col("kind") == "deleted_dir", "dir").when(F.col("kind") == "deleted_file", "file")
    return audit.select("path", kind.alias("entry_type"), outcome.alias("outcome"), "error") \
                .where(F.col("outcome").isNotNull())


def unfinished(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Planned items without a successful deletion: failed, absent or never reached."""
    done = results.where(F.col("outcome") == "deleted").select("path").distinct()
    return planned.select("path").join(done, "path", "left_anti")
