"""End-to-end jobs over real trees, composed of the operators.

A job that is given a ``Session`` leaves its events in the session's audit
trail, keeps its inventory in the catalogue, and can be taken up again from
its journal.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustpan.functions.hashing import staged_hashes
from dustpan.operators import actions, dedup, emptydirs, residuals
from dustpan.operators.journal import Journal
from dustpan.operators.profile import with_device
from dustpan.operators.roots import kept_roots, normalize_roots, union_roots
from dustpan.sources import audit, catalogue
from dustpan.sources.lister import list_entries, regular_files
from dustpan.storage import materialize


class Session(NamedTuple):
    """Where a session's jobs leave what they did; folders that are not given are not written."""
    session_id: str
    audit: str | None = None
    catalogue: str | None = None
    journal: str | None = None  # a mounted folder

    def tell(self, job: str, rows: DataFrame) -> None:
        """Audit rows (kind, path, error and, if known, ts) of a job; told again, they are told once."""
        if self.audit:
            if "ts" not in rows.columns:
                rows = rows.withColumn("ts", F.current_timestamp().cast("timestamp_ntz"))
            audit.write_audit(rows, self.audit, self.session_id, job)

    def journal_of(self, rows: DataFrame, job: str) -> Journal:
        return Journal(rows.sparkSession, f"{self.journal}/{self.session_id}/{job}" if self.journal else None)


NOWHERE = Session("")


def scan(roots: DataFrame, session: Session = NOWHERE) -> DataFrame:
    """Inventory of the cleaned roots: one row per path, however roots overlap.

    A root below another is only left to the outer scan if that got there; it
    does not where a link leads to the inner root, or the way cannot be read.
    """
    normal = materialize(normalize_roots(roots), "roots")
    found = list_entries(kept_roots(normal))
    reached = found.where("entry_type = 'dir' AND error IS NULL").select(F.col("path").alias("root"))
    missed = materialize(normal.where("status = 'nested'").select("root_idx", "root").join(reached, "root", "left_anti"), "missed")
    if not missed.isEmpty():
        found = union_roots(found, list_entries(missed.select("root_idx", "root"))).select(*found.columns)
    folder = F.col("entry_type").isin("dir", "root")
    session.tell("scan", found.where("error IS NOT NULL").select(
        F.when(folder, "unscanned").otherwise("unreadable").alias("kind"), "path", "error"))
    return found


def hashed_files(inventory: DataFrame, patterns: DataFrame, only_candidates: bool = True,
                 algorithm: str = "sha256", mounts: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Digests of the files that can have copies; leftovers are not hashed.

    ``mounts`` (mount, device, device_type) tells the device of each file;
    without it every root counts as a device.  ``known`` (path, size, mtime,
    hash) are files hashed before: those that did not change are not read.
    With ``only_candidates`` files without an equal have no hash.
    """
    files = residuals.non_residual(regular_files(inventory), patterns)
    if only_candidates:
        files = dedup.size_candidates(files)
    files = with_device(files, mounts) if mounts is not None else files.withColumn("device", F.col("root_idx").cast("string"))
    rows = materialize(files.select(F.struct("root_idx", "path").alias("ord"), "path", "name", "size", "mtime", "device"), "to_hash")
    if known is None:
        return materialize(_digested(rows, only_candidates, algorithm, None), "hashed")
    same = known.select("path", "size", "mtime", "hash").where("hash IS NOT NULL").dropDuplicates(["path"])
    kept = materialize(rows.join(same, ["path", "size", "mtime"]), "unchanged")
    fresh = _digested(rows.join(kept.select("path"), "path", "left_anti"), only_candidates, algorithm, kept.select("size"))
    old = kept.select(*rows.columns, "hash", F.lit(None).cast("string").alias("hash_error"), F.lit(0).cast("bigint").alias("read"))
    return materialize(fresh.unionByName(old), "hashed")


def _digested(rows: DataFrame, only_candidates: bool, algorithm: str, whole_sizes: DataFrame | None) -> DataFrame:
    return staged_hashes(rows, algorithm, whole_sizes=whole_sizes if only_candidates else rows.select("size"))


def hash_ledger(hashed: DataFrame) -> DataFrame:
    """Files that could be listed but not read."""
    return hashed.where(F.col("hash_error").isNotNull()).select(
        "path", F.lit("file").alias("entry_type"), F.col("hash_error").alias("error"))


def find_duplicates(roots: DataFrame, patterns: DataFrame, policy: str = "keep_first",
                    mounts: DataFrame | None = None, session: Session = NOWHERE, since: str | None = None,
                    **options) -> DataFrame:
    """Reviewable keep/delete plan for the trees below the roots.

    With a catalogue in the session, its inventory is kept there; files that
    have not changed ``since`` an earlier session keep their digests.
    """
    spark = roots.sparkSession
    inventory = scan(roots, session)
    known = catalogue.read_catalogue(spark, session.catalogue, since) if since and session.catalogue else None
    hashed = hashed_files(inventory, patterns, mounts=mounts, known=known)
    session.tell("hash", hash_ledger(hashed).select(F.lit("unhashed").alias("kind"), "path", "error"))
    if session.catalogue:
        digests = hashed.select("path", "hash")
        rows = regular_files(inventory).select(
            F.col("root_idx").cast("string").alias("device"), "path", "parent", "name", "size", "mtime", "created")
        catalogue.write_catalogue(rows.join(digests, "path", "left"), session.catalogue, session.session_id)
    return dedup.dup_plan(hashed.where("hash IS NOT NULL"), policy, **options)


def find_residuals(roots: DataFrame, patterns: DataFrame, session: Session = NOWHERE) -> DataFrame:
    return residuals.residual_matches(scan(roots, session), patterns)


def delete_chosen(report: DataFrame, chosen: DataFrame, dry_run: bool = True, session: Session = NOWHERE) -> DataFrame:
    """Carry out a selection of report rows (path, entry_type); returns the results."""
    picked = actions.apply_selection(report.select("path", "entry_type"), chosen)
    results = actions.apply_deletes(actions.effective_delete_roots(picked), dry_run, session.journal_of(report, "delete"))
    session.tell("delete", actions.audit_rows(results))
    return results


def find_empty_dirs(roots: DataFrame, session: Session = NOWHERE) -> DataFrame:
    found = emptydirs.leaf_empty_dirs(scan(roots, session), include_links=True)
    session.tell("empty", found.select(F.lit("empty").alias("kind"), "path", F.lit(None).cast("string").alias("error")))
    return found


def purge_empty_dirs(roots: DataFrame, selected: DataFrame | None = None, scope: str = "roots",
                     dry_run: bool = True, session: Session = NOWHERE) -> DataFrame:
    """Plan on one scan, re-check on a second, remove round by round."""
    journal = session.journal_of(roots, "purge")

    def plan() -> DataFrame:
        found = materialize(emptydirs.cascade_empty_dirs(scan(roots, session), roots, selected, scope), "plan")
        return actions.revalidate_plan(found, scan(roots))

    fixed = plan() if dry_run else journal.fixed("plan", plan)
    results = actions.apply_purge(fixed, dry_run, journal)
    session.tell("purge", actions.audit_rows(results, "purged_dir"))
    return results


def quarantine_and_purge(roots: DataFrame, session_id: str, dry_run: bool = True, session: Session = NOWHERE) -> DataFrame:
    """Rename leaf-empty directories, then remove them; one status row per directory."""
    plan = lambda: emptydirs.quarantine_plan(scan(roots, session), roots, session_id)
    if dry_run:
        names = materialize(plan(), "plan").select(F.col("quarantine_path").alias("path"))
        return emptydirs.purge_status(names, names)
    journal = session.journal_of(roots, "quarantine")
    renamed = actions.apply_quarantine(journal.fixed("plan", plan), False, journal)
    moved = renamed.where(F.col("outcome") == "renamed")
    removed = actions.remove_quarantined(moved, False, journal)
    told = renamed.where("outcome = 'renamed'").select("ts", F.lit("renamed").alias("kind"), "path", "error")
    failed = actions.audit_rows(renamed.withColumn("entry_type", F.lit("dir")).where("outcome = 'failed'"))
    session.tell("quarantine", told.unionByName(failed).unionByName(actions.audit_rows(removed, "purged_dir")))
    return emptydirs.purge_status(moved.select(F.col("quarantine_path").alias("path")),
                                  removed.where(F.col("outcome") == "deleted"))
