"""Real directory trees: listing, hashing, deleting, purging."""

import hashlib
import os

import pytest

from dustpan import fixtures as fx
from dustpan.functions.hashing import hash_files
from dustpan.operators import actions, emptydirs, residuals
from dustpan.plans import pipelines
from dustpan.sources import lister, patterns_csv

ODD_NAMES = ["new\nline", " blanks ", "x [Pattern: y]", "a[b", "é", "Thumbs.db"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for folder in ("_dir", ".dir", "full", "chain/1/2/3/4/5/6", "holds_link", "only_lock/.purge.lock", "empty"):
        (root / folder).mkdir(parents=True)
    (root / ".DS_Store").write_bytes(b"junk")
    (root / "_dir" / "file").write_bytes(b"same")
    (root / ".dir" / "file").write_bytes(b"same")
    (root / "full" / "zero1").touch()
    (root / "full" / "zero2").touch()
    (root / "full" / "other").write_bytes(b"diff")
    (root / "full" / "big").write_bytes(b"x" * 200_000)
    for n, name in enumerate(ODD_NAMES):
        (root / "full" / name).write_bytes(f"odd{n}".encode() * (n + 2))
    os.symlink(root / "full" / "big", root / "to_file")
    os.symlink(root / "empty", root / "to_empty_dir")
    os.symlink(root / "full", root / "to_dir")
    os.symlink(root / "nowhere", root / "broken")
    os.symlink(root / "nowhere", root / "holds_link" / "broken")
    return root


def roots(spark, *paths):
    return lister.roots_of(spark, [str(p) for p in paths])


def walk(root):
    found = {}
    for folder, dirs, files in os.walk(root):
        for name in dirs + files:
            path = os.path.join(folder, name)
            if os.path.islink(path) and not os.path.isfile(path):
                found[path] = ("link", None)
            elif os.path.isdir(path):
                found[path] = ("dir", None)
            else:
                found[path] = ("file", os.stat(path).st_size)
    return found


@pytest.mark.parametrize("budget", [0, 3, 100_000])
def test_listing_equals_walk(spark, tree, budget):
    """Whatever the work per round, every entry is listed exactly once."""
    rows = lister.list_entries(roots(spark, tree), budget=budget).collect()
    assert {r["path"]: (r["entry_type"], r["size"]) for r in rows} == walk(tree)
    assert len(rows) == len(walk(tree))
    targets = {r["name"]: r["link_target"] for r in rows if r["link_target"]}
    assert targets == {"to_file": "file", "to_empty_dir": "empty_dir", "to_dir": "dir", "broken": "broken"}
    assert all(r["path"] == r["parent"] + "/" + r["name"] for r in rows)
    assert all(r["mtime"] is not None for r in rows if r["link_target"] != "broken")


def test_missing_root_and_bad_name_are_reported(spark, tree):
    os.mkdir(os.fsencode(str(tree)) + b"/bad\xff")
    rows = lister.list_entries(roots(spark, tree, tree / "missing"))
    ledger = {r["path"].rpartition("/")[2]: r for r in lister.error_ledger(rows).collect()}
    assert ledger["missing"]["entry_type"] == "root" and "FileNotFoundError" in ledger["missing"]["error"]
    assert any("not valid text" in r["error"] for r in ledger.values())
    assert len(ledger) == 2


def test_overlapping_roots_do_not_make_copies(spark, tree):
    inventory = pipelines.scan(roots(spark, tree, tree / "full", str(tree) + "/", tree))
    assert inventory.count() == inventory.select("path").distinct().count() == len(walk(tree))


def test_hash_of_files(spark, tree):
    files = lister.list_files(roots(spark, tree)).select("path", "size")
    got = {r["path"]: r["hash"] for r in hash_files(files, chunk=1000).collect()}
    assert got == {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in got}
    assert str(tree / "to_file") in got and str(tree / "full" / "zero1") in got
    gone = spark.createDataFrame([(str(tree / "gone"), 1)], "path string, size bigint")
    row = hash_files(gone).first()
    assert row["hash"] is None and "FileNotFoundError" in row["hash_error"]


def active(spark):
    return patterns_csv.accept_patterns(fx.pattern_table(spark))


def test_find_and_delete_duplicates(spark, tree):
    plan = pipelines.find_duplicates(roots(spark, tree, tree / "full"), active(spark))
    actions_by_name = {r["path"][len(str(tree)):]: r["action"] for r in plan.collect()}
    assert actions_by_name == {"/.dir/file": "KEEP", "/_dir/file": "DELETE", "/full/big": "KEEP", "/to_file": "DELETE",
                               "/full/zero1": "KEEP", "/full/zero2": "DELETE"}
    report = plan.where("action = 'DELETE'").selectExpr("path", "'file' AS entry_type")
    dry = pipelines.delete_chosen(report, report)
    assert {r["outcome"] for r in dry.collect()} == {"planned"} and (tree / "_dir" / "file").exists()
    done = pipelines.delete_chosen(report, report, dry_run=False)
    assert tuple(actions.deletion_summary(done).first()) == (3, 0)
    assert not (tree / "_dir" / "file").exists() and (tree / ".dir" / "file").exists()
    assert not os.path.lexists(tree / "to_file") and (tree / "full" / "big").exists()
    again = actions.apply_deletes(report, dry_run=False)
    assert {r["outcome"] for r in again.collect()} == {"absent"}


def test_find_residuals(spark, tree):
    (tree / "._folder").mkdir()
    (tree / "._folder" / "._inner").touch()
    found = pipelines.find_residuals(roots(spark, tree), active(spark))
    names = {(r["path"].rpartition("/")[2], r["entry_type"], r["pid"]) for r in found.collect()}
    assert names == {("Thumbs.db", "file", 1), ("._folder", "dir", 0), ("._inner", "file", 0)}
    results = pipelines.delete_chosen(found, found, dry_run=False)
    assert results.count() == 2 and not (tree / "._folder").exists()


def test_deleting_a_link_to_a_directory_fails(spark, tree):
    item = spark.createDataFrame([(str(tree / "to_dir"), "link")], "path string, entry_type string")
    row = actions.apply_deletes(item, dry_run=False).first()
    assert row["outcome"] == "failed" and (tree / "full" / "big").exists()
    assert actions.deletion_failures(spark.createDataFrame([row])).count() == 1


def test_empty_directory_report(spark, tree):
    found = {r["path"][len(str(tree)):] for r in pipelines.find_empty_dirs(roots(spark, tree)).collect()}
    assert found == {"/empty", "/to_empty_dir", "/chain/1/2/3/4/5/6", "/only_lock/.purge.lock"}


def test_purge_removes_chains(spark, tree):
    top = roots(spark, tree)
    assert pipelines.purge_empty_dirs(top).where("outcome <> 'planned'").count() == 0
    results = pipelines.purge_empty_dirs(top, dry_run=False)
    assert results.count() == 10 and results.where("outcome <> 'deleted'").count() == 0
    assert not (tree / "chain").exists() and not (tree / "empty").exists() and not (tree / "only_lock").exists()
    assert (tree / "holds_link").exists() and tree.exists()


def test_purge_keeps_what_filled_up(spark, tree):
    plan = emptydirs.cascade_empty_dirs(pipelines.scan(roots(spark, tree)))
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    (tree / "chain" / "1" / "2" / "late").touch()
    results = {r["path"][len(str(tree)):]: r["outcome"] for r in actions.apply_purge(plan, dry_run=False).collect()}
    assert results["/chain/1/2/3/4/5/6"] == "deleted" and results["/chain/1/2"] == "failed"
    assert (tree / "chain" / "1" / "2" / "late").exists()


def test_quarantine(spark, tree):
    status = {r["path"][len(str(tree)):]: r["status"] for r in
              pipelines.quarantine_and_purge(roots(spark, tree), "s9", dry_run=False).collect()}
    assert set(status.values()) == {"removed"}
    assert {p.split(".purge.")[0] for p in status} == {"/empty", "/chain/1/2/3/4/5/6"}
    assert not (tree / "empty").exists() and (tree / "chain/1/2/3/4/5").exists()
    assert (tree / "only_lock" / ".purge.lock").exists()


def test_quarantine_skips_what_filled_up_and_can_repeat(spark, tree):
    plan = emptydirs.quarantine_plan(lister.list_entries(roots(spark, tree)), roots(spark, tree), "s9")
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    (tree / "empty" / "late").touch()
    first = {r["path"][len(str(tree)):]: r["outcome"] for r in actions.apply_quarantine(plan, False).collect()}
    assert first == {"/empty": "occupied", "/chain/1/2/3/4/5/6": "renamed"}
    again = {r["path"][len(str(tree)):]: r["outcome"] for r in actions.apply_quarantine(plan, False).collect()}
    assert again == first


def test_residual_files_are_not_hashed(spark, tree):
    hashed = pipelines.hashed_files(pipelines.scan(roots(spark, tree)), active(spark), only_candidates=False)
    assert hashed.where("name = 'Thumbs.db'").count() == 0
    assert residuals.non_residual(lister.list_files(roots(spark, tree)), active(spark)).count() == hashed.count()
