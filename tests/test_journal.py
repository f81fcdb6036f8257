"""Jobs that break off and are taken up again, audit and catalogue of whole jobs, equal slices, staged digests."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from dustpan.functions import hashing
from dustpan.operators import actions, journal
from dustpan.operators.journal import Journal
from dustpan.plans import ordered, pipelines
from dustpan.sources import audit, catalogue, lister
from tests.test_trees import active, roots


def files_of(spark, folder):
    return spark.createDataFrame([(str(p), "file") for p in sorted(folder.iterdir())], "path string, entry_type string")


def broken_after(limit, done):
    """Deletes, but takes the task down once so many files are gone."""
    def action(path):
        if len(os.listdir(done)) <= limit:
            raise RuntimeError("lost")
        os.unlink(path)
        return "deleted"
    return action


def remove(path):
    try:
        os.unlink(path)
    except FileNotFoundError:
        return "absent"
    return "deleted"


def test_a_broken_job_goes_on(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    for n in range(60):
        (data / f"f{n:02}").touch()
    items, folder = files_of(spark, data), str(tmp_path / "journal")
    with pytest.raises(Exception, match="lost"):
        Journal(spark, folder).act("go", lambda: items, broken_after(35, data))
    left = len(os.listdir(data))
    assert 0 < left < 60
    results = Journal(spark, folder).act("go", lambda: items, remove).collect()
    assert len(results) == 60 == len({r["path"] for r in results})
    assert {r["outcome"] for r in results} == {"deleted"} and all(r["ts"] for r in results) and not os.listdir(data)
    again = Journal(spark, folder).act("go", lambda: items, broken_after(10**9, data)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, results))


def test_outcomes_that_were_not_noted(spark, tmp_path):
    """An item gone before its line was written counts as this job's work; one absent from the start does not."""
    data = tmp_path / "data"
    data.mkdir()
    (data / "a").touch()
    items = spark.createDataFrame([(str(data / "a"), "file"), (str(data / "b"), "file")], "path string, entry_type string")
    kept = Journal(spark, str(tmp_path / "journal"))
    with pytest.raises(Exception, match="stop"):
        def stop(path):
            remove(path)
            raise RuntimeError("stop")
        kept.act("go", lambda: items, stop)
    got = {r["path"][-1]: r["outcome"] for r in kept.act("go", lambda: items, remove).collect()}
    assert got == {"a": "deleted", "b": "absent"}


def test_deleting_a_tree_in_two_attempts(spark, tmp_path, monkeypatch):
    top = tmp_path / "data"
    for n in range(6):
        (top / f"d{n}" / "x" / "y").mkdir(parents=True)
        for k in range(5):
            (top / f"d{n}" / "x" / f"f{k}").touch()
    items = spark.createDataFrame([(str(top / f"d{n}"), "dir") for n in range(6)], "path string, entry_type string")
    session = pipelines.Session("007", audit=str(tmp_path / "audit"), journal=str(tmp_path / "journal"))
    with monkeypatch.context() as patch:
        patch.setattr(actions, "_remove_file", broken_after(-1, top / "d3" / "x"))
        patch.setattr(actions, "_remove_empty", lambda path: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            pipelines.delete_chosen(items, items, False, session)
    assert top.exists() and os.listdir(top)
    results = pipelines.delete_chosen(items, items, False, session).collect()
    assert {r["outcome"] for r in results} == {"deleted"} and len(results) == 6 and not os.listdir(top)
    for _ in range(2):
        pipelines.delete_chosen(items, items, False, session)
    told = audit.read_audit(spark, session.audit).collect()
    assert sorted(r["path"] for r in told) == sorted(str(top / f"d{n}") for n in range(6))
    assert {(r["session_id"], r["kind"]) for r in told} == {("007", "deleted_dir")} and all(r["ts"] for r in told)


def test_jobs_tell_what_they_did(spark, tmp_path):
    top = tmp_path / "data"
    (top / "a" / "b" / "c").mkdir(parents=True)
    (top / "e").mkdir()
    (top / "f").write_text("x")
    session = pipelines.Session("s", audit=str(tmp_path / "audit"))
    given = roots(spark, top, tmp_path / "missing")
    pipelines.find_empty_dirs(given, session)
    pipelines.purge_empty_dirs(given, dry_run=True, session=session)
    told = sorted((r["kind"], r["path"].rpartition("/")[2]) for r in audit.read_audit(spark, session.audit).collect())
    assert told == [("empty", "c"), ("empty", "e"), ("unscanned", "missing")]
    pipelines.purge_empty_dirs(given, dry_run=False, session=session)
    told = sorted((r["kind"], r["path"].rpartition("/")[2]) for r in audit.read_audit(spark, session.audit).where("kind = 'purged_dir'").collect())
    assert told == [("purged_dir", n) for n in "abce"]
    lines = audit.read_audit(spark, session.audit).select(
        audit.audit_line(F.col("ts"), F.col("kind"), F.col("path"), F.col("error")).alias("line"))
    assert audit.parse_audit(lines).where("kind = 'other'").count() == 0


def test_second_session_reads_only_what_changed(spark, tmp_path):
    top = tmp_path / "data"
    top.mkdir()
    for name, text in (("a", "same"), ("b", "same"), ("c", "diff"), ("d", "long text")):
        (top / name).write_text(text)
    one = pipelines.Session("1", catalogue=str(tmp_path / "catalogue"))
    pipelines.find_duplicates(roots(spark, top), active(spark), session=one)
    (top / "e").write_text("same")
    (top / "c").unlink()
    (top / "b").write_text("SAME")
    os.utime(top / "b", (1, 1))
    two = one._replace(session_id="2")
    plan = pipelines.find_duplicates(roots(spark, top), active(spark), session=two, since="1")
    assert sorted((r["path"][-1], r["action"]) for r in plan.collect()) == [("a", "KEEP"), ("e", "DELETE")]
    before, after = (catalogue.read_catalogue(spark, one.catalogue, s) for s in "12")
    got = {r["path"][-1]: r["status"] for r in catalogue.catalogue_changes(before, after).collect()}
    assert got == {"a": "same", "b": "changed", "c": "gone", "d": "same", "e": "added"}
    known = catalogue.read_catalogue(spark, one.catalogue, "1")
    hashed = pipelines.hashed_files(pipelines.scan(roots(spark, top)), active(spark), known=known)
    assert {r["path"][-1]: r["read"] for r in hashed.collect()} == {"a": 0, "b": 4, "e": 4}


@pytest.mark.parametrize("tasks", [1, 7, 8])
def test_slices_have_equal_weight(spark, tasks):
    """A device with most of the bytes, small files and larger ones."""
    rows = [("hdd" if n % 10 else f"d{n % 30}", f"/p{n:05}", 1 + (n * 7919) % 5000) for n in range(3000)]
    df = spark.createDataFrame(rows, "device string, path string, size bigint")
    running = ordered.with_running(df, [], [F.col("device"), F.col("path")], {"upto": F.col("size")})
    total = sum(r[2] for r in rows)
    dealt = ordered.sliced(running, [F.col("device"), F.col("path")], "upto", "size", total, tasks)
    assert dealt.rdd.getNumPartitions() == tasks
    parts = dealt.select("device", "path", "size").rdd.glom().collect()
    sums = [sum(r["size"] for r in p) for p in parts]
    assert sum(sums) == total and max(sums) <= 1.05 * total / tasks
    assert [(r["device"], r["path"]) for p in parts for r in p] == sorted((d, p) for d, p, _ in rows)


def test_items_are_dealt_by_device_deepest_first(spark, monkeypatch):
    monkeypatch.setattr(journal, "ITEMS_PER_TASK", 10)
    rows = [(f"dev{n % 3}", "/" + "/".join(["x"] * (n % 5)) + f"/{n}", "dir", True) for n in range(500)]
    df = spark.createDataFrame(rows, "device string, path string, entry_type string, present boolean")
    parts = journal.in_order(df).rdd.glom().collect()
    got = [(r["device"], -r["path"].count("/"), r["path"]) for p in parts for r in p]
    assert got == sorted(got) and len(got) == 500 and max(map(len, parts)) <= 1.3 * 500 / len(parts)


def test_numbering_reads_its_input_once(spark, tmp_path):
    spark.createDataFrame([(n, f"/{n}") for n in range(100)], "ord bigint, path string").write.parquet(str(tmp_path / "t"))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for rows in batches:
            read.add(len(rows))
            yield rows

    rows = spark.read.parquet(str(tmp_path / "t")).mapInPandas(count, "ord bigint, path string")
    assert ordered.with_row_number(rows, [], [F.col("ord")]).where("seq = ord + 1").count() == 100
    assert read.value == 100


def test_digests_in_stages(spark, tmp_path):
    """Files of one size are read whole only if their ends agree; larger ones by ranges."""
    body = os.urandom(5000)
    content = {"twin1": body, "twin2": body, "middle": body[:2500] + b"?" + body[2501:], "head": b"?" + body[1:],
               "tail": body[:-1] + b"?", "small1": b"s" * 150, "small2": b"s" * 150, "small3": b"t" * 150, "empty": b"", "other": body + b"!"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    rows = [(str(tmp_path / n), len(d)) for n, d in content.items()] + [(str(tmp_path / "gone"), 5000)]
    files = spark.createDataFrame(rows, "path string, size bigint")
    got = {r["path"].rpartition("/")[2]: r for r in hashing.staged_hashes(files, probe=100, span=10**6).collect()}
    whole = {n: hashlib.sha256(d).hexdigest() for n, d in content.items()}
    assert {n: r["hash"] for n, r in got.items() if r["hash"]} == {
        n: whole[n] for n in ("twin1", "twin2", "middle", "small1", "small2", "small3", "empty")}
    assert {n: r["read"] for n, r in got.items()} == {
        "twin1": 5200, "twin2": 5200, "middle": 5200, "head": 200, "tail": 200, "other": 200, "small1": 150, "small2": 150,
        "small3": 150, "empty": 0, "gone": 0}
    assert "FileNotFoundError" in got["gone"]["hash_error"]
    tree = {r["path"].rpartition("/")[2]: r["hash"] for r in hashing.staged_hashes(files, probe=100, span=1024).collect()}
    parts = "".join(hashlib.sha256(body[at:at + 1024]).hexdigest() for at in range(0, 5000, 1024))
    assert tree["twin1"] == tree["twin2"] == "tree:" + hashlib.sha256(parts.encode()).hexdigest() != tree["middle"]
    forced = hashing.staged_hashes(files, probe=100, whole_sizes=files.where("path LIKE '%other'").select("size")).collect()
    assert {r["path"].rpartition("/")[2]: r["hash"] for r in forced}["other"] == whole["other"]


def test_listing_tells_creation_where_it_is_known(spark, tmp_path):
    (tmp_path / "f").touch()
    row = lister.list_entries(roots(spark, tmp_path)).first()
    known = getattr(os.stat(tmp_path / "f"), "st_birthtime", None)
    assert (row["created"] is None) == (known is None)
