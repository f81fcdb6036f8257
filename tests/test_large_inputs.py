"""Work that follows the input, not its square, and figures beyond the range of a long."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from dustpan.operators import profile, roots
from dustpan.sources import lister


def test_estimate_of_a_job_beyond_long(spark):
    """Bytes left times seconds spent is 5e19 here, and the second total is no long itself."""
    rates = spark.range(40_000).select(F.lit(150).cast("long").alias("files"), F.lit(7_500_000).cast("long").alias("bytes"))
    for total in (2 * 10**13, 2 * 10**20):
        row = profile.completion_estimate(rates, 10**8, total).first()
        assert (row["files_done"], row["bytes_done"]) == (6_000_000, 300_000_000_000)
        assert row["eta_seconds"] == (total - 3 * 10**11) * 2_400_000 / (3 * 10**11)


def test_repeated_roots_do_not_repeat_entries(spark):
    """A root listed 1000 times is scanned once, under its first index; an unknown index still comes first."""
    entries = spark.createDataFrame([(f"/h/a/f{i}", "/h/a", "file") for i in range(50)] + [("/h/b", "/h", "dir"), ("/k/f", "/k", "file")],
                                    "path string, parent string, entry_type string")
    listed = spark.createDataFrame([(i + 7, "/h//" if i % 2 else "/h") for i in range(1000)] + [(3, "/h/a"), (None, "/k"), (1, "/k")],
                                   "root_idx long, root string")
    found = roots.found_under_roots(entries, listed)
    assert found.count() == 50 * 2 + 1 + 1
    got = {r["path"]: r["root_idx"] for r in roots.union_roots(found, found).collect()}
    assert got == {**{f"/h/a/f{i}": 3 for i in range(50)}, "/h/b": 7, "/k/f": None}


def test_written_texts_are_not_all_held_at_once(tmp_path):
    """A batch of 20 MB is written through strings of some of its texts."""
    texts = [f"{n:05}" * 2000 if n % 10 else None for n in range(2000)]
    rows = pa.RecordBatch.from_pydict({"path": [f"/d{n % 7}/{n}" for n in range(2000)] + ["/empty"],
                                       "entry_type": ["file"] * 2000 + ["dir"], "content": [*texts, None]})
    write = lister._writer(str(tmp_path))
    tracemalloc.start()
    assert [b.to_pydict() for b in write(iter([rows]))] == [{"written": [2001]}]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000
    assert all((tmp_path / f"d{n % 7}" / str(n)).read_text() == (t or "") for n, t in enumerate(texts))
    assert (tmp_path / "empty").is_dir()
