"""Arrivals in several batches: replay, repeats, equality with the batch result."""

from pathlib import Path

from dustpan import storage
from dustpan.operators import dedup
from dustpan.plans import registry
from dustpan.streaming import incremental

FILES = "hash string, ord bigint, path string, size bigint"


def run(spark, folder, per_batch=1):
    """Everything in the inbox, in order of file names, through the stream."""
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_batch).parquet(f"{folder}/inbox/*")
    query = incremental.watch_duplicates(stream, f"{folder}/index", f"{folder}/checkpoint")
    query.awaitTermination()
    return [p for p in query.recentProgress if p["numInputRows"]]


def arrive(spark, folder, number, rows):
    spark.createDataFrame(rows, FILES).coalesce(1).write.parquet(f"{folder}/inbox/{number:03}")


def statuses(spark, folder):
    return sorted((r["path"], r["hash"], r["status"]) for r in incremental.indexed_files(spark, f"{folder}/index").collect())


def test_statuses_across_batches(spark, tmp_path):
    arrive(spark, tmp_path, 0, [("x", 2, "/2", 5), ("x", 1, "/1", 5), ("y", 3, "/3", 5), (None, 9, "/9", 5)])
    run(spark, tmp_path)
    arrive(spark, tmp_path, 1, [("x", 0, "/0", 5), ("y", 3, "/3", 5), ("z", 5, "/5", 5), ("z", 5, "/5", 5), ("y", 1, "/1", 5)])
    run(spark, tmp_path)
    want = [("/0", "x", "duplicate"), ("/1", "x", "new"), ("/1", "y", "duplicate"), ("/2", "x", "duplicate"), ("/3", "y", "new"), ("/5", "z", "new")]
    assert statuses(spark, tmp_path) == want
    assert run(spark, tmp_path) == [] and statuses(spark, tmp_path) == want


def test_a_batch_run_again_writes_the_same(spark, tmp_path):
    for n in range(3):
        arrive(spark, tmp_path, n, [(f"h{(k * (n + 1)) % 5}", 100 * n + k, f"/{n}/{k}", 1) for k in range(12)])
    run(spark, tmp_path)
    before = statuses(spark, tmp_path)
    # As after a loss of the driver between writing the last part and noting it as done.
    for name in ("2", ".2.crc"):
        (Path(tmp_path) / "checkpoint" / "commits" / name).unlink()
    assert len(run(spark, tmp_path)) == 1
    assert statuses(spark, tmp_path) == before


def test_fifty_batches_cost_what_they_bring(spark, tmp_path):
    """A hot content, repeats, and 50 batches: work per batch does not follow what arrived before."""
    rows = [[(f"h{k % 7}" if k % 3 else "hot", 20 * n + k, f"/p{n}/{k}", 1) for k in range(15)]
            + [(f"u{n}.{k}", 20 * n + 15 + k, f"/u{n}/{k}", 1) for k in range(4)] for n in range(50)]
    for n, batch in enumerate(rows):
        again = rows[n - 1][:1] if n else []
        spark.createDataFrame(batch + again, FILES).coalesce(1).write.parquet(f"{tmp_path}/inbox/{n:03}")
    steps = run(spark, tmp_path)
    assert len(steps) == 50
    for n, step in enumerate(steps):
        assert step["numInputRows"] == len(rows[n]) + (1 if n else 0)
        assert all(op["numRowsUpdated"] <= step["numInputRows"] for op in step["stateOperators"])
    everything = spark.createDataFrame([r for batch in rows for r in batch], FILES)
    got = incremental.incremental_summary(incremental.indexed_files(spark, f"{tmp_path}/index"))
    want = dedup.duplicate_groups(everything).selectExpr("hash", "copies", "copies - 1 AS redundant_files")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_query_runs_in_many_batches(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(registry, "new_location", lambda *a: seen.append(storage.new_location(*a)) or seen[-1])
    registry.incremental_duplicates(spark, sf_dir).collect()
    index = next(path for path in seen if "/watch-" in path) + "/index"
    batches = [r[0] for r in incremental.indexed_files(spark, index).select("batch").distinct().collect()]
    assert len(batches) >= 8


def test_session_settings_are_given_back(spark):
    name = next(iter(incremental._STATE))
    before = spark.conf.get(name)
    with incremental._settings(spark, incremental._STATE):
        assert spark.conf.get(name) == incremental._STATE[name]
    assert spark.conf.get(name) == before


def test_state_partitions_follow_the_cores(spark, tmp_path):
    """Each is opened and committed in every batch, so 200 of them for a few rows are most of the work."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "200")
    try:
        arrive(spark, tmp_path, 0, [("x", 1, "/1", 5)])
        steps = run(spark, tmp_path)
        assert spark.conf.get(name) == "200"
    finally:
        spark.conf.set(name, before)
    for step in steps:
        assert all(op["numShufflePartitions"] <= spark.sparkContext.defaultParallelism for op in step["stateOperators"])


def test_a_hot_new_content_has_one_first_file(spark, tmp_path):
    """Spread over the files of one batch, repeats included, and known in the next."""
    for n in range(3):
        arrive(spark, tmp_path, n, [("hot", 1000 - 300 * n - k, f"/{n}/{k:03}", 1) for k in range(300)] + [("hot", 999, "/0/001", 1)])
    run(spark, tmp_path, per_batch=3)
    arrive(spark, tmp_path, 3, [("hot", 0, "/late", 1), ("hot", 1, "/2/000", 1), ("cold", 7, "/cold", 1)])
    run(spark, tmp_path)
    found = statuses(spark, tmp_path)
    assert len(found) == 902
    assert [f for f in found if f[2] == "new"] == [("/2/299", "hot", "new"), ("/cold", "cold", "new")]


def test_state_partitions_follow_the_cores(spark, tmp_path):
    """Each is opened and committed in every batch, so 200 of them for a few rows are most of the work."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "200")
    try:
        arrive(spark, tmp_path, 0, [("x", 1, "/1", 5)])
        steps = run(spark, tmp_path)
        assert spark.conf.get(name) == "200"
    finally:
        spark.conf.set(name, before)
    for step in steps:
        assert all(op["numShufflePartitions"] <= spark.sparkContext.defaultParallelism for op in step["stateOperators"])


def test_a_hot_new_content_has_one_first_file(spark, tmp_path):
    """Spread over the files of one batch, repeats included, and known in the next."""
    for n in range(3):
        arrive(spark, tmp_path, n, [("hot", 1000 - 300 * n - k, f"/{n}/{k:03}", 1) for k in range(300)] + [("hot", 999, "/0/001", 1)])
    run(spark, tmp_path, per_batch=3)
    arrive(spark, tmp_path, 3, [("hot", 0, "/late", 1), ("hot", 1, "/2/000", 1), ("cold", 7, "/cold", 1)])
    run(spark, tmp_path)
    found = statuses(spark, tmp_path)
    assert len(found) == 902
    assert [f for f in found if f[2] == "new"] == [("/2/299", "hot", "new"), ("/cold", "cold", "new")]
