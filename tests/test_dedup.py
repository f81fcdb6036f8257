"""Invariants of keep/delete plans, one content holding most of the files."""

import random

import pytest
from pyspark.sql import functions as F

from dustpan.operators import dedup, profile, retention
from dustpan.plans.ordered import with_row_number


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for n in range(3000):
        content = "hot" if rng.random() < 0.4 else f"h{rng.randint(0, 900)}"
        rows.append((content, n, f"/d{n % 7}/f{n}", f"dev{rng.choice('001234')}", 0 if content == "hot" else 10))
    return spark.createDataFrame(rows, "hash string, ord bigint, path string, device string, size bigint").cache()


@pytest.mark.parametrize("policy", dedup.POLICIES)
def test_no_group_loses_all_copies(spark, skewed, policy):
    everything = skewed.selectExpr("path", "'DELETE' AS action")
    plan = dedup.dup_plan(skewed, policy, device="dev3", manual=everything).collect()
    size = {r["hash"]: r["count"] for r in skewed.groupBy("hash").count().where("count > 1").collect()}
    kept, seen = {}, {}
    for r in plan:
        seen[r["hash"]] = seen.get(r["hash"], 0) + 1
        kept[r["hash"]] = kept.get(r["hash"], 0) + (r["action"] == "KEEP")
    assert seen == size
    assert all(kept.values())
    if policy in ("keep_first", "manual"):
        assert set(kept.values()) == {1}
    if policy == "keep_all":
        assert kept == size


def test_unknown_policy(skewed):
    with pytest.raises(ValueError):
        dedup.dup_plan(skewed, "keep_last")


def test_empty_files_can_be_left_out(skewed):
    assert dedup.duplicate_groups(skewed).where("hash = 'hot'").count() == 1
    assert dedup.duplicate_groups(skewed, include_empty=False).where("hash = 'hot'").count() == 0


def test_running_numbers_of_a_hot_group(skewed):
    got = {}
    for r in with_row_number(skewed, ["hash"], [F.col("ord").desc()]).collect():
        got.setdefault(r["hash"], []).append((r["seq"], r["ord"]))
    for pairs in got.values():
        pairs.sort()
        assert [p[0] for p in pairs] == list(range(1, len(pairs) + 1))
        assert [p[1] for p in pairs] == sorted((p[1] for p in pairs), reverse=True)


def test_batches_are_bounded(skewed):
    batches = {}
    for r in profile.size_batches(skewed, max_files=50, max_bytes=200).collect():
        batches.setdefault((r["device"], r["batch"]), []).append(r["size"])
    assert all(len(b) <= 50 and sum(b[:-1]) <= 200 + 10 for b in batches.values())


def test_newest_are_kept(spark):
    rows = [("k", f"/p{n}", n) for n in range(10)] + [("j", "/q", 1)]
    df = spark.createDataFrame(rows, "key string, path string, n int").selectExpr(
        "key", "path", "timestamp_seconds(n) AS mtime")
    kept = {r["path"] for r in retention.retain_newest(df, "key").where("action = 'KEEP'").collect()}
    assert kept == {"/p9", "/p8", "/p7", "/q"}
