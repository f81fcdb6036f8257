"""The closed form of the purge against a round-by-round simulation."""

import random

import pytest

from dustpan.operators import actions, emptydirs

SCHEMA = "path string, parent string, name string, depth int, entry_type string, error string"


def entry(path, kind, error=None):
    return path, path.rpartition("/")[0], path.rpartition("/")[2], path.count("/"), kind, error


def random_tree(rng):
    dirs = [""]
    for n in range(rng.randint(20, 60)):
        dirs.append(f"{rng.choice(dirs)}/d{n}")
    files = {f"{rng.choice(dirs)}/f{n}" for n in range(rng.randint(2, 10))}
    return dirs[1:], files - {f for f in files if f.count("/") < 1}


def simulate(dirs, blockers, protected=(), limit=100):
    left, rounds = set(dirs), {}
    for number in range(1, limit + 1):
        holders = {p.rpartition("/")[0] for p in left | set(blockers)}
        gone = {d for d in left if d not in holders and d not in protected}
        if not gone:
            break
        rounds.update(dict.fromkeys(gone, number))
        left -= gone
    return rounds


@pytest.mark.parametrize("seed", range(5))
def test_cascade_equals_rounds(spark, seed):
    rng = random.Random(seed)
    dirs, files = random_tree(rng)
    roots = rng.sample(dirs, 3)
    rows = [entry(d, "dir") for d in dirs] + [entry(f, rng.choice(["file", "link", "other"])) for f in files]
    inventory = spark.createDataFrame(rows, SCHEMA)
    free = {r["path"]: r["round"] for r in emptydirs.cascade_empty_dirs(inventory).collect()}
    assert free == simulate(dirs, files)
    root_rows = spark.createDataFrame(list(enumerate(roots)), "root_idx int, root string")
    held = {r["path"]: r["round"] for r in emptydirs.cascade_empty_dirs(inventory, root_rows).collect()}
    assert held == simulate(dirs, files, set(roots))
    capped = emptydirs.cascade_empty_dirs(inventory, max_rounds=2)
    assert {r["path"]: r["round"] for r in capped.collect()} == simulate(dirs, files, limit=2)


def test_unreadable_directory_blocks(spark):
    rows = [entry("/a", "dir"), entry("/a/b", "dir"), entry("/a/b/c", "dir", "denied"), entry("/a/e", "dir")]
    inventory = spark.createDataFrame(rows, SCHEMA)
    assert [r["path"] for r in emptydirs.cascade_empty_dirs(inventory).collect()] == ["/a/e"]
    assert [r["path"] for r in emptydirs.leaf_empty_dirs(inventory).collect()] == ["/a/e"]


def test_scopes(spark):
    rows = [entry(p, "dir") for p in ("/r1", "/r1/a", "/r1/a/b", "/r1/c", "/r2", "/r2/d")]
    inventory = spark.createDataFrame(rows, SCHEMA)
    roots = spark.createDataFrame([(0, "/r1"), (1, "/r2")], "root_idx int, root string")
    chosen = spark.createDataFrame([("/r1/a/b",)], "path string")

    def paths(scope):
        return {r["path"] for r in emptydirs.cascade_empty_dirs(inventory, roots, chosen, scope).collect()}

    assert paths("roots") == {"/r1/a", "/r1/a/b", "/r1/c"}
    assert paths("selected") == {"/r1/a/b"}


def test_stale_plan_is_dropped(spark):
    plan = spark.createDataFrame([("/a/b", 1), ("/a", 2), ("/x", 1)], "path string, round int")
    fresh = spark.createDataFrame([entry("/a", "dir"), entry("/a/b", "dir"), entry("/a/b/new", "file")], SCHEMA)
    assert actions.revalidate_plan(plan, fresh).count() == 0
    fresh = spark.createDataFrame([entry("/a", "dir"), entry("/a/b", "dir")], SCHEMA)
    assert {r["path"] for r in actions.revalidate_plan(plan, fresh).collect()} == {"/a", "/a/b"}
