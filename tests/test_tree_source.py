"""The data source gives the rows of the lister, with filters handed over."""

import os

import pytest
from pyspark.sql import functions as F

from dustpan.sources import lister, tree_source
from tests.test_trees import roots, tree  # noqa: F401


@pytest.mark.parametrize("splits, ahead", [(1, 10), (3, 10), (5, 2), (256, 10_000), (256, 0)])
def test_rows_are_those_of_the_lister(spark, tree, splits, ahead):  # noqa: F811
    os.mkdir(os.fsencode(str(tree)) + b"/bad\xff")
    paths = [str(tree), str(tree / "missing"), str(tree / "full")]
    got = tree_source.read_tree(spark, paths, splits=splits, ahead=ahead)
    want = lister.list_entries(roots(spark, *paths)).select(got.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_filters_are_handed_over(spark, tree):  # noqa: F811
    rows = tree_source.read_tree(spark, [str(tree), str(tree / "full")])
    everything = [r.asDict() for r in rows.collect()]
    cases = {"entry_type = 'dir'": lambda r: r["entry_type"] == "dir", "size > 10 AND name LIKE 'zer%'": lambda r: False,
             "name IN ('big', 'zero1') AND size >= 1": lambda r: r["name"] == "big",
             "name LIKE '%e' AND root_idx = 0": lambda r: r["name"].endswith("e") and r["root_idx"] == 0,
             "size IS NULL": lambda r: r["size"] is None, "name LIKE '%ero%' AND length(name) = 5": lambda r: "ero" in r["name"] and len(r["name"]) == 5}
    for condition, test in cases.items():
        got = rows.where(condition)
        assert sorted(r["path"] for r in got.collect()) == sorted(r["path"] for r in everything if test(r)), condition
    plan = rows.where("entry_type = 'dir'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter (" in rows.where("length(name) = 5")._jdf.queryExecution().executedPlan().toString()


def test_a_crooked_tree_is_cut_where_it_widens(spark, tmp_path):
    deep = tmp_path
    for n in range(30):
        deep = deep / f"d{n}"
    for n in range(40):
        (deep / f"w{n}" / "x").mkdir(parents=True)
    rows = tree_source.read_tree(spark, [str(tmp_path)], splits=16)
    sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30 + 40 * 2 and max(sizes) <= 8
    reader = tree_source.TreeReader({"roots": f'["{tmp_path}"]', "splits": "16"})
    assert len([p for p in reader.partitions() if p.deep]) == 16
