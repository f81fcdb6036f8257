"""Every registered query against its SQL, and the known figures at sf0.01."""

import pytest

import __spark_entry__ as entry
from dustpan import fixtures as fx
from dustpan.operators import dedup, emptydirs, profile, residuals
from dustpan.plans import oracle, registry
from tests.compare import spark_bag, sql_bag

LARGER = "/root/testdata/sf0.01"


def test_every_query_has_sql():
    assert set(registry.all_queries()) == set(oracle.all_oracles())


@pytest.mark.parametrize("name", sorted(registry.all_queries()))
def test_equals_sql(spark, sql, sf_dir, name):
    columns, rows = spark_bag(entry.queries()[name](spark, sf_dir))
    sql_columns, sql_rows = sql_bag(sql, entry.oracle_sql()[name])
    assert columns == sql_columns
    assert rows == sql_rows


def test_entry_runs(spark):
    assert entry.entry(spark).columns[0] == "hash"


def test_known_figures(spark):
    rows = registry.hashed(spark, LARGER)
    assert rows.count() == 1000 and rows.select("path").distinct().count() == 1000
    assert tuple(dedup.duplicate_summary(rows).first()) == (62, 73, 163961)
    assert dedup.same_name_duplicates(rows).count() == 2
    assert dedup.size_candidates(rows).count() == 323
    per_device = dedup.dup_plan(rows, "keep_one_per_device")
    assert per_device.where("action = 'DELETE'").count() == 2
    classes = {r["size_class"]: r["files"] for r in profile.size_class_profile(rows).collect()}
    assert classes == {"tiny": 36, "small": 270, "medium": 541, "large": 144, "xxx-large": 9}
    hits = residuals.with_first_pattern(rows, registry.patterns(spark)).groupBy("pid").count()
    assert {r[0]: r[1] for r in hits.collect() if r[0] is not None} == {0: 125, 1: 125, 2: 125, 4: 125, 6: 110}


def test_known_tree_figures(spark):
    tree = fx.directory_tree(spark, LARGER).cache()
    assert tree.groupBy("entry_type").count().orderBy("entry_type").collect() == [("dir", 217), ("file", 215)]
    assert emptydirs.leaf_empty_dirs(tree).count() == 34
    cascade = emptydirs.cascade_empty_dirs(tree)
    assert {r[0]: r[1] for r in cascade.groupBy("depth").count().collect()} == {1: 1, 2: 7, 3: 34}
    rounds = {r["round"]: r["dirs"] for r in emptydirs.purge_rounds(cascade).collect()}
    assert rounds == {1: 34, 2: 7, 3: 1}
