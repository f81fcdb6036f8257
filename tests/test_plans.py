"""The physical plans are the ones that hold at scale."""

import pytest

from dustpan import fixtures as fx
from dustpan.functions.hashing import hash_files
from dustpan.operators import dedup, residuals
from dustpan.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = sorted(set(registry.all_queries()) - {
    "incremental_duplicates", "incremental_duplicates_long", "near_duplicates", "near_duplicate_vectors", "list_files",
    "list_files_source", "list_entries", "hash_tree", "error_ledger", "apply_deletes", "purge_tree", "quarantine_tree",
    "delete_tree", "find_duplicates_tree"})


@pytest.mark.parametrize("name", LAZY)
def test_no_product_and_no_nested_loop(spark, sf_dir, name):
    plan = plan_of(registry.all_queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_residual_match_needs_no_shuffle_of_entries(spark, sf_dir):
    plan = plan_of(residuals.with_first_pattern(registry.files(spark, sf_dir), registry.patterns(spark)))
    assert "Exchange" not in plan
    assert "text" not in plan_of(registry.non_residual(spark, sf_dir).select("path")).split("ReadSchema")[1]


def test_newest_are_limited_before_the_shuffle(spark, sf_dir):
    plan = plan_of(registry.retain_newest(spark, sf_dir))
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_ranks_are_hash_aggregates(spark, sf_dir):
    plan = plan_of(registry.dup_plan(spark, sf_dir))
    assert "Window" not in plan and "SortAggregate" not in plan and "sha2" not in plan


def test_filters_precede_hashing(spark, sf_dir):
    files = registry.files(spark, sf_dir).select("path", "name", "size")
    plan = plan_of(hash_files(dedup.size_candidates(residuals.non_residual(files, registry.patterns(spark)))))
    assert plan.index("MapInPandas") < plan.index("LeftSemi")


def test_only_needed_columns_are_read(spark, sf_dir):
    read = plan_of(fx.url_paths(spark, sf_dir)).split("ReadSchema: ")[1]
    assert read.startswith("struct<url:string>")


def test_entry_works_without_the_text_operators():
    """Their package may be gone, empty, or short of a library."""
    import subprocess
    import sys
    hide = "import sys; sys.modules[{0!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q"
    for name in ("dustpan.llm", "sentencepiece", "corpus_pipeline"):
        code = hide.format(name)
        if name == "corpus_pipeline":  # the operators do not need it, only the query does
            code = code.replace(" and 'pipeline' not in q", "")
        assert subprocess.run([sys.executable, "-c", code], cwd=".").returncode == 0
