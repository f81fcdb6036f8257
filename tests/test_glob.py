"""Glob semantics against the standard library's case-sensitive matcher."""

import random
from fnmatch import fnmatchcase

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dustpan.functions.glob import anchors_of, fragments_of, glob_predicate, glob_to_regex, is_stretch, stretches_of
from dustpan.operators import residuals

TRICKY = ["*", "?", "[!b]*", "[]a]", "[!]a]", "[a-c-e]", "[b-a]", "[!b-a]", "a|b", "a&&b", "[a&&b]", "[a[b]", "[",
          "[!", "[]", "a[b", "*.tmp", ".~lock.*#", "f[0-4]*.txt", "**x", "a**", "*a*b*", "", "é*", "[é-ü]?", "a\\b",
          "[\\]", "[a\\-z]", "(x)", "{1,2}", "^a$", "a.b", "[^a]", "[-a]", "[a-]", "[--a]", "#*", "*~", "a b", "x*x"]
NAMES = ["", "a", "b", "]", "[", "!", "-", "c", "d", "e", "ab", "a|b", "a&&b", "&", "a[b", "q.tmp", "q.tmp\n", "\n",
         ".~lock.f1#", "f3x.txt", "f9x.txt", "xx", "x", "é", "éa", "ñb", "a\\b", "\\", "(x)", "{1,2}", "1", "^", "^a$",
         "a.b", "axb", "#x", "x~", "a b", "aXb", "aab", "😀", "a😀", "[]", "[!"]


def test_regex_equals_standard_matcher(spark):
    rng = random.Random(5)
    alphabet = "ab-]![*?.\\^&|~#é\n"
    globs = TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(1200)]
    names = NAMES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 4))) for _ in range(60)]
    rows = [(n, g, glob_to_regex(g), fnmatchcase(n, g)) for g in globs for n in names]
    df = spark.createDataFrame(rows, "name string, glob string, regex string, want boolean")
    wrong = df.where(F.expr("name rlike regex") != F.col("want"))
    assert wrong.limit(5).collect() == []


def test_predicate_equals_standard_matcher(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    tests = [glob_predicate(F.col("name"), g).alias(str(i)) for i, g in enumerate(TRICKY)]
    for row in df.select("name", *tests).collect():
        for i, glob in enumerate(TRICKY):
            assert row[str(i)] == fnmatchcase(row["name"], glob), (row["name"], glob)


@settings(max_examples=500, deadline=None)
@given(st.text("ab*?[]!-.", max_size=14), st.text("ab*?[]!-.", max_size=14))
def test_anchors_and_fragments_are_necessary(glob, name):
    if fnmatchcase(name, glob):
        for side, skip, text in anchors_of(glob):
            start = skip if side == "h" else len(name) - skip - len(text)
            assert start >= 0 and name[start:start + len(text)] == text
        assert all(text in name for text in fragments_of(glob))


@pytest.mark.parametrize("glob, want", [
    ("*", []), ("", []), ("??[ab]*", []), ("*a*", ["a"]), ("a?bc*", ["bc"]), ("*abcd*x", ["abc", "bcd"]), ("[!a]bcd[e]", ["bcd"])])
def test_fragments(glob, want):
    assert fragments_of(glob) == want


@pytest.mark.parametrize("inline", [0, 3, 80])
def test_many_patterns_equal_first_match(spark, monkeypatch, inline):
    """Joined, mixed and inline matching agree with a linear search."""
    monkeypatch.setattr(residuals, "INLINE_PATTERNS", inline)
    globs = TRICKY[3:] + ["*", "?", "*b*", "*.tmp"]
    table = [(i, "Any", g, "", "", "Yes" if i % 3 else "No", "No" if i % 7 == 5 else "yes") for i, g in enumerate(globs)]
    patterns = spark.createDataFrame(table, "pid bigint, OS string, File_Pattern string, Path_Example string, "
                                            "Description string, Safe_To_Delete string, Enabled string")
    names = spark.createDataFrame([("/d/" + n, n, "file") for n in NAMES], "path string, name string, entry_type string")
    want = {n: next((i for i, g in enumerate(globs) if i % 7 != 5 and fnmatchcase(n, g)), None) for n in NAMES}
    got = {r["name"]: r["pid"] for r in residuals.with_first_pattern(names, patterns).collect()}
    assert got == want
    audit = {r["pid"]: r["hits"] for r in residuals.pattern_audit(names, patterns).collect()}
    assert audit == {i: sum(fnmatchcase(n, g) for n in NAMES) for i, g in enumerate(globs)}


def test_floating_globs_meet_few_names(spark, monkeypatch):
    """Globs without an anchor are looked up by a rare fragment: candidates stay near the matches."""
    names = spark.createDataFrame([(f"common{i:04}part",) for i in range(3000)], "name string")
    globs = spark.createDataFrame([(i, f"*mon{i:04}p*") for i in range(1000)], "pid bigint, File_Pattern string")
    seen = []
    keep = residuals.materialize
    monkeypatch.setattr(residuals, "materialize", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    pairs = {(r["name"], r["pid"]) for r in residuals.matching_pairs(names, globs).collect()}
    assert pairs == {(f"common{i:04}part", i) for i in range(1000)}
    chosen = dict(seen)["chosen"]
    met = names.select("name", F.explode(residuals._pieces(3)).alias("key")).join(chosen, "key").count()
    assert met <= 20 * 1000  # all pairs would be 3,000,000


def test_audit_without_patterns_or_entries(spark):
    patterns = spark.createDataFrame([], "pid bigint, File_Pattern string, Safe_To_Delete string")
    names = spark.createDataFrame([("a",)], "name string")
    assert residuals.pattern_audit(names, patterns).collect() == []
    one = spark.createDataFrame([(1, "a*", "Yes")], patterns.schema)
    assert [tuple(r) for r in residuals.pattern_audit(names.limit(0), one).collect()] == [(1, "a*", 0, None, False, True)]


@settings(max_examples=500, deadline=None)
@given(st.text("ab*?[]!-.", max_size=14), st.text("ab*?[]!-.", max_size=14))
def test_stretches_are_necessary_and_sometimes_all(glob, name):
    windows = {(shape, "".join(c for c, kind in zip(name[at:], shape, strict=False) if kind == "c"))
               for shape, _ in stretches_of(glob) for at in range(len(name) - len(shape) + 1)}
    matches = fnmatchcase(name, glob)
    if matches:
        assert windows.issuperset(stretches_of(glob))
    if is_stretch(glob):
        assert matches == windows.issuperset(stretches_of(glob))


@pytest.mark.parametrize("glob, want", [
    ("*", []), ("a*", []), ("*abcd*", [("cccc", "abcd")]), ("*abc?d*", [("ccc.c", "abcd")]), ("*?ab[xy]c?*", [("cc.c", "abc")]),
    ("a?b*", [("c.c", "ab")]), ("*abcdefghi*", [("c" * 8, "abcdefgh"), ("c" * 8, "bcdefghi")]), ("*a*bcd*", [("ccc", "bcd")])])
def test_stretches(glob, want):
    assert stretches_of(glob) == want


@pytest.mark.parametrize("shapes", [0, 1, 8])
def test_short_globs_meet_few_names(spark, monkeypatch, shapes):
    """Globs whose fragments most names have are looked up by all their characters, holes included."""
    monkeypatch.setattr(residuals, "STRETCH_SHAPES", shapes or 1)
    if not shapes:
        monkeypatch.setattr(residuals, "stretches_of", lambda glob: [])
    rng = random.Random(3)
    names = ["".join(rng.choice("0123") for _ in range(12)) for _ in range(300)]
    codes = sorted({"".join(rng.choice("0123") for _ in range(6)) for _ in range(300)})
    globs = [f"*{c}*" if i % 2 else f"*{c[:4]}?{c[4:]}*" for i, c in enumerate(codes)]
    seen = []
    keep = residuals.materialize
    monkeypatch.setattr(residuals, "materialize", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    table = spark.createDataFrame(list(enumerate(globs)), "pid bigint, File_Pattern string")
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = [tuple(r) for r in residuals.matching_pairs(rows, table).collect()]
    want = {(n, i) for n in names for i, g in enumerate(globs) if fnmatchcase(n, g)}
    assert set(pairs) == want and len(pairs) == len(want)
    if shapes == 8:
        keyed = residuals._keys_of_names(rows, dict(seen)["globs"])
        assert keyed.join(dict(seen)["chosen"], "key").count() == len(want)  # by fragments some 6,000 each shape
