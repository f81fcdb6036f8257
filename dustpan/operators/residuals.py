"""Leftovers of operating systems: pattern tables and ordered glob matching."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustpan.fixtures import PATTERN_COLUMNS
from dustpan.functions.glob import anchors_of, fragments_of, glob_predicate, glob_to_regex, is_stretch, stretches_of
from dustpan.functions.text import is_blank, strip
from dustpan.plans.ordered import with_row_number
from dustpan.storage import materialize

# Texts that switch a pattern on, compared in lower case.
ENABLED_TEXTS = ("yes", "true", "1")

# Up to this many patterns become one expression inside the scan, small enough to
# stay compiled; more are joined.
INLINE_PATTERNS = 80

# Shapes of stretches that names are cut into, the ones most globs ask for; other globs are looked up by fragments.
STRETCH_SHAPES = 8


def is_enabled() -> Column:
    return F.lower(F.coalesce(F.col("Enabled"), F.lit("Yes"))).isin(*ENABLED_TEXTS)


def enabled_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.where(is_enabled())


def pattern_summary(patterns: DataFrame) -> DataFrame:
    return patterns.agg(F.count("*").alias("patterns"), F.count_if(is_enabled()).alias("enabled"))


def _complete() -> Column:
    return ~is_blank("OS") & ~is_blank("File_Pattern")


def valid_patterns(rows: DataFrame) -> DataFrame:
    """Editor rule: trim OS and pattern first, then require both."""
    return rows.where(_complete()).select(
        "pid", strip("OS").alias("OS"), strip("File_Pattern").alias("File_Pattern"),
        "Path_Example", "Description", "Safe_To_Delete",
        F.when(is_enabled(), "Yes").otherwise("No").alias("Enabled"))


def invalid_pattern_rows(rows: DataFrame) -> DataFrame:
    """1-based numbers of the rows the editor refuses."""
    return rows.where(~_complete()).select((F.col("pid") + 1).alias("row_number"))


def edit_patterns(patterns: DataFrame, removed: DataFrame | None = None,
                  toggled: DataFrame | None = None, replaced: DataFrame | None = None,
                  added: DataFrame | None = None) -> DataFrame:
    """Table edits: drop pids, flip Enabled, replace rows, append rows, renumber."""
    rows = patterns
    if removed is not None:
        rows = rows.join(removed.select("pid"), "pid", "left_anti")
    if replaced is not None:
        fresh = replaced.select("pid", F.struct(*PATTERN_COLUMNS).alias("fresh"))
        rows = rows.join(fresh, "pid", "left").select(
            "pid", *[F.when(F.col("fresh").isNull(), F.col(c)).otherwise(F.col(f"fresh.{c}")).alias(c)
                     for c in PATTERN_COLUMNS])
    if toggled is not None:
        flips = toggled.select("pid", F.lit(True).alias("flip")).distinct()
        flipped = F.when(is_enabled(), "No").otherwise("Yes")
        rows = rows.join(flips, "pid", "left").withColumn(
            "Enabled", F.when(F.col("flip"), flipped).otherwise(F.col("Enabled"))).drop("flip")
    rows = rows.withColumn("__late", F.lit(0))
    if added is not None:
        rows = rows.unionByName(added.select("pid", *PATTERN_COLUMNS, F.lit(1).alias("__late")))
    return (with_row_number(rows, [], [F.col("__late"), F.col("pid")], "__row")
            .select((F.col("__row") - 1).alias("pid"), *PATTERN_COLUMNS))


def _globs(patterns: DataFrame) -> list | None:
    """(pid, glob) in file order if few enough to be literals of a plan, else None."""
    rows = patterns.select("pid", "File_Pattern").limit(INLINE_PATTERNS + 1).collect()
    return None if len(rows) > INLINE_PATTERNS else sorted((r[0], r[1]) for r in rows)


_ANCHOR = T.StructType([T.StructField("side", T.StringType()), T.StructField("skip", T.IntegerType()),
                        T.StructField("text", T.StringType())])
_STRETCH = T.StructType([T.StructField("shape", T.StringType()), T.StructField("text", T.StringType())])
_COMPILED = T.StructType([T.StructField("regex", T.StringType()), T.StructField("anchors", T.ArrayType(_ANCHOR)),
                          T.StructField("fragments", T.ArrayType(T.StringType())),
                          T.StructField("stretches", T.ArrayType(_STRETCH)), T.StructField("is_stretch", T.BooleanType())])


@F.pandas_udf(_COMPILED)
def _compiled(globs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"regex": globs.map(glob_to_regex),
                         "anchors": [[dict(zip(("side", "skip", "text"), a)) for a in anchors_of(g)] for g in globs],
                         "fragments": globs.map(fragments_of),
                         "stretches": [[dict(zip(("shape", "text"), s)) for s in stretches_of(g)] for g in globs],
                         "is_stretch": globs.map(is_stretch)})


def _cut(side: str, skip: int, size: int) -> Column:
    """The part of a name that an anchor of this shape is compared with."""
    name = F.col("name")
    start = F.lit(skip + 1) if side == "h" else F.length(name) - (skip + size) + 1
    cut = F.substring(name, start, F.lit(size))
    return F.when(F.length(name) >= skip + size, F.concat(F.lit(f"{side}{skip}:"), cut))


def _pieces(size: int) -> Column:
    """All runs of ``size`` characters of a name."""
    starts = F.sequence(F.lit(1), F.length("name") - (size - 1))
    runs = F.transform(starts, lambda at: F.concat(F.lit("f:"), F.substring("name", at, F.lit(size))))
    return F.when(F.length("name") >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _holed(shape: str) -> Column:
    """All windows of a name in this shape, without the characters in its holes."""
    starts = F.sequence(F.lit(1), F.length("name") - (len(shape) - 1))
    runs = [(run.start(), len(run.group())) for run in re.finditer("c+", shape)]
    cuts = F.transform(starts, lambda at: F.concat(
        F.lit(f"{shape}:"), *[F.substring("name", at + skip, F.lit(size)) for skip, size in runs]))
    return F.when(F.length("name") >= len(shape), F.array_distinct(cuts)).otherwise(F.array().cast("array<string>"))


def _keyed_globs(globs: DataFrame) -> DataFrame:
    """(pid, File_Pattern, regex, keys): texts that a matching name must contain, at their place or anywhere.

    ``sure`` is the key that all names having it match by, if there is one.
    """
    compiled = materialize(globs.select("pid", "File_Pattern", _compiled("File_Pattern").alias("c"))
                           .select("pid", "File_Pattern", "c.*"), "compiled")
    shapes = (compiled.select(F.explode("stretches").alias("s")).groupBy("s.shape").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "shape").limit(STRETCH_SHAPES).collect())
    usable = lambda s: s["shape"].isin(*[r["shape"] for r in shapes])
    stretches = F.filter("stretches", usable)
    # A stretch is at least as rare as the fragments inside it.
    covered = (F.size("stretches") > 0) & (F.size(stretches) == F.size("stretches"))
    fragments = F.when(covered, F.array().cast("array<string>")).otherwise(F.col("fragments"))
    placed = F.transform("anchors", lambda a: F.concat(a["side"], a["skip"].cast("string"), F.lit(":"), a["text"]))
    spelt = F.transform(stretches, lambda s: F.concat(s["shape"], F.lit(":"), s["text"]))
    loose = F.transform(fragments, lambda f: F.concat(F.lit("f:"), f))
    return compiled.select("pid", "File_Pattern", "regex", "anchors", fragments.alias("fragments"), stretches.alias("stretches"),
                           F.concat(placed, spelt, loose).alias("keys"), F.when(F.col("is_stretch") & covered, spelt[0]).alias("sure"))


def _keys_of_names(names: DataFrame, globs: DataFrame, *more: Column) -> DataFrame:
    """(name, key) of the distinct names, in the forms that keys of these globs have."""
    # Forms are bounded by the anchor limits (at most 2 x 9 x 8), by FRAGMENT and by STRETCH_SHAPES.
    anchors = globs.select(F.explode("anchors").alias("a")).select(
        "a.side", "a.skip", F.length("a.text")).distinct().collect()
    sizes = globs.select(F.explode("fragments").alias("f")).select(F.length("f")).distinct().collect()
    shapes = globs.select(F.explode("stretches").alias("s")).select("s.shape").distinct().collect()
    cuts = F.array_compact(F.array(*[_cut(*anchor) for anchor in sorted(anchors)]).cast("array<string>"))
    parts = [cuts, *[_pieces(size) for size, in sorted(sizes)], *[_holed(shape) for shape, in sorted(shapes)], *more]
    return names.select("name", F.explode(F.concat(*parts)).alias("key"))


def matching_pairs(names: DataFrame, globs: DataFrame) -> DataFrame:
    """(name, pid) of every match of distinct globs (pid, File_Pattern), however many there are.

    An inverted index of the names: each glob is looked up by the rarest of the
    texts that its matches must contain, which is a text at a fixed distance
    from an end, a stretch between stars with the holes that '?' and classes
    leave in it, or a fragment anywhere.  Where a glob has a choice, names are
    counted per text, so a text that most names share is only used by globs
    that have no other.  A glob without any literal character is tested in one
    pass over the names, or, if there are many such, meets every name: it
    matches nearly all of them.
    """
    distinct = names.select("name").distinct()
    globs = materialize(_keyed_globs(globs), "globs")
    bare = globs.where(F.size("keys") == 0)
    inline = bare.select("pid", "File_Pattern").limit(INLINE_PATTERNS + 1).collect()
    meet_all = len(inline) > INLINE_PATTERNS
    # Counted before the shuffle; only texts that some glob asks for are kept.
    choosing = globs.where(F.size("keys") > 1)
    asked = choosing.select("pid", F.explode("keys").alias("key"))
    counts = _keys_of_names(distinct, choosing).groupBy("key").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "key", "left").groupBy("pid").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("key")).alias("l"), "key")).alias("best"))
    chosen = rarest.where("best.n > 0").select("pid", "best.key")
    chosen = chosen.unionByName(globs.where(F.size("keys") == 1).select("pid", F.col("keys")[0].alias("key")))
    if meet_all:
        chosen = chosen.unionByName(bare.select("pid", F.lit("*").alias("key")))
    tested = F.when(F.col("sure") == F.col("key"), F.lit(None)).otherwise(F.col("regex")).alias("regex")
    chosen = materialize(chosen.join(globs.select("pid", "regex", "sure"), "pid").select("pid", "key", tested), "chosen")
    keyed = _keys_of_names(distinct, globs, F.array(F.lit("*")) if meet_all else F.array().cast("array<string>"))
    hits = keyed.join(chosen, "key").where(F.expr("regex IS NULL OR name rlike regex")).select("name", "pid")
    if inline and not meet_all:
        tests = F.array(*[F.when(glob_predicate(F.col("name"), g), F.lit(pid)) for pid, g in inline])
        hits = hits.unionByName(distinct.select("name", F.explode(F.array_compact(tests)).alias("pid")))
    return hits


def _leading(patterns: DataFrame) -> DataFrame:
    """Distinct globs, each with the first pid that has it."""
    return patterns.groupBy("File_Pattern").agg(F.min("pid").alias("pid"))


def first_of_many(entries: DataFrame, active: DataFrame) -> DataFrame:
    """(name, pid) of the first match; of equal globs only the first can win."""
    return matching_pairs(entries, _leading(active)).groupBy("name").agg(F.min("pid").alias("pid"))


def with_first_pattern(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """Add the pid of the first enabled pattern matching the name, else null."""
    active = enabled_patterns(patterns)
    globs = _globs(active)
    if globs is None:
        # Written, so that a name of very many entries can be dealt to several tasks in the join.
        return entries.join(materialize(first_of_many(entries, active), "first"), "name", "left")
    tests = [F.when(glob_predicate(F.col("name"), glob), F.lit(pid)) for pid, glob in globs]
    return entries.withColumn("pid", F.coalesce(*tests, F.lit(None)).cast("bigint"))


def residual_matches(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files and directories named like a leftover, with the pattern that says so."""
    hits = with_first_pattern(entries, patterns).where("pid IS NOT NULL")
    return hits.select("path", "entry_type", "pid").join(
        patterns.select("pid", "OS", "File_Pattern", "Safe_To_Delete"), "pid")


def non_residual(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """Entries whose own name matches nothing; place it before any hashing."""
    return with_first_pattern(entries, patterns).where("pid IS NULL").drop("pid")


def pattern_audit(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """Reach of every pattern on its own, first-match order and Enabled ignored; no rows for no patterns."""
    globs = _globs(patterns)
    if globs is None:
        # Names are counted before they meet the patterns, so hot names stay one row.
        counted = materialize(entries.groupBy("name").agg(F.count("*").alias("n")), "names")
        leading = _leading(patterns)
        # Added up per distinct glob, so that patterns of a glob are joined to one row each.
        hits = (matching_pairs(counted, leading).join(counted, "name").groupBy("pid").agg(F.sum("n").alias("hits"))
                .join(leading, "pid").select("File_Pattern", "hits"))
        total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        counts = patterns.select("pid", "File_Pattern").join(materialize(hits, "hits"), "File_Pattern", "left").select(
            "pid", F.coalesce("hits", F.lit(0)).alias("hits"), F.lit(total).cast("bigint").alias("total"))
    elif globs:
        one_pass = entries.agg(
            F.count("*").alias("total"),
            *[F.count_if(glob_predicate(F.col("name"), glob)).alias(f"p{pid}") for pid, glob in globs])
        pairs = F.array(*[F.struct(F.lit(pid).cast("bigint").alias("pid"), F.col(f"p{pid}").alias("hits"))
                          for pid, _ in globs])
        counts = one_pass.select("total", F.explode(pairs).alias("h")).select("total", "h.*")
    else:
        none = F.lit(0).cast("bigint")
        counts = patterns.select("pid", none.alias("hits"), none.alias("total"))
    return counts.join(patterns.select("pid", "File_Pattern", "Safe_To_Delete"), "pid").select(
        "pid", "File_Pattern", "hits", F.try_divide("hits", "total").alias("share"),
        ((F.col("hits") == F.col("total")) & (F.col("total") > 0)).alias("matches_all"),
        (F.col("Safe_To_Delete") == "Yes").alias("strict_preset"))
