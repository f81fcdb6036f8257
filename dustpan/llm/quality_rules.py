"""Quality rules whose thresholds adapt to each language and source.

Fixed cutoffs treat a table-heavy source like a novel.  Here the rules' limits
come from the distribution of each statistic within its (language, source):
a document is rejected where a statistic lies far outside, beyond
``middle + spread * (upper - middle)`` (mirrored below, where a rule has a
lower side), with upper, middle and lower the 75, 50 and 25 % quantiles.

The quantiles are read from mergeable sketches: counts per log-linear bucket
(exact up to 64, then 32 buckets per power of two, so within 1/32 of the
value).  Bucket counts of a language are the sums of its sources', in any
order and grouping, so they are combined before the shuffle and a hot source
costs no task more than its buckets.  A group with fewer than ``least`` rows
takes its language's thresholds, a language with fewer takes those of all.

Everything is DataFrame functions; texts are read once, to a narrow table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dustpan.llm.rows import packed, unpacked
from dustpan.storage import materialize

WHITE = r"[\x20\x09-\x0D]+"
LEAST_ROWS, SPREAD = 100, 6
# statistic: (numerator, denominator, smallest step a limit keeps from the middle, has a lower side); in thousandths
RULES = {
    "word_length": ("word_chars", "n_words", 1000, True),
    "symbols": ("n_symbols", "n_words", 20, False),
    "dup_lines": ("n_dup_lines", "n_lines", 300, False),
    "repeats": ("n_repeat_words", "n_words", 200, False),
}


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def with_base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Words are what white space leaves; a null or empty text has none, and zeros
    throughout.  Existing columns of these names are replaced; others of any
    name are kept.
    """
    other = [c for c in docs.columns if c not in (*STATISTICS, text)]
    rows = docs.select(packed(docs, other).alias("row"), F.col(f"`{text}`").alias("text"))
    return _counted(rows).select(*unpacked("row", other), *STATISTICS)


def _counted(rows: DataFrame) -> DataFrame:
    """(row, statistics) of (row, text)."""
    cut = rows.select("row", F.coalesce("text", F.lit("")).alias("__t")).select(
        "*", F.filter(F.split("__t", WHITE), lambda w: w != "").alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"))
    runs = F.greatest(F.size("__w") - 2, F.lit(0))
    windows = F.zip_with(
        F.zip_with(F.slice("__w", F.lit(1), runs), F.slice("__w", F.lit(2), runs), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice("__w", F.lit(3), runs), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    hashed = cut.select("*", windows.alias("__h"))
    # Sorted by hash, equal windows are neighbours; most texts have none and are not sorted.
    ordered = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.when(F.size(F.array_distinct("__h")) < F.size("__h"), ordered)
    sorted_ = hashed.select("*", repeated.alias("__s"))
    n = F.size("__s")
    neighbours = F.zip_with(
        F.slice("__s", F.lit(1), n - 1), F.slice("__s", F.lit(2), n - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    covered = F.size(F.array_distinct(F.flatten(F.filter(neighbours, lambda x: x.isNotNull()))))
    return sorted_.select(
        "row", F.size("__w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("__t", WHITE, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("__t", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("__s").isNull(), F.lit(0)).otherwise(covered).cast("bigint").alias("n_repeat_words"),
        F.size("__l").cast("bigint").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _per_mille(rule: str) -> Column:
    top, bottom, _, _ = RULES[rule]
    return F.expr(f"IF({bottom} = 0, 0, 1000 * {top} div {bottom})")


def bucket(value: Column) -> Column:
    """Log-linear bucket of a whole number from 0; order is kept."""
    power = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(power.cast("bigint") * 32 + F.call_function("shiftright", value, power))


def bucket_floor(b: Column) -> Column:
    """The smallest value of a bucket."""
    power = F.floor(b / 32).cast("int") - 1
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - power.cast("bigint") * 32, power))


def sketches(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, rule, bucket, n): the mergeable sketches of all rules."""
    values = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), bucket(_per_mille(rule)).alias("bucket")) for rule in RULES]))
    return (rows.select(*group, values.alias("v")).groupBy(*group, "v.rule", "v.bucket")
            .agg(F.count("*").alias("n")))


def _merged(sketch: DataFrame, group: list[str]) -> DataFrame:
    return sketch.groupBy(*group, "rule", "bucket").agg(F.sum("n").alias("n"))


def _limits(sketch: DataFrame, group: list[str], spread: int) -> DataFrame:
    """(group, rule, rows, low, high) from sketches; a bound of null sets no limit on that side."""
    place = W.partitionBy(*group, "rule").orderBy("bucket")
    ranked = sketch.select("*", F.sum("n").over(place).alias("upto"), F.sum("n").over(W.partitionBy(*group, "rule")).alias("rows"))
    at = lambda q: bucket_floor(F.min(F.when(F.col("upto") * 100 >= F.col("rows") * q, F.col("bucket"))))
    found = ranked.groupBy(*group, "rule").agg(F.first("rows").alias("rows"), at(25).alias("q25"), at(50).alias("q50"), at(75).alias("q75"))
    step = F.lit(0)
    lower = F.lit(False)
    for rule, (_, _, least, has_lower) in RULES.items():
        step = F.when(F.col("rule") == rule, F.lit(least)).otherwise(step)
        lower = F.when(F.col("rule") == rule, F.lit(has_lower)).otherwise(lower)
    high = F.col("q50") + F.greatest(spread * (F.col("q75") - F.col("q50")), step)
    low = F.col("q50") - F.greatest(spread * (F.col("q50") - F.col("q25")), step)
    return found.select(*group, "rule", "rows", F.when(lower, low).alias("low"), high.alias("high"))


def thresholds(rows: DataFrame, least: int = LEAST_ROWS, spread: int = SPREAD) -> DataFrame:
    """(lang, source, rule, low, high) for every group of ``rows``; null languages and sources are groups of their own."""
    fine = materialize(sketches(rows, ["lang", "source"]), "sketches")
    coarse = _merged(fine, ["lang"])
    per_group, per_lang = _limits(fine, ["lang", "source"], spread), _limits(coarse, ["lang"], spread)
    overall = _limits(_merged(coarse, []), [], spread)
    lang = per_lang.select(F.col("lang").alias("__lang"), F.col("rule").alias("__rule"), F.col("rows").alias("__rows"),
                           F.col("low").alias("__low"), F.col("high").alias("__high"))
    every = overall.select(F.col("rule").alias("__r"), F.col("low").alias("__l"), F.col("high").alias("__h"))
    joined = (per_group.join(lang, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("rule") == F.col("__rule")))
              .join(every, F.col("rule") == F.col("__r")))
    choose = lambda own, wider, widest: F.when(F.col("rows") >= least, F.col(own)).when(
        F.col("__rows") >= least, F.col(wider)).otherwise(F.col(widest))
    return joined.select("lang", "source", "rule", choose("low", "__low", "__l").alias("low"),
                         choose("high", "__high", "__h").alias("high"))


def apply_rules(docs: DataFrame, text: str = "text", least: int = LEAST_ROWS, spread: int = SPREAD) -> DataFrame:
    """``docs`` without ``text``, with the base statistics, base_failed and kept, one row per input row.

    ``docs`` has ``lang`` and ``source``.  ``kept`` is false where base_failed,
    or where a statistic lies outside its group's limits.  Existing columns of
    the results' names are replaced, others of any name are kept.
    """
    other = [c for c in docs.columns if c not in (*STATISTICS, text, "base_failed", "kept")]
    rows = _counted(docs.select(packed(docs, other).alias("row"), F.col(f"`{text}`").alias("text")))
    lang, source = (F.col(f"row.c{other.index(c)}").alias(c) for c in ("lang", "source"))
    rows = materialize(rows.select("*", lang, source, base_failed().alias("base_failed")), "statistics")
    # One row per group, with a column pair per rule; written, so that a hot group can be dealt to several tasks.
    wide = thresholds(rows, least, spread).groupBy(F.col("lang").alias("__lang"), F.col("source").alias("__source")).agg(*[
        F.max(F.when(F.col("rule") == rule, F.col(side))).alias(f"__{rule}_{side}")
        for rule in RULES for side in ("low", "high")])
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    inside = F.lit(True)
    for rule in RULES:
        value = _per_mille(rule)
        inside &= F.coalesce(value <= F.col(f"__{rule}_high"), F.lit(True)) & F.coalesce(value >= F.col(f"__{rule}_low"), F.lit(True))
    joined = rows.join(materialize(wide, "limits"), same, "left")
    return joined.select(*unpacked("row", other), *STATISTICS, "base_failed", (~F.col("base_failed") & inside).alias("kept"))
