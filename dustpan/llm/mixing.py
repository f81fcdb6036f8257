"""Mixing sources to target weights by Poisson replication.

With target share w_s of a mixture as large as ``size`` times the input, source
s of c_s code points is repeated at the mean rate

    rate_s = size * w_s * c_all / c_s.

Each document draws its own number of copies from a Poisson distribution of
that mean, by inverting the distribution at a number hashed from its id and the
seed, so any task, retry or later run draws the same.  A rate above ``PART`` is
split into equal parts drawn separately and added up, which is Poisson again
and keeps the tables short.  Copies are then shuffled globally: dealt to
partitions and sorted inside them by a hash of (id, copy, seed).

Only one row per source is gathered; documents are never counted by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustpan.storage import materialize

PART = 8.0
SEED = 17
# P(X > 64) for a mean of PART is below 1e-35: no double reaches beyond.
_TERMS = 64


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0 ** 52)


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson distribution; array<double>."""
    first = F.exp(-mean)
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(_TERMS)),
        F.struct(first.alias("p"), first.alias("total"), F.array(first).alias("table")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["total"] + s["p"] * mean / k).alias("total"),
                              F.concat(s["table"], F.array(s["total"] + s["p"] * mean / k)).alias("table")))
    return grown["table"]


def rates(docs: DataFrame, weights: DataFrame | None = None, size: float = 1.0, text: str = "text",
          source: str = "source", flatten: float = 0.5) -> DataFrame:
    """(source, rate, parts, table) with one row per source.

    ``weights`` has (source, weight); weights are scaled to add up to one over
    the sources present, and a source without a (positive) weight gets rate 0.
    Without ``weights`` the target share of a source is its share of code
    points to the power of ``flatten``, scaled.  A null source is a source of
    its own.  A source of empty texts only has rate 1.
    """
    chars = docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.coalesce(F.length(text), F.lit(0)).cast("bigint")).alias("chars"))
    if weights is None:
        weighted = chars.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(flatten)))
    else:
        given = weights.groupBy(F.col("source").alias("__s")).agg(F.sum("weight").cast("double").alias("weight"))
        weighted = (chars.join(given, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
                    .withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))))
    weighted = materialize(weighted, "weights")
    whole = weighted.where("chars > 0").agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight")).first()
    target = F.col("weight") / F.lit(float(whole["weight"] or 1.0)) * F.lit(float(whole["chars"] or 0))
    rate = F.when(F.col("chars") == 0, F.lit(1.0)).otherwise(target * F.lit(float(size)) / F.col("chars"))
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    return (weighted.select("source", rate.alias("rate")).select("source", "rate", parts.alias("parts"))
            .withColumn("table", poisson_table(F.col("rate") / F.col("parts"))))


def replicate(docs: DataFrame, weights: DataFrame | None = None, size: float = 1.0, seed: int = SEED,
              id: str = "doc_id", text: str = "text", source: str = "source", copy: str | None = None,
              order: str | None = None, flatten: float = 0.5) -> DataFrame:
    """The mixture: rows of ``docs``, each as often as drawn, in global random order.

    ``copy`` names a column for the number of the copy (from 1), ``order`` one
    for the hash that the rows are shuffled by; existing ones are replaced.
    Rows with a null id share one draw, repeated rows draw alike.
    """
    # Written first: Spark then knows how small the table is and sends it to the documents, not the reverse.
    table = materialize(rates(docs, weights, size, text, source, flatten), "rates").select(
        F.col("source").alias("__source"), F.col("parts").alias("__parts"), F.col("table").alias("__table"))
    own = docs.select([c for c in docs.columns if c not in (copy, order)])
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")), F.lit(0),
        lambda n, k: n + F.size(F.filter("__table", lambda p: p <= uniform(F.col(id), F.lit(seed), k))))
    counted = own.join(table, F.col(source).eqNullSafe(F.col("__source"))).withColumn("__n", drawn)
    copies = counted.where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    key = F.md5(F.concat_ws(":", F.col(id).cast("string"), F.col("__copy").cast("string"), F.lit(str(seed))).cast("binary"))
    shuffled = copies.withColumn("__key", key).repartition("__key").sortWithinPartitions("__key")
    columns = [F.col(c) for c in own.columns]
    if copy:
        columns.append(F.col("__copy").cast("bigint").alias(copy))
    if order:
        columns.append(F.col("__key").alias(order))
    return shuffled.select(*columns)
