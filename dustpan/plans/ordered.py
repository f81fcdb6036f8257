"""Row numbers and running sums whose groups may be larger than one task.

A window over a hot group sorts that group in a single task.  Here the rows
are range-partitioned by (group, order), so a hot group spreads over many
tasks; each slice is numbered on its own, and slice totals (one row per slice
and group) supply the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dustpan.storage import materialize

_SLICE, _SUM, _BASE = "__slice", "__sum", "__base"


def with_running(df: DataFrame, group: list[str], order: list[Column],
                 sums: dict[str, Column]) -> DataFrame:
    """Add, per name in ``sums``, its running total up to and including the row.

    ``order`` must be total within a group.  ``F.lit(1)`` as a sum gives a
    row number.
    """
    keys = [F.col(g) for g in group]
    # Written first: sampling for the range bounds then reads these narrow rows, not the input again.
    measured = materialize(df.withColumns({_SUM + name: value.cast("bigint") for name, value in sums.items()}), "measured")
    # The slice id depends on the sampled range bounds, so it is fixed by writing it.
    sliced = materialize(
        measured.repartitionByRange(*keys, *order)
                .withColumn(_SLICE, F.spark_partition_id()), "sliced")

    inside = W.partitionBy(_SLICE, *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.withColumns({name: F.sum(_SUM + name).over(inside) for name in sums})

    # At most (slices + groups) rows, and per group at most one row per slice.
    totals = sliced.groupBy(_SLICE, *group).agg(*[F.sum(_SUM + n).alias(_BASE + n) for n in sums])
    before = W.partitionBy(*group).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        _SLICE, *group,
        *[F.coalesce(F.sum(_BASE + n).over(before), F.lit(0)).alias(_BASE + n) for n in sums])

    on = [local[_SLICE] == offsets[_SLICE]] + [local[g].eqNullSafe(offsets[g]) for g in group]
    condition = on[0]
    for more in on[1:]:
        condition = condition & more
    return local.join(offsets, condition).select(
        *[local[c] for c in df.columns],
        *[(local[n] + offsets[_BASE + n]).alias(n) for n in sums])


def with_row_number(df: DataFrame, group: list[str], order: list[Column],
                    name: str = "seq") -> DataFrame:
    return with_running(df, group, order, {name: F.lit(1)})


def sliced(running: DataFrame, order: list[Column], upto: str, weight: str, total: int, tasks: int) -> DataFrame:
    """Rows with their running weight dealt to ``tasks`` partitions of equal weight, neighbours in ``order`` together.

    A row goes where its middle lies.  That is computed, not hashed, so it is
    not left to chance how many heavy rows meet.
    """
    middle = 2 * F.col(upto) - F.col(weight)
    number = F.least(F.floor(middle * tasks / (2 * max(total, 1))), F.lit(tasks - 1)).cast("int")
    return running.repartitionById(tasks, number).sortWithinPartitions(*order)
