"""Small text expressions: trimming, sizes, time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dustpan.functions.paths import col

# Fixed value: layout of the time stamp that opens an audit line.
STAMP = "yyyy-MM-dd HH:mm:ss"


def strip(text: Column | str) -> Column:
    """Remove all leading and trailing white space, tabs and newlines included."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def is_blank(text: Column | str) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def human_size(n: Column | str) -> Column:
    n = col(n)
    # Ties round to even before formatting: 1280 bytes show as 1.2 KB.
    return F.when(n >= 1024, F.format_string("= %.1f KB", F.bround(n / 1024, 1))) \
            .otherwise(F.format_string("= %d bytes", n.cast("bigint")))


def audit_stamp(ts: Column | str) -> Column:
    return F.date_format(col(ts), STAMP)
