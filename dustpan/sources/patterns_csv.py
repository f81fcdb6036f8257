"""Residual pattern tables as CSV, one folder per saved version."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustpan.fixtures import PATTERN_COLUMNS
from dustpan.functions.text import strip
from dustpan.plans.ordered import with_row_number

PATTERN_SCHEMA = "pid bigint, " + ", ".join(f"{c} string" for c in PATTERN_COLUMNS)
_CSV = {"header": True, "multiLine": True, "escape": '"',
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_pattern_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows as written, numbered from 0 in file order; a missing file is empty.

    A cell that is absent or empty reads as ''.  Only a file without an
    ``Enabled`` column defaults it to 'Yes'.
    """
    try:
        raw = spark.read.csv(path, **_CSV)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], PATTERN_SCHEMA)
    # A multi-line file is one split, so the running id keeps its line order.
    placed = raw.select("*", F.col("_metadata.file_name").alias("__file"),
                        F.monotonically_increasing_id().alias("__at"))
    numbered = with_row_number(placed, [], [F.col("__file"), F.col("__at")], "__row")
    absent = {"Enabled": F.lit("Yes")}
    return numbered.select(
        (F.col("__row") - 1).alias("pid"),
        *[F.coalesce(c, F.lit("")).alias(c) if c in raw.columns
          else absent.get(c, F.lit("")).alias(c) for c in PATTERN_COLUMNS])


def accept_patterns(rows: DataFrame) -> DataFrame:
    """Load rule: OS and pattern present before trimming, then every cell trimmed."""
    return (rows.where((F.col("OS") != "") & (F.col("File_Pattern") != ""))
            .select("pid", *[strip(c).alias(c) for c in PATTERN_COLUMNS]))


def load_patterns(spark: SparkSession, path: str) -> DataFrame:
    return accept_patterns(read_pattern_rows(spark, path))


def save_patterns(patterns: DataFrame, folder: str, version: str) -> str:
    """Write a new version in row order; earlier versions stay as its backup."""
    path = f"{folder}/{version}"
    (patterns.repartitionByRange("pid").sortWithinPartitions("pid")
     .select(*PATTERN_COLUMNS)
     .write.csv(path, mode="errorifexists", header=True, escape='"', emptyValue="",
                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return path
