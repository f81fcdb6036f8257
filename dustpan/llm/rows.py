"""A caller's columns carried in one struct, so that no working column can clash with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, columns: list[str]) -> Column:
    """A struct of the named columns; ``unpacked`` gives them back."""
    return F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])


def unpacked(struct: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{struct}.c{i}").alias(c) for i, c in enumerate(columns)]
