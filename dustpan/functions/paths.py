"""Path expressions on '/'-separated, absolute paths (no trailing slash)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def parent_of(path: Column | str) -> Column:
    path = col(path)
    return F.substring(path, F.lit(1), F.length(path) - F.length(basename(path)) - 1)


def depth_of(path: Column | str) -> Column:
    """Number of parts below the file system root."""
    path = col(path)
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("int")


def extension_of(name: Column | str) -> Column:
    """Text after the last dot; empty for dotfiles and names without a dot."""
    return F.regexp_extract(col(name), r"^.+\.([^.]+)$", 1)


def self_and_ancestors(path: Column | str) -> Column:
    """['/a', '/a/b', '/a/b/c'] for '/a/b/c'; empty for ''."""
    parts = F.split(col(path), "/")
    last = F.size(parts)
    steps = F.when(last > 1, F.sequence(F.lit(2), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def resolved_path(path: Column | str) -> Column:
    """``clean_path`` with '.' and '..' steps resolved by name; the top is '/'."""
    steps = F.aggregate(
        F.split(col(path), "/"), F.array().cast("array<string>"),
        lambda kept, step: F.when(step.isin("", "."), kept)
        .when(step == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(step))))
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


def as_ancestor(path: Column | str) -> Column:
    """The top as ancestors are spelled: '' instead of '/'."""
    return F.when(col(path) == "/", "").otherwise(col(path))


def clean_path(path: Column | str) -> Column:
    """Repeated and trailing slashes removed, so equal directories compare equal."""
    return F.regexp_replace(F.regexp_replace(col(path), "/+", "/"), "(.)/$", "$1")
