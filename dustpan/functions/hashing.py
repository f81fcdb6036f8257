"""Content digests: of a column, and of files read in bounded chunks."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustpan.functions.paths import col
from dustpan.plans.ordered import sliced, with_running
from dustpan.storage import materialize

# Fixed value: bytes read at a time when hashing a file.
CHUNK = 65536


def content_hash(content: Column | str) -> Column:
    return F.sha2(col(content), 256)


def _hasher(algorithm: str):
    if algorithm == "blake3":
        import blake3  # optional; callers ask for it by name
        return blake3.blake3
    return getattr(hashlib, algorithm)


# Bytes read from either end of a file before all of it is read, and bytes of a range that one task reads.
PROBE, RANGE = 65536, 1 << 28
# What opening a file costs, in bytes read meanwhile.
OPENING = 16384


def dealt_for_reading(files: DataFrame, task_bytes: int = 1 << 30) -> DataFrame:
    """Rows with ``path`` and ``size`` (bytes to read) dealt to tasks of equal work, by device if that is known.

    The number of tasks is given, as adaptive execution only sees the short
    rows and would merge them into few tasks; a task reads neighbouring paths.
    """
    order = [F.col(c) for c in ("device", "path", "part") if c in files.columns]
    work = F.coalesce("size", F.lit(0)) + OPENING
    rows = files.withColumn("__work", work.cast("bigint"))
    total = rows.agg(F.coalesce(F.sum("__work"), F.lit(0))).first()[0]
    running = with_running(rows, [], order, {"__upto": F.col("__work")})
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    return sliced(running, order, "__upto", "__work", total, int(tasks)).drop("__work", "__upto")


def _reason(err: OSError) -> str:
    return f"{type(err).__name__}: {err.strerror or err}"


def _per_row(files: DataFrame, schema: str, read: Callable[[tuple], tuple]) -> DataFrame:
    """``files`` with the columns of ``schema`` that ``read`` gives for a row."""
    names = [part.split()[0] for part in schema.split(", ")]
    out = T.StructType([*files.schema.fields, *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [read(row) for row in rows.itertuples(index=False)]
            yield rows.assign(**{name: [f[k] for f in found] for k, name in enumerate(names)})

    return files.mapInPandas(run, out)


def hash_files(files: DataFrame, algorithm: str = "sha256", chunk: int = CHUNK) -> DataFrame:
    """Add ``hash`` and ``hash_error`` to rows with a readable ``path``.

    Call it after every filter on names and sizes: a filter is not moved below
    a Python operator.  Rows carry no content, so a file of any size passes in
    constant memory; a failing file gives an error, not a failed job.
    """
    def digest(row) -> tuple:
        state = _hasher(algorithm)()
        try:
            with open(row.path, "rb") as handle:
                while block := handle.read(chunk):
                    state.update(block)
        except OSError as err:
            return None, _reason(err)
        return state.hexdigest(), None

    return _per_row(files, "hash string, hash_error string", digest)


def _probed(files: DataFrame, algorithm: str, probe: int) -> DataFrame:
    """Add ``probe``, the digest of both ends of each file, with ``probe_error`` and the bytes ``seen``."""
    def ends(row) -> tuple:
        try:
            with open(row.path, "rb") as handle:
                data = handle.read(probe if row.size > 2 * probe else 2 * probe)
                if row.size > 2 * probe:
                    handle.seek(-probe, os.SEEK_END)
                    data += handle.read(probe)
        except OSError as err:
            return None, _reason(err), 0
        return _hasher(algorithm)(data).hexdigest(), None, len(data)

    return _per_row(files, "probe string, probe_error string, seen bigint", ends)


def _ranges_hashed(parts: DataFrame, algorithm: str, chunk: int) -> DataFrame:
    def digest(row) -> tuple:
        state, left = _hasher(algorithm)(), int(row.size)
        try:
            with open(row.path, "rb") as handle:
                handle.seek(int(row.start))
                while left > 0 and (block := handle.read(min(chunk, left))):
                    state.update(block)
                    left -= len(block)
        except OSError as err:
            return None, _reason(err), 0
        return state.hexdigest(), None, int(row.size) - left

    return _per_row(parts, "digest string, digest_error string, seen bigint", digest)


def staged_hashes(files: DataFrame, algorithm: str = "sha256", chunk: int = CHUNK, probe: int = PROBE, span: int = RANGE,
                  whole_sizes: DataFrame | None = None) -> DataFrame:
    """Add ``hash``, ``hash_error`` and the bytes ``read`` to distinct files (path, size); for finding equal contents.

    Files that have no equal among the given ones are not read whole: first
    both ends are, and then only files that agree in size and ends.  ``hash``
    is null for the others, and for files that cannot be read, which have a
    ``hash_error``.  Files whose size is in ``whole_sizes`` (size), because
    their equals are known elsewhere, are always read whole.

    A file of up to ``span`` bytes has the digest of its content.  A larger one
    is read in ranges of ``span`` bytes by several tasks; its hash is 'tree:'
    and the digest of its ranges' hexadecimal digests, one after the other.
    """
    probed = materialize(_probed(dealt_for_reading(files.withColumn("__size", F.col("size")).withColumn(
        "size", F.least("size", F.lit(2 * probe)))).withColumn("size", F.col("__size")).drop("__size"), algorithm, probe), "probed")
    small = F.col("size") <= 2 * probe
    again = probed.where(~small & F.col("probe_error").isNull())
    twins = again.groupBy("size", "probe").agg(F.count("*").alias("n")).where("n > 1").select("size", "probe")
    full = again.join(materialize(twins, "twins"), ["size", "probe"], "left_semi")
    if whole_sizes is not None:
        known = again.join(whole_sizes.select("size").distinct(), "size", "left_semi")
        full = full.select(again.columns).unionByName(known.select(again.columns)).dropDuplicates(["path"])
    pieces = full.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(span).cast("bigint"))).alias("start"), F.col("size").alias("all"))         .select("path", "start", F.least(F.col("all") - F.col("start"), F.lit(span)).alias("size"), F.col("start").alias("part"))
    parts = materialize(_ranges_hashed(dealt_for_reading(pieces), algorithm, chunk), "ranges")
    digests = F.transform(F.array_sort(F.collect_list(F.struct("start", "digest"))), lambda p: p["digest"])
    tree = F.concat(F.lit("tree:"), F.sha2(F.array_join("digests", ""), 256))
    if algorithm != "sha256":
        tree = F.concat(F.lit(f"tree:{algorithm}:"), F.sha2(F.array_join("digests", ""), 256))
    whole = parts.groupBy("path").agg(digests.alias("digests"), F.first("digest_error", ignorenulls=True).alias("error"), F.sum("seen").alias("more"))         .select("path", "more", "error", F.when(F.col("error").isNull(), F.when(F.size("digests") == 1, F.col("digests")[0]).otherwise(tree)).alias("whole"))
    return probed.join(whole, "path", "left").select(
        *files.columns, F.when(small, F.col("probe")).otherwise(F.col("whole")).alias("hash"),
        F.coalesce("probe_error", "error").alias("hash_error"), (F.col("seen") + F.coalesce("more", F.lit(0))).alias("read"))
