"""Directory trees on mounted file systems as an inventory table.

Spark's own file sources hide dot files, folders starting with '_' or '.',
empty files and all directories, which are exactly the entries of interest.
The lister runs in rounds: each task walks the directories it was given until
it has met ``budget`` entries and hands the unvisited ones back; the next
round deals those out evenly.  A tree with one enormous branch therefore
spreads over the cluster, and every round is a written table.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustpan.functions.paths import basename, depth_of, parent_of
from dustpan.storage import new_location

LISTING = ("root_idx int, path string, entry_type string, link_target string, "
           "size bigint, mtime timestamp_ntz, created timestamp_ntz, error string")
_BATCH = 5000
# Texts of a tree to be written that a task holds as strings.
_TOGETHER = 64


def _reason(err: OSError) -> str:
    return f"{type(err).__name__}: {err.strerror or err}"


def _moment(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)


def _row(root_idx, path, kind, target=None, info=None, error=None):
    mtime = info and _moment(info.st_mtime)
    # Not every file system tells when a file was created.
    born = getattr(info, "st_birthtime", None)
    size = info.st_size if info and kind == "file" else None
    return root_idx, path, kind, target, size, mtime, born and _moment(born), error


def _link_row(root_idx, entry):
    """Links count as files when they lead to one; other links stay links."""
    try:
        info = entry.stat()
    except OSError:
        return _row(root_idx, entry.path, "link", "broken")
    if stat.S_ISREG(info.st_mode):
        return _row(root_idx, entry.path, "file", "file", info)
    if stat.S_ISDIR(info.st_mode):
        try:
            with os.scandir(entry.path) as inside:
                target = "dir" if next(inside, None) else "empty_dir"
        except OSError:
            target = "dir"
        return _row(root_idx, entry.path, "link", target, info)
    return _row(root_idx, entry.path, "other", "other", info)


def _entry_row(root_idx, entry):
    if entry.is_symlink():
        return _link_row(root_idx, entry)
    try:
        info = entry.stat(follow_symlinks=False)
    except OSError as err:
        return _row(root_idx, entry.path, "other", error=_reason(err))
    return _row(root_idx, entry.path, "file" if stat.S_ISREG(info.st_mode) else "other", info=info)


def _readable(row):
    """Names that are not valid text cannot be addressed later: report, never act."""
    try:
        row[1].encode("utf-8")
        return row
    except UnicodeEncodeError:
        shown = os.fsencode(row[1]).decode("utf-8", "backslashreplace")
        return (row[0], shown, "other", *row[3:7], "name is not valid text")


def _visit(root_idx, path, is_root):
    """Yield (row, None) per entry, (None, path) per sub-directory, then the directory."""
    try:
        info = os.stat(path)
        with os.scandir(path) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    yield None, entry.path
                else:
                    yield _entry_row(root_idx, entry), None
        error = None
    except OSError as err:
        info, error = None, _reason(err)
    if error or not is_root:
        yield _row(root_idx, path, "root" if is_root else "dir", info=info, error=error), None


def _walk(budget: int):
    columns = [c.split()[0] for c in LISTING.split(", ")] + ["pending", "is_root"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []
        seen = 0

        def flush():
            frame = pd.DataFrame(rows, columns=columns)
            frame["size"] = frame["size"].astype("Int64")
            frame["mtime"], frame["created"] = pd.to_datetime(frame["mtime"]), pd.to_datetime(frame["created"])
            rows.clear()
            return frame

        for batch in batches:
            todo = list(batch[["root_idx", "path", "is_root"]].itertuples(index=False, name=None))
            while todo:
                root_idx, path, is_root = todo.pop()
                try:
                    path.encode("utf-8")
                except UnicodeEncodeError:
                    rows.append((*_readable(_row(root_idx, path, "dir")), False, is_root))
                    continue
                if seen > budget:
                    rows.append((*_row(root_idx, path, "dir"), True, is_root))
                else:
                    for row, below in _visit(root_idx, path, is_root):
                        seen += 1
                        if below is not None:
                            todo.append((root_idx, below, False))
                        else:
                            rows.append((*_readable(row), False, False))
                        if len(rows) >= _BATCH:
                            yield flush()
        if rows:
            yield flush()

    return run


def list_entries(roots: DataFrame, budget: int = 100_000) -> DataFrame:
    """Everything below the roots, roots excluded.

    ``roots`` holds (root_idx, root) as left by ``normalize_roots``.  A root or
    directory that cannot be read is a row with ``error``.
    """
    spark = roots.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    base = new_location(spark, "listing")
    frontier = roots.select("root_idx", F.col("root").alias("path"), F.lit(True).alias("is_root"))
    step = 0
    while True:
        here = f"{base}/round={step}"
        (frontier.repartition(tasks).mapInPandas(_walk(budget), LISTING + ", pending boolean, is_root boolean")
         .write.parquet(here))
        frontier = (spark.read.parquet(here).where("pending")
                    .select("root_idx", "path", "is_root"))
        if frontier.isEmpty():
            break
        step += 1
    return (spark.read.parquet(base).where("not pending").drop("pending", "is_root", "round")
            .select("root_idx", "path", parent_of("path").alias("parent"),
                    basename("path").alias("name"), depth_of("path").alias("depth"),
                    "entry_type", "link_target", "size", "mtime", "created", "error"))


def regular_files(inventory: DataFrame) -> DataFrame:
    """Entries that resolve to a file and could be read."""
    return inventory.where((F.col("entry_type") == "file") & F.col("error").isNull())


def list_files(roots: DataFrame, **options) -> DataFrame:
    return regular_files(list_entries(roots, **options))


def error_ledger(inventory: DataFrame) -> DataFrame:
    """What could not be read, and why; the scan itself went on."""
    return inventory.where(F.col("error").isNotNull()).select("path", "entry_type", "error")


def _writer(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            # A few texts at a time become strings; the batch itself is left as it came.
            for at in range(0, rows.num_rows, _TOGETHER):
                part = rows.slice(at, _TOGETHER)
                for path, kind, content in zip(*(part.column(name).to_pylist() for name in ("path", "entry_type", "content")), strict=True):
                    full = target + path
                    if kind == "dir":
                        os.makedirs(full, exist_ok=True)
                        continue
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    with open(full, "wb") as handle:
                        handle.write((content or "").encode("utf-8"))
            yield pa.RecordBatch.from_pydict({"written": pa.array([rows.num_rows], pa.int64())})

    return run


def write_tree(entries: DataFrame, target: str) -> DataFrame:
    """Create the files and directories of an inventory below a mounted folder.

    ``entries`` needs path, entry_type and, for files, content (string).
    Re-runs overwrite, so a repeated task leaves the same tree.
    """
    return entries.select("path", "entry_type", "content").mapInArrow(_writer(target), "written bigint")


def roots_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(paths)), "root_idx int, root string")
