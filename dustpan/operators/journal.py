"""What a job with side effects has fixed and done, so that a second attempt goes on.

A journal is a mounted folder that all executors share.  Tables a job depends
on are written into it once (``fixed``); an action's tasks append a line with
the time to a file of their own as soon as each item is done (``act``).  A job
that broke off, with its driver or its executors, is started again with the
same journal: fixed tables are read instead of made, items with an outcome are
left alone, and an item that went just before its outcome could be written is
known from the manifest, which says what was there at the start.  The first
outcome of an item counts, so nothing is told twice.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustpan.functions.paths import depth_of
from dustpan.storage import new_mounted_dir

RESULTS = "path string, entry_type string, outcome string, error string, ts timestamp_ntz"
# Items per task at least, so that few items are not dealt to many tasks.
ITEMS_PER_TASK = 1000


class Journal:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        """``folder`` names the journal of an earlier attempt, or one to begin; without it a job cannot be taken up again."""
        self.spark = spark
        self.folder = folder or new_mounted_dir(spark, "journal")

    def fixed(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name, made and written if no attempt has done so."""
        path = f"{self.folder}/{name}"
        if not os.path.exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def act(self, step: str, items: Callable[[], DataFrame], action: Callable[[str], str]) -> DataFrame:
        """Results (see RESULTS) of ``action`` on the items (path, entry_type and, if known, device) of a step.

        The action names its outcome; an ``OSError`` is the outcome 'failed'.
        Items are dealt by device, deepest first, to tasks of equal size.
        """
        if self.spark.conf.get("spark.speculation", "false") == "true":
            raise RuntimeError("two attempts of one task must not act side by side: switch spark.speculation off")
        manifest = self.fixed(f"{step}/manifest", lambda: _with_presence(items()))
        notes = f"{self.folder}/{step}/outcomes"
        os.makedirs(notes, exist_ok=True)
        # Listed anew each time: the tasks add files.
        told = lambda: self.spark.read.schema(RESULTS).json(notes).where("path IS NOT NULL")

        def results() -> DataFrame:
            left = manifest.join(told().select("path"), "path", "left_anti")
            in_order(left).mapInPandas(_noting(action, notes), "done bigint").agg(F.sum("done")).collect()
            return told().groupBy("path").agg(
                F.min_by(F.struct("entry_type", "outcome", "error", "ts"), F.struct("ts", "outcome")).alias("first")).select("path", "first.*")

        return self.fixed(f"{step}/results", results)


def in_order(items: DataFrame) -> DataFrame:
    """Items dealt to tasks in slices of their order: by device, deepest first, then by path."""
    device = F.col("device") if "device" in items.columns else F.lit(None).cast("string")
    rows = items.select("path", "entry_type", "present", device.alias("device"), depth_of("path").alias("depth"))
    order = [F.col("device"), F.col("depth").desc(), F.col("path")]
    tasks = max(1, min(items.sparkSession.sparkContext.defaultParallelism, items.count() // ITEMS_PER_TASK))
    return rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


def _noting(action: Callable[[str], str], notes: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(f"{notes}/{uuid.uuid4().hex}.json", "w", encoding="ascii") as file:
            for rows in batches:
                for path, kind, present in zip(rows["path"], rows["entry_type"], rows["present"], strict=True):
                    error = None
                    try:
                        outcome = action(path)
                        if outcome == "absent" and present:
                            outcome = "deleted"
                    except OSError as err:
                        outcome, error = "failed", f"{type(err).__name__}: {err.strerror or err}"
                    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")
                    file.write(json.dumps({"path": path, "entry_type": kind, "outcome": outcome, "error": error, "ts": now}) + "\n")
                    file.flush()
                yield pd.DataFrame({"done": [len(rows)]})

    return run


def _with_presence(items: DataFrame) -> DataFrame:
    columns = ["path", "entry_type", *(["device"] if "device" in items.columns else [])]
    schema = ", ".join(f"{c} string" for c in columns) + ", present boolean"

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(present=[os.path.lexists(path.split("\0")[0]) for path in rows["path"]])

    return items.select(*[F.col(c).cast("string").alias(c) for c in columns]).mapInPandas(look, schema)


def planned(items: DataFrame) -> DataFrame:
    """The results of a dry run."""
    nothing = F.lit(None)
    return items.select("path", "entry_type", F.lit("planned").alias("outcome"), nothing.cast("string").alias("error"),
                        nothing.cast("timestamp_ntz").alias("ts"))
