"""New files compared with the known contents as they arrive.

What is known lives in the stream's own state, keyed and kept in RocksDB: the
(path, content) pairs announced so far, and the contents that have a first
file.  A micro-batch therefore looks up and writes as many keys as it has rows,
however many files have arrived before; the table of results is only appended
to and never read by the stream.

A content with a third of all files is no hot key.  Announcements are told
apart by path and content, which spreads them.  Then each slice of a batch
sends only its first file per content on to that content's key; the others are
copies already and pass through lanes dealt by path.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARRIVAL = "hash string, ord bigint, path string, size bigint, status string"
# Lanes for files known to be copies before their content is looked up.
LANES = 64

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A commit writes a batch's changes, not the whole store.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _dealt(slices: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per slice and content the first file is a candidate (lane -1), every other one a copy in a lane."""
    for rows in slices:
        rows = rows.sort_values(["ord", "path"], kind="stable")
        lanes = [crc32(path.encode("utf-8", "surrogatepass")) % LANES for path in rows["path"]]
        rows["lane"] = pd.Series(lanes, rows.index, dtype="int32").where(rows["hash"].duplicated(), -1)
        rows["content"] = rows["hash"].where(rows["lane"] < 0, "")
        yield rows


_FILE = ["hash", "ord", "path", "size", "status"]


def _judged(key: tuple, slices: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Status of a lane's copies, or of a content's candidates, at most one per slice.

    Most contents have a single candidate, so that a group costs little more
    than its state: whatever pandas does for each would be most of a batch.
    """
    lane, _ = key
    if lane >= 0:
        for rows in slices:
            rows["status"] = "duplicate"
            yield rows[_FILE]
        return
    parts = list(slices)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts)
    if len(rows) > 1:
        rows = rows.sort_values(["ord", "path"], kind="stable")
    status = ["duplicate"] * len(rows)
    if not state.exists:
        status[0] = "new"
        state.update((int(rows["ord"].iloc[0]),))
    rows["status"] = status
    yield rows[_FILE]


def judge(arrivals: DataFrame) -> DataFrame:
    """Add ``status`` to a stream of files: 'new' for the first file of a content, else 'duplicate'.

    The first file is the one that arrived first, and the smallest (ord, path)
    of those that arrived in the same batch.  A path announced again with the
    same content is dropped; files without a hash could not be read and are
    nobody's copy, so they are dropped too.
    """
    fresh = arrivals.where("hash IS NOT NULL").select("hash", "ord", "path", "size").dropDuplicates(["path", "hash"])
    dealt = fresh.mapInPandas(_dealt, "hash string, ord bigint, path string, size bigint, lane int, content string")
    return dealt.groupBy("lane", "content").applyInPandasWithState(_judged, ARRIVAL, "first bigint", "append", "NoTimeout")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Settings a query takes over when it starts; the session has its own back afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _partitions(spark: SparkSession) -> int:
    """One state partition per core, or fewer if the session asks for fewer."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def watch_duplicates(arrivals: DataFrame, index: str, checkpoint: str, partitions: int | None = None):
    """Start a query over a stream of hashed files that adds each batch's files with their status to the index.

    Each micro-batch owns one part of the index, and its state is that of the
    checkpoint, so a batch that is run again writes the same part again: a
    restart neither loses nor repeats files.

    Every state partition is opened and committed in every batch, whatever the
    batch brings, and adaptive execution does not merge them.  So there is one
    per core, or ``partitions``; a checkpoint keeps the number it began with.
    """
    spark = arrivals.sparkSession
    settings = _STATE | {"spark.sql.shuffle.partitions": str(partitions or _partitions(spark))}
    # An empty first part, so that the index can be read before anything arrives.
    spark.createDataFrame([], ARRIVAL).write.mode("overwrite").parquet(f"{index}/batch=-1")
    with _settings(spark, settings):
        return (judge(arrivals).writeStream
                .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{index}/batch={n}"))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def indexed_files(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema(ARRIVAL + ", batch bigint").parquet(index)


def incremental_summary(indexed: DataFrame) -> DataFrame:
    """Per content with copies: how many files arrived and how many were redundant."""
    return (indexed.groupBy("hash")
            .agg(F.count("*").alias("copies"),
                 F.count_if(F.col("status") == "duplicate").alias("redundant_files"))
            .where("copies > 1"))
