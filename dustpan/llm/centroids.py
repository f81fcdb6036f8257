"""Centroid clustering of integer vectors over dictionaries of distinct subvectors.

Vectors are cut into blocks of neighbouring components.  Spark gathers the
distinct subvectors of every block from all vectors, and each vector is stored
once as one code per block.  In a round the exact squared distances of the
dictionary's subvectors to the centroids' parts are computed once; a vector's
distances are the sums of those of its codes, and a cluster's component sums
come from how often it holds each code.  All figures are whole numbers.

Which components form a block follows from the data: blocks of ``WIDTHS[0]``
components are halved until their distinct subvectors number at most
``ENTRIES``.  So the dictionary, which travels with the job, is bounded by the
number of components times ``ENTRIES`` whatever the table's size.  A single
component with more distinct values has no dictionary; its values are stored
beside the codes and compared directly, with the same result.  (Components of
unit vectors have at most 2,049 values at the usual scale.)
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustpan.storage import materialize

SCALE = 1024
WIDTHS = (4, 2, 1)
ENTRIES = 4096
# Beyond it a squared distance of 64 components might not fit a long.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, size: int, id: str = "vec_id", vector: str = "embedding",
                  scale: int = SCALE) -> DataFrame:
    """(id, x): vectors of ``size`` components, none null or non-finite, as floor(scale * component)."""
    limit = F.lit(float("inf"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < limit)
    fit = (F.size(vector) == size) & F.forall(vector, finite)
    return vectors.where(F.coalesce(fit, F.lit(False))).select(
        F.col(id).alias("id"), F.transform(vector, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("x"))


class Block(NamedTuple):
    start: int
    width: int
    entries: np.ndarray  # distinct subvectors, one per row

    def packed(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Distinct values per component, the entries as sorted numbers, and which entry each number is."""
        values = [np.unique(self.entries[:, k]) for k in range(self.width)]
        keys = _pack(self.entries, values)
        order = np.argsort(keys)
        return values, keys[order], order


def _pack(x: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """One number per row, from the rank of each component among its values (at most ENTRIES ** width)."""
    key = np.zeros(len(x), np.int64)
    for k, own in enumerate(values):
        key = key * len(own) + np.searchsorted(own, x[:, k])
    return key


class Layout(NamedTuple):
    size: int
    blocks: list[Block]
    bare: list[int]  # components without a dictionary

    @property
    def offsets(self) -> np.ndarray:
        """First code of each block; codes of all blocks are numbered on."""
        return np.concatenate([[0], np.cumsum([len(b.entries) for b in self.blocks])]).astype(np.int64)


def _vectors(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def distinct_subvectors(points: DataFrame, size: int, entries: int = ENTRIES) -> DataFrame:
    """(width, start, part): distinct subvectors of all blocks of all widths.

    A task whose own rows hold more than ``entries`` in a block says so by a
    null ``part`` instead of listing them.
    """
    blocks = [(w, at) for w in WIDTHS for at in range(0, size, w) if at + w <= size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray | None] = {b: np.zeros((0, b[0]), np.int64) for b in blocks}
        for batch in batches:
            x = _vectors(batch, "x", size)
            for (w, at), own in found.items():
                if own is not None:
                    own = np.unique(np.concatenate([own, x[:, at:at + w]]), axis=0)
                    found[w, at] = own if len(own) <= entries else None
        for (w, at), own in found.items():
            n = 1 if own is None else len(own)
            parts = pa.array([None], pa.list_(pa.int64())) if own is None else pa.ListArray.from_arrays(
                pa.array(np.arange(0, n * w + 1, w), pa.int32()), pa.array(own.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, w)), pa.array(np.full(n, at)), parts],
                                             names=["width", "start", "part"])

    return points.select("x").mapInArrow(run, "width bigint, start bigint, part array<bigint>").distinct()


def choose_layout(points: DataFrame, size: int, entries: int = ENTRIES) -> Layout:
    """The widest blocks whose dictionaries have at most ``entries`` subvectors."""
    found = materialize(distinct_subvectors(points, size, entries), "subvectors")
    fits = {(r["width"], r["start"]) for r in found.groupBy("width", "start")
            .agg(F.count("*").alias("n"), F.count("part").alias("parts")).collect()  # at most 2 * size rows
            if r["n"] == r["parts"] <= entries}
    chosen, at = [], 0
    while at < size:
        width = next((w for w in WIDTHS if at % w == 0 and (w, at) in fits), 0)
        if width:
            chosen.append((width, at))
        at += width or 1
    kept = found.where(F.struct("width", "start").isin([F.struct(F.lit(w).cast("bigint"), F.lit(a).cast("bigint"))
                                                       for w, a in chosen])) if chosen else found.limit(0)
    parts: dict[tuple[int, int], list] = {b: [] for b in chosen}
    for r in kept.collect():  # at most size * entries rows
        parts[r["width"], r["start"]].append(r["part"])
    blocks = [Block(at, w, np.array(sorted(parts[w, at]), np.int64).reshape(-1, w)) for w, at in chosen]
    covered = {at + k for w, at in chosen for k in range(w)}
    return Layout(size, blocks, [k for k in range(size) if k not in covered])


def encode(points: DataFrame, layout: Layout) -> DataFrame:
    """(id, codes, bare): per vector the code of each block, and the components without a dictionary."""
    kind = points.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(b, *b.packed()) for b in layout.blocks]
        for batch in batches:
            x = _vectors(batch, "x", layout.size)
            codes = np.zeros((len(x), len(tables)), np.int32)
            for k, (b, values, keys, order) in enumerate(tables):
                own = np.searchsorted(keys, _pack(x[:, b.start:b.start + b.width], values))
                codes[:, k] = layout.offsets[k] + order[own]
            cut = lambda width: pa.array(np.arange(len(x) + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(cut(len(tables)), pa.array(codes.reshape(-1))),
                 pa.ListArray.from_arrays(cut(len(layout.bare)), pa.array(x[:, layout.bare].reshape(-1)))],
                names=["id", "codes", "bare"])

    return points.mapInArrow(run, f"id {kind}, codes array<int>, bare array<bigint>")


def entry_distances(layout: Layout, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every dictionary entry (row) to the same components of every centroid (column)."""
    rows = [np.zeros((0, len(centroids)), np.int64)]
    for b in layout.blocks:
        step = b.entries[:, None, :] - centroids[None, :, b.start:b.start + b.width]
        rows.append((step * step).sum(axis=2))
    return np.concatenate(rows)


def _nearest(batch: pa.RecordBatch, layout: Layout, centroids: np.ndarray, table: np.ndarray):
    """(codes, bare, cluster, distance) of a batch; of equal distances the smaller number wins."""
    codes, bare = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("codes", "bare"))
    codes, bare = codes.reshape(len(batch), -1), bare.reshape(len(batch), -1)
    distance = np.zeros((len(batch), len(centroids)), np.int64)
    for k in range(len(layout.blocks)):
        distance += table[codes[:, k]]
    for k, component in enumerate(layout.bare):
        step = bare[:, k, None] - centroids[None, :, component]
        distance += step * step
    cluster = distance.argmin(axis=1)
    return codes, bare, cluster, distance[np.arange(len(batch)), cluster]


def _total(values: np.ndarray) -> int:
    """Exact sum of non-negative longs."""
    return (int((values >> 31).sum()) << 31) + int((values & ((1 << 31) - 1)).sum())


def _moments(encoded: DataFrame, layout: Layout, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Per non-empty cluster its vectors, their distances' sum, and their sum by component."""
    table, k = entry_distances(layout, centroids), len(centroids)
    entries = int(layout.offsets[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k, entries), np.int64)
        sums = np.zeros((k, layout.size), np.int64)
        count, spread = [0] * k, [0] * k
        for batch in batches:
            codes, bare, cluster, distance = _nearest(batch, layout, centroids, table)
            if entries:
                where = (cluster[:, None] * entries + codes).reshape(-1)
                held += np.bincount(where, minlength=k * entries).reshape(k, entries)
            for c in range(k):
                mine = cluster == c
                count[c] += int(mine.sum())
                spread[c] += _total(distance[mine])
                sums[c, layout.bare] += bare[mine].sum(axis=0, dtype=np.int64)
        for n, b in enumerate(layout.blocks):
            sums[:, b.start:b.start + b.width] += held[:, layout.offsets[n]:layout.offsets[n + 1]] @ b.entries
        # Place -2 is the count, -1 the distances, the others components.
        of = [c for c in range(k) if count[c]]
        rows = [(c, at, value) for c in of for at, value in [(-2, count[c]), (-1, spread[c]), *enumerate(sums[c].tolist())]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([Decimal(r[2]) for r in rows], pa.decimal128(38, 0))], names=["cluster", "at", "v"])

    rows = (encoded.mapInArrow(run, "cluster bigint, at bigint, v decimal(38,0)")
            .groupBy("cluster", "at").agg(F.sum("v").alias("v")).collect())  # k * (size + 2) numbers
    found = {(r["cluster"], r["at"]): int(r["v"]) for r in rows}
    return {c: (found[c, -2], found[c, -1], [found[c, j] for j in range(layout.size)])
            for c in sorted({c for c, _ in found})}


def first_centroids(points: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors whose ids hash smallest; of equal ids the smaller vector first, null ids last."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r["x"] for r in points.orderBy(draw.asc_nulls_last(), "x").limit(k).select("x").collect()]


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64,
                    id: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
                    entries: int = ENTRIES) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every fitting vector.

    Rounds assign all vectors to the nearest centroid (squared distance, the
    smaller number of equals) and move each centroid to its vectors' mean,
    rounded down by component; one without vectors stays.  A last assignment
    follows.  Vectors of another size or with a null or non-finite component
    are left out; null ids and repeated rows count like any other; with fewer
    than ``k`` vectors there are fewer centroids, without any an empty result.
    Components beyond +-LARGEST after scaling are refused, since distances
    would not fit a long.
    """
    points = materialize(whole_vectors(vectors, size, id, vector, scale), "points")
    low, high = points.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if low is not None and max(-low, high) > LARGEST:
        raise ValueError(f"components from {low} to {high} after scaling exceed {LARGEST}")
    start = first_centroids(points, k, seed)
    centroids = np.array(start, np.int64).reshape(-1, size)
    layout = choose_layout(points, size, entries)
    encoded = materialize(encode(points, layout), "codes")
    if start:
        for _ in range(rounds):
            for c, (n, _, sums) in _moments(encoded, layout, centroids).items():
                centroids[c] = [s // n for s in sums]
    return _assigned(encoded, layout, centroids, id)


def _per_cluster(values: list, kind: str) -> Column:
    """The value of the row's cluster."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def _assigned(encoded: DataFrame, layout: Layout, centroids: np.ndarray, id: str) -> DataFrame:
    moments = _moments(encoded, layout, centroids) if len(centroids) else {}
    table = entry_distances(layout, centroids)
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, cluster, distance = _nearest(batch, layout, centroids, table)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                names=["id", "cluster", "distance"])

    if not moments:
        return encoded.limit(0).select(
            F.col("id").alias(id), F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in
                                                               ("distance", "cluster_inertia", "inertia")],
            F.array().cast("array<bigint>").alias("centroid"))
    spreads = [moments[c][1] if c in moments else 0 for c in range(len(centroids))]
    places = F.element_at(F.array(*[F.array(*[F.lit(v).cast("bigint") for v in c]) for c in centroids.tolist()]),
                          F.col("cluster") + 1)
    return encoded.mapInArrow(run, f"id {kind}, cluster int, distance bigint").select(
        F.col("id").alias(id), "cluster", "distance", _per_cluster(spreads, "bigint").alias("cluster_inertia"),
        F.lit(sum(spreads)).cast("bigint").alias("inertia"), places.alias("centroid"))
