"""Toxicity scores from confirmed toxic examples and unlabelled text.

Non-negative positive-unlabelled learning: with class prior p, positives P and
a sample U of all texts, the risk of a classifier g is estimated as

    p * R(P, +) + max(0, R(U, -) - p * R(P, -)),

where R(S, y) is the mean logistic loss of g on S for label y.  The part under
max() estimates the risk on clean texts; once it falls below zero the model
has begun to learn the positives by heart, and the step is taken back instead.

Texts are seen as sets of byte 5-grams (A-Z lower-cased, each white space byte
a space), hashed to slots; the model is linear in the presence of the slots
that positives have clearly more often than texts at large.  The classifier is
fitted on a bounded sample of ids (``max_positives``, ``max_unlabelled``, the
first by a hash of the id) on the driver with numpy, from selected slots only;
every text is scored, whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustpan.llm.words import in_blocks, owner, text_bytes
from dustpan.storage import materialize

GRAM, SLOT_BITS = 5, 20
MAX_POSITIVES, MAX_UNLABELLED, MAX_FEATURES = 8_000, 16_000, 4_096
# The prior is taken this much lower than the labels say: where it exceeds the true
# share in U, the estimate of the clean risk falls below zero for good models, too.
CAUTION = 0.9
THRESHOLD = 0.3


class Model(NamedTuple):
    feature: np.ndarray  # int16 per slot: its place in weights, or -1
    weights: np.ndarray
    bias: float


def gram_slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots, text index) of all byte 5-grams; texts shorter than that have none."""
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += np.uint64(32)
    fold[9:14] = 32
    raw, offsets = text_bytes(column)
    counts = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    text = owner(np.concatenate([[0], np.cumsum(counts)]))
    if not len(text):
        return np.zeros(0, np.int64), text
    at = np.arange(len(text)) - (np.cumsum(counts) - counts)[text] + offsets[:-1][text]
    data = fold[raw]
    run = data[:len(data) - GRAM + 1].copy()
    for k in range(1, GRAM):
        run |= data[k:len(data) - GRAM + 1 + k] << np.uint64(8 * k)
    return ((run[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), text


def present(column: pa.Array, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature), each pair once, by text."""
    slots, text = gram_slots(column)
    found = feature[slots]
    hit = found >= 0
    pairs = np.unique(text[hit] << 16 | found[hit].astype(np.int64))
    return pairs >> 16, pairs & 0xFFFF


def _counts(sample: DataFrame) -> DataFrame:
    """(slot, p, u): positives and unlabelled texts that have the slot."""
    def run(batches):
        total = np.zeros((2, 1 << SLOT_BITS), np.int64)
        each = in_blocks(lambda block: block)
        for block in each(batches):
            slots, text = gram_slots(block.column("text"))
            pairs = np.unique(text << SLOT_BITS | slots)
            kind = np.asarray(block.column("positive").to_pylist(), bool)[pairs >> SLOT_BITS]
            slots = pairs & ((1 << SLOT_BITS) - 1)
            for side in (0, 1):
                total[side] += np.bincount(slots[kind == (side == 0)], minlength=1 << SLOT_BITS)
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])],
                                         names=["slot", "p", "u"])

    return (sample.mapInArrow(run, "slot bigint, p bigint, u bigint")
            .groupBy("slot").agg(F.sum("p").alias("p"), F.sum("u").alias("u")))


def _select(counts: DataFrame, positives: int, unlabelled: int, limit: int) -> np.ndarray:
    """Slots of clearly more positives than texts at large, the most telling first."""
    rate, base = F.col("p") / F.lit(float(positives)), (F.col("u") + 1) / F.lit(float(unlabelled + 1))
    expected = base * F.lit(float(positives))
    telling = (counts.where((F.col("p") >= 4) & (F.col("p") - expected >= 5 * F.sqrt(expected + 1)))
               .withColumn("lift", rate / base).where("lift >= 2.5")
               .withColumn("gain", F.col("p") * F.log("lift")).orderBy(F.desc("gain"), "slot").limit(limit))
    return np.array([r["slot"] for r in telling.select("slot").collect()], np.int64)


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, features: int, prior: float,
             steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model; (rows, cols) are the ones of the presence matrix, by row."""
    bound = np.searchsorted(rows, np.arange(len(positive) + 1))
    share_p = positive / max(positive.sum(), 1)
    share_u = ~positive / max((~positive).sum(), 1)
    theta = np.zeros(features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        total = np.concatenate([[0.0], np.cumsum(theta[cols])])
        g = total[bound[1:]] - total[bound[:-1]] + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        # Derivatives of the logistic loss for label + and -.
        plus, minus = s - 1, s
        loss_minus = np.logaddexp(0, g)
        clean = share_u @ loss_minus - prior * (share_p @ loss_minus)
        d_clean = (share_u - prior * share_p) * minus
        d = prior * share_p * plus + d_clean if clean >= 0 else -d_clean
        gradient = np.bincount(cols, d[rows], minlength=features + 1).astype(float)
        gradient[-1] = d.sum()
        gradient[:-1] += l2 * theta[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1])


# Penalties tried; the one whose weights have the least risk on quarters of the sample held back in turn is used.
PENALTIES = (1e-4, 1e-3, 1e-2)


def risk(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, prior: float, weights: np.ndarray, bias: float) -> float:
    """The non-negative risk: logistic losses of positives, and of unlabelled texts less what positives add to it."""
    g = np.bincount(rows, weights[cols], minlength=len(positive)) + bias
    share_p, share_u = positive / max(positive.sum(), 1), ~positive / max((~positive).sum(), 1)
    clean = share_u @ np.logaddexp(0, g) - prior * (share_p @ np.logaddexp(0, g))
    return float(prior * (share_p @ np.logaddexp(0, -g)) + max(clean, 0.0))


def _part(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, chosen: np.ndarray):
    place, mine = np.cumsum(chosen) - 1, chosen[rows]
    return place[rows[mine]], cols[mine], positive[chosen]


def fit_checked(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, part: np.ndarray, features: int,
                prior: float) -> tuple[np.ndarray, float]:
    """``fit_nnpu`` on all rows with the penalty that does best where each ``part`` in turn is held back from a trial fit."""
    def trial(l2: float) -> float:
        total = 0.0
        for k in np.unique(part):
            weights, bias = fit_nnpu(*_part(rows, cols, positive, part != k), features, prior, l2=l2)
            total += risk(*_part(rows, cols, positive, part == k), prior, weights, bias)
        return total

    return fit_nnpu(rows, cols, positive, features, prior, l2=min(PENALTIES, key=trial))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
          held_out: Column | None = None, prior: float | None = None, max_positives: int = MAX_POSITIVES,
          max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES) -> Model:
    """Fit on ``labels`` (id, label) outside ``held_out``, a condition on ``id``.

    Rows with null ids, labels or texts are not learned from.  The class prior
    is CAUTION times the share of 1 among the labels used, unless given.  Without any
    positive (or any text) every score is the prior.
    """
    used = ~held_out if held_out is not None else F.lit(True)
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & used).select(
        F.col(id).alias("id"), (F.col(label) == 1).alias("positive"))
    if prior is None:
        share = known.agg(F.avg(F.col("positive").cast("double")).alias("p")).first()["p"]
        prior = 0.5 if share is None else share * CAUTION
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    draw = F.xxhash64("id", F.lit(11))
    chosen = known.where("positive").select("id", F.lit(True).alias("positive")).distinct().orderBy(draw, "id").limit(max_positives)
    others = (docs.where(F.col(id).isNotNull() & used).select(F.col(id).alias("id"), F.lit(False).alias("positive"))
              .orderBy(draw, "id").limit(max_unlabelled))
    # Ids only, at most max_positives + max_unlabelled of them: small enough to be sent to all tasks.
    ids = materialize(chosen.unionByName(others), "ids")
    sample = materialize(docs.where(F.col(id).isNotNull() & F.col(text).isNotNull())
                         .select(F.col(id).alias("id"), F.col(text).alias("text"))
                         .join(F.broadcast(ids), "id")
                         .select("positive", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(4)).alias("part"), "text"), "sample")
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    feature = np.full(1 << SLOT_BITS, -1, np.int16)
    empty = Model(feature, np.zeros(0), float(np.log(prior / (1 - prior))))
    if not sizes.get(True) or not sizes.get(False):
        return empty
    slots = _select(_counts(sample), sizes[True], sizes[False], max_features)
    if not len(slots):
        return empty
    feature[slots] = np.arange(len(slots))

    def each(block: pa.RecordBatch) -> pa.RecordBatch:
        at, found = present(block.column("text"), feature)
        bound = np.searchsorted(at, np.arange(block.num_rows + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [block.column("positive"), block.column("part"), pa.ListArray.from_arrays(bound, pa.array(found, pa.int32()))],
            names=["positive", "part", "found"])

    rows = sample.mapInArrow(in_blocks(each), "positive boolean, part bigint, found array<int>").toArrow()
    found = rows.column("found").combine_chunks()
    positive, part = np.asarray(rows.column("positive").to_pylist(), bool), np.asarray(rows.column("part").combine_chunks())
    weights, bias = fit_checked(owner(np.asarray(found.offsets)), np.asarray(found.flatten()), positive, part, len(slots), prior)
    return Model(feature, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a column ``to`` (0 to 1); an existing column of that name is replaced.

    A null, empty or very short text has no 5-gram and gets the model's base score.
    """
    kept = [f for f in docs.schema.fields if f.name != to]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{to}` double"

    def each(block: pa.RecordBatch) -> pa.RecordBatch:
        at, found = present(block.column(text), model.feature)
        g = np.bincount(at, model.weights[found], minlength=block.num_rows) + model.bias
        columns = [block.column(f.name) for f in kept]
        return pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-np.clip(g, -500, 500))))],
                                          names=[*(f.name for f in kept), to])

    return docs.select([f"`{f.name}`" for f in kept]).mapInArrow(in_blocks(each, text), schema)


def reject_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged."""
    return score(docs, model, text, "__toxicity").where(F.col("__toxicity") < threshold).drop("__toxicity")
