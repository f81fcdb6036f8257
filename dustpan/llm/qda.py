"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Each text becomes a short vector of transformed statistics.  Per class the
mean and covariance come from sums over all labelled texts, added up by Spark.
A class covariance is shrunk twice: towards the pooled one (``to_pooled``) and
towards a multiple of the identity (``to_identity``), after scaling by the
pooled deviations.  The Cholesky factors are computed once; a text's score is
the logistic of the difference of the two log-densities plus the log ratio of
the class sizes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustpan.llm.words import in_blocks, owner, per_text, text_bytes, words_of
from dustpan.storage import materialize

TO_POOLED, TO_IDENTITY = 0.1, 0.05
THRESHOLD = 0.3

# Byte classes counted per text.
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "white": [9, 10, 11, 12, 13, 32],
    "mark": [ord(c) for c in "#*$%&|<>"], "stop": [ord(c) for c in ".,;:"], "shout": [ord(c) for c in "!?"],
    "other": [ord(c) for c in "\"'()+-/=@[\\]^_`{}~"],
}
NAMES = ("words", "word_length", "line_words", *_CLASSES, "distinct", "distinct_pairs", "echo", "repeated_lines")


class Model(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray    # class x statistic
    factors: np.ndarray  # class x inverse Cholesky factor
    offsets: np.ndarray  # class: log share less half the log determinant


def _distinct(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Distinct values per text."""
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[fresh], minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of NAMES per text; a null text counts as empty (all zero)."""
    n = len(column)
    raw, offsets = text_bytes(column)
    words = words_of(column)
    size, count = np.diff(offsets), np.diff(words.bound)
    kind = np.full(256, len(_CLASSES), np.int64)
    for k, members in enumerate(_CLASSES.values()):
        kind[list(members)] = k
    wide = len(_CLASSES) + 1
    tally = np.bincount(owner(offsets) * wide + kind[raw], minlength=n * wide).reshape(n, wide)
    of = owner(words.bound)
    some = np.maximum(count, 1)
    lengths = per_text((words.ends - words.starts).astype(float), words.bound)
    same = np.zeros(len(of))
    pair_text = of[1:][of[1:] == of[:-1]] if len(of) else of
    both = of[1:] == of[:-1]
    same[1:] = both & (words.hashes[1:] == words.hashes[:-1])
    pairs = (words.hashes[1:] * np.uint64(31) + words.hashes[:-1])[both]
    # A line is named by the sum of its words' hashes, each times its place's odd number.
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    line = breaks[words.starts]
    first = np.ones(len(of), bool)
    first[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    place = np.arange(len(of)) - np.repeat(at, np.diff(np.append(at, len(of))))
    named = np.add.reduceat(words.hashes * (2 * place + 1).astype(np.uint64), at) if len(at) else words.hashes
    lines = np.bincount(of[at], minlength=n)
    columns = [np.log1p(count), np.log1p(lengths / some), np.log1p(count / np.maximum(lines, 1))]
    columns += [np.sqrt(tally[:, k] / np.maximum(size, 1)) for k in range(len(_CLASSES))]
    columns += [_distinct(words.hashes, of, n) / np.sqrt(some), _distinct(pairs, pair_text, n) / some,
                per_text(same, words.bound) / some,
                np.sqrt((lines - _distinct(named, of[at], n)) / np.maximum(lines, 1))]
    return np.stack(columns, axis=1)


def with_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the statistics of every row's whole text."""
    kind = docs.schema[id].dataType.simpleString()

    def each(block: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(block.column(text))
        flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1))
        return pa.RecordBatch.from_arrays([block.column(id), flat], names=[id, "x"])

    return docs.select(id, text).mapInArrow(in_blocks(each, text), f"`{id}` {kind}, x array<double>")


def _moments(rows: DataFrame, d: int) -> dict[int, np.ndarray]:
    """Per class the sum of outer products of (1, x), added up over all rows."""
    def run(batches):
        total = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            x = np.hstack([np.ones((len(x), 1)), x])
            y = np.asarray(batch.column("y"))
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        cell = np.tile(np.arange((d + 1) ** 2), 2)
        side = np.repeat(np.arange(2), (d + 1) ** 2)
        yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(cell), pa.array(total.reshape(-1))],
                                         names=["y", "cell", "v"])

    sums = rows.mapInArrow(run, "y bigint, cell bigint, v double").groupBy("y", "cell").agg(F.sum("v").alias("v"))
    out = {0: np.zeros((d + 1, d + 1)), 1: np.zeros((d + 1, d + 1))}
    for r in sums.collect():  # 2 * (d + 1)**2 numbers
        out[r["y"]].reshape(-1)[r["cell"]] = r["v"]
    return out


def fit(moments: dict[int, np.ndarray], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Model:
    """The discriminant from class moments; a class without rows takes the pooled figures."""
    both = moments[0] + moments[1]
    d, n = len(both) - 1, max(both[0, 0], 1.0)
    centre = both[0, 1:] / n
    within = np.zeros((d, d))
    means, scatter = [], []
    for k in (0, 1):
        m = moments[k]
        mean = m[0, 1:] / m[0, 0] if m[0, 0] else centre
        means.append(mean)
        scatter.append(m[1:, 1:] - m[0, 0] * np.outer(mean, mean))
        within += scatter[-1]
    pooled = within / n
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    pooled = pooled / np.outer(scale, scale)
    factors, offsets = [], []
    for k in (0, 1):
        size = moments[k][0, 0]
        own = scatter[k] / np.outer(scale, scale) / size if size > 1 else pooled
        cov = (1 - to_pooled) * own + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log((size + 1) / (n + 2)) - np.log(np.diag(lower)).sum())
    return Model(centre, scale, (np.array(means) - centre) / scale, np.array(factors), np.array(offsets))


def posterior(x: np.ndarray, model: Model) -> np.ndarray:
    """Probability of class 1 for rows of statistics."""
    z = (x - model.centre) / model.scale
    density = [model.offsets[k] - 0.5 * (((z - model.means[k]) @ model.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def quality_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
                   label: str = "quality", held_out: Column | None = None) -> DataFrame:
    """(id, score) per row of ``docs``; score is the probability that the label is 1.

    Learns from rows of ``labels`` (id, label) outside ``held_out``, a condition
    on ``id``; rows with null ids or labels, or labels other than 0 and 1, are
    not learned from.  Null and empty texts have all-zero statistics and are
    scored as such; without labels every score is 0.5.
    """
    measured = materialize(with_statistics(docs, id, text), "statistics")
    used = ~held_out if held_out is not None else F.lit(True)
    known = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1) & used).select(
        F.col(id).alias("__id"), F.col(label).cast("bigint").alias("y"))
    rows = measured.join(known, F.col(id) == F.col("__id")).select("x", "y")
    model = fit(_moments(rows, len(NAMES)))

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(posterior(x, model))], names=[id, "score"])

    return measured.mapInArrow(run, f"`{id}` {measured.schema[id].dataType.simpleString()}, score double")
