"""Centroid clustering against whole-number arithmetic on single vectors."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from dustpan.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, k=8, rounds=10, seed=3, size=64):
    kept = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows
            if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    name = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centres = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for n in range(len(centres)):
            mine = [x for (_, x), c in zip(kept, of, strict=True) if c == n]
            if mine:
                centres[n] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    last = [nearest(x) for _, x in kept]
    spread = [sum(d for d, c in last if c == n) for n in range(len(centres))]
    return sorted(((i, c, d, spread[c], sum(spread), tuple(centres[c])) for (i, _), (d, c) in zip(kept, last, strict=True)), key=repr)


def clustered(spark, rows, **options):
    vectors = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = centroids.cluster_vectors(vectors, **options).collect()
    return sorted(((*tuple(r)[:5], tuple(r["centroid"])) for r in got), key=repr)


def table(n, size=64, seed=1, spread=0.1):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    return [(i, [m + rng.gauss(0, spread) for m in rng.choice(middles)]) for i in range(n)]


def test_odd_vectors(spark):
    rows = table(60)
    x = rows[0][1]
    rows += [(None, x), (7, x), (0, x), (0, x), (61, None), (62, []), (63, x[:63]), (64, x + [0.0]), (65, [None] + x[1:]),
             (66, [math.nan] + x[1:]), (67, [-math.inf] + x[1:]), (68, [0.0] * 64), (69, [-0.00001] * 64), (70, [100.5] * 64)]
    assert clustered(spark, rows) == plain(rows)


@pytest.mark.parametrize("entries", [1, 3, 40, 4096])
def test_every_layout_gives_the_same(spark, entries):
    rng = random.Random(entries)
    rows = [(i, [rng.choice([0.0, 0.25]), rng.choice([0.0, 0.5, 1.0]), rng.random(), rng.random(), 0.0, 0.0, 0.0, rng.choice([0.0, -1.0])])
            for i in range(90)]
    assert clustered(spark, rows, k=4, rounds=5, size=8, entries=entries) == plain(rows, 4, 5, size=8)


def test_layout_follows_the_data(spark):
    rows = [(i, [i % 2 / 4, i % 3 / 4, 0.0, 0.0, i / 8, 0.0, i / 16, float(i)]) for i in range(24)]
    points = centroids.whole_vectors(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), 8)
    layout = centroids.choose_layout(points, 8, 6)
    assert [(b.start, b.width, len(b.entries)) for b in layout.blocks] == [(0, 4, 6), (5, 1, 1)] and layout.bare == [4, 6, 7]


def test_ties_and_empty_clusters(spark):
    """Equal first centroids: the smaller number takes all, the others stay where they are."""
    rows = [(i, [1.0] * 64) for i in range(20)] + [(i, [0.0] * 64) for i in range(20, 23)]
    assert clustered(spark, rows, k=8) == plain(rows)


def test_few_or_no_vectors(spark):
    rows = table(3)
    assert clustered(spark, rows) == plain(rows)
    assert clustered(spark, [(1, [1.0])]) == [] and clustered(spark, []) == []


def test_too_large_components_are_refused(spark):
    assert clustered(spark, [(1, [131072.0] * 64), (2, [-131072.0] * 64)], k=1) == plain([(1, [131072.0] * 64), (2, [-131072.0] * 64)], 1)
    with pytest.raises(ValueError):
        clustered(spark, [(1, [1e30] + [0.0] * 63)])


def test_float_vectors_are_scaled_as_doubles(spark):
    vectors = spark.createDataFrame([(1, [0.1] * 64, "")], "vec_id long, embedding array<float>, cluster string")
    got = centroids.whole_vectors(vectors, 64).select(F.col("x")[0]).first()[0]
    assert got == math.floor(1024 * 0.10000000149011612)
