"""Families against brute force, with crowded keys forced through leaders."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dustpan.operators import similarity


def components(nodes, pairs):
    label = {n: n for n in nodes}

    def find(n):
        while label[n] != n:
            n = label[n]
        return n
    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    pairs += [(n, n + 1) for n in range(400, 460)] + [(500, n) for n in range(501, 700)]
    got = {r["id"]: r["family"] for r in similarity.connected_components(
        spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == components(nodes, pairs)


def texts(rng):
    """Families of edited copies, a hot one among them, exact copies and loners."""
    words = [f"w{n}" for n in range(400)]
    docs = []
    for family, members in ((0, 60), (1, 5), (2, 8), (3, 2)):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy).capitalize() + rng.choice(["", "!", " ."]))
    docs += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 50))) for _ in range(40)]
    return docs + docs[:10]


def shingle_set(text):
    w = [x for x in "".join(c if c.isalnum() else " " for c in text.lower()).split(" ") if x]
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}


@pytest.mark.parametrize("crowd", [1, 3, 10, 512])
@pytest.mark.parametrize("threshold", [0.4, 0.6])
def test_text_families(spark, crowd, threshold):
    docs = texts(random.Random(7))
    sets = [shingle_set(d) for d in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j]
             and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold]
    family = components(range(len(docs)), pairs)
    contents = {}
    for i, d in enumerate(docs):
        contents.setdefault(family[i], set()).add(d)
    want = {i: family[i] for i in range(len(docs)) if len(contents[family[i]]) > 1}
    rows = [(i, f"/{i}", d, d) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "ord bigint, path string, hash string, text string")
    got = {int(r["path"][1:]): r["family"] for r in similarity.near_duplicates(df, threshold, crowd=crowd).collect()}
    assert got == want


@pytest.mark.parametrize("crowd", [1, 3, 512])
def test_vector_families(spark, crowd):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 32))
    rows = [base[n % 30] if n < 60 else base[0] + rng.standard_normal(32) * 0.05 for n in range(120)]
    rows = [r + rng.standard_normal(32) * 0.02 for r in rows]
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    pairs = [(i, j) for i in range(120) for j in range(i) if close[i, j]]
    family = components(range(120), pairs)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id bigint, vector array<double>")
    got = {r["id"]: r["family"] for r in similarity.near_duplicate_vectors(df, crowd=crowd).collect()}
    assert got == {i: f for i, f in family.items() if list(family.values()).count(f) > 1}


def counted(monkeypatch, name):
    """Pairs handed to a distance, as they are formed."""
    formed, real = [], getattr(similarity, name)

    def wrapped(rows):
        distance = real(rows)
        return lambda pairs: formed.append(pairs.count()) or distance(pairs)

    monkeypatch.setattr(similarity, name, wrapped)
    return formed


@pytest.mark.parametrize("crowd", [10, 5_000])
def test_hopeless_texts_are_not_paired(spark, monkeypatch, crowd):
    """1,500 short texts with a common beginning that cannot be alike."""
    formed = counted(monkeypatch, "_jaccard_distance")
    docs = [f"alpha beta gamma w{n}" for n in range(1500)] + ["one two three four five six", "one two three four five sixth"]
    df = spark.createDataFrame([(i, f"/{i}", d, d) for i, d in enumerate(docs)], "ord bigint, path string, hash string, text string")
    got = {r["path"] for r in similarity.near_duplicates(df, 0.4, crowd=crowd).collect()}
    assert got == {"/1500", "/1501"} and sum(formed) < 10 * len(docs)


def test_sizes_and_places_bound_partners(spark):
    """Every alike pair meets in a key, on random sets of all sizes."""
    rng = random.Random(3)
    sets = {i: sorted(rng.sample(range(12 if i % 2 else 40), rng.randint(1, 12))) for i in range(150)}
    rows = spark.createDataFrame(list(sets.items()), "id bigint, features array<bigint>")
    for threshold in (0.3, 0.5, 0.75):
        keys = similarity._prefix_keys(rows, threshold)
        pairs = keys.where("seeks").join(similarity._second(keys.where("owns")),
                                         (keys["key"] == similarity.F.col("key2")) & similarity._can_be_alike())
        met = {tuple(r) for r in pairs.select(*similarity._pair()).distinct().collect()}
        alike = {(i, j) for i in sets for j in sets if i < j
                 and len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= threshold}
        assert alike <= met


def test_unlike_vectors_of_one_bucket_are_not_paired(spark, monkeypatch):
    """A crowd on the same side of all planes of the first band, in other directions otherwise."""
    formed, n = counted(monkeypatch, "_angle_distance"), 1500
    rng = np.random.default_rng(2)
    limit, bits = np.arccos(0.95), 11
    bands = int(np.ceil(np.log(1e-6) / np.log(1 - (1 - limit / np.pi) ** bits)))
    planes = np.random.default_rng(7).standard_normal((64, bands * bits))[:, :bits]
    rows = rng.standard_normal((n, 64)) * 3
    rows += (1 - rows @ planes) @ np.linalg.inv(planes.T @ planes) @ planes.T
    rows[n // 2:n // 2 + 20] = rows[0] + rng.standard_normal((20, 64)) * 0.02
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id bigint, vector array<double>")
    got = {r["id"]: r["family"] for r in similarity.near_duplicate_vectors(df, crowd=100).collect()}
    assert got == {i: 0 for i in [0, *range(n // 2, n // 2 + 20)]}
    assert np.triu(unit @ unit.T >= 0.95, 1).sum() == 21 * 20 // 2
    # Chance meetings of unlike vectors in all bands are in proportion to n, as planes grow with its logarithm.
    by_chance = bands * n * n / 2 / 2 ** bits
    assert sum(formed) < 2 * by_chance + 2 * n < 0.05 * n * n / 2


def test_vector_links_on_given_table_equal_brute_force(spark):
    from dustpan.plans import registry
    folder = "/root/testdata/sf0.01"
    rows = registry.fx.feature_vectors(spark, folder).collect()
    x = np.array([r["vector"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [r["id"] for r in rows]
    pairs = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))]
    family = components(ids, pairs)
    got = {r["id"]: r["family"] for r in registry.near_duplicate_vectors(spark, folder).collect()}
    found = sum(got.get(a) == got.get(b) == family[a] for a, b in pairs)
    assert found >= 0.999 * len(pairs)


def test_few_vectors_are_fetched_for_unlike_pairs(spark):
    """Pairs are sifted by sketches: none within the limit is lost, and most others go before vectors are joined."""
    rng = np.random.default_rng(4)
    middles = rng.standard_normal((400, 32))
    near = middles + 0.03 * rng.standard_normal((400, 32))
    x = np.concatenate([middles, near])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    pairs = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 400).alias("b")).unionByName(
        spark.range(400).selectExpr("id AS a", "400 + (id + 7) % 400 AS b"))
    limit = math.acos(0.95)
    found = {(r["a"], r["b"]): r["d"] for r in similarity._sifted(vectors, limit, similarity._angle_distance(vectors))(pairs).collect()}
    assert all(abs(found[i, i + 400] - math.acos(min(1, float(x[i] @ x[i + 400])))) < 1e-6 for i in range(400))
    assert len(found) < 420
    # A pair at the limit itself differs in about a tenth of the bits.
    assert 0.15 < similarity._differing(limit) / (64 * similarity.SKETCH_LONGS) < 0.3


def test_sketches_lose_no_alike_sets(spark, monkeypatch):
    """Sets at every likeness: those alike all come through, features are fetched for few others, whatever the sizes."""
    rng, rows, pairs = random.Random(6), [], []
    for n in [1, 2, 7, 40, 300, 900] * 15:
        x = [rng.getrandbits(63) for _ in range(n)]
        same = rng.randint(0, n)
        y = x[:same] + [rng.getrandbits(63) for _ in range(rng.randint(0 if same else 1, n))]
        rows += [(len(rows), x), (len(rows) + 1, y)]
        pairs.append((len(rows) - 2, len(rows) - 1))
    far = [(a, (b + 2 * k) % len(rows)) for a, b in pairs if len(rows[a][1]) > 100 for k in (6, 12, 18)]
    alike = {}
    for a, b in pairs + far:
        x, y = set(rows[a][1]), set(rows[b][1])
        alike[a, b] = len(x & y) / len(x | y)
    sets = spark.createDataFrame(rows, "id long, features array<long>")
    formed = counted(monkeypatch, "_jaccard_distance")
    found = similarity._sifted_jaccard(sets, 0.4)(spark.createDataFrame(pairs + far, "a long, b long"))
    got = {(r["a"], r["b"]): 1 - r["d"] for r in found.collect()}
    assert {p for p, j in alike.items() if j >= 0.4} <= set(got)
    assert all(math.isclose(j, alike[p], abs_tol=1e-9) for p, j in got.items())
    assert formed[0] < len(pairs) + 5


def test_keys_without_partner_are_dropped(spark):
    """Of prefix keys only those are written in which one set seeks and another owns."""
    rows = [(1, 7, True, True), (2, 7, True, False), (3, 8, True, True), (4, 9, True, False), (5, 9, True, False), (6, 10, False, True)]
    keys = similarity._met(spark.createDataFrame(rows, "id long, key long, seeks boolean, owns boolean"))
    assert sorted(tuple(r) for r in keys.collect()) == [(1, 7, True, True, 2), (2, 7, True, False, 2)]


def test_features_are_written_and_shuffled_once(spark, monkeypatch):
    """The features of 400 unlike texts are written as one table, and ids pick what is fetched."""
    written, real = [], similarity.materialize

    def noted(df, name="table"):
        out = real(df, name)
        written.append((name, "features" in out.columns))
        return out

    monkeypatch.setattr(similarity, "materialize", noted)
    rng = random.Random(5)
    docs = [" ".join(str(rng.randrange(9_000)) for _ in range(60)) for _ in range(400)]
    docs.append(docs[0] + " more")
    df = spark.createDataFrame([(i, f"/{i}", d, d) for i, d in enumerate(docs)], "ord bigint, path string, hash string, text string")
    assert {r["path"] for r in similarity.near_duplicates(df, 0.4).collect()} == {"/0", "/400"}
    assert [name for name, has in written if has] == ["features"]
