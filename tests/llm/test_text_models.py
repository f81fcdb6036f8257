"""Scores: toxicity, quality, language model."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from dustpan.llm import brown, qda, queries, toxicity
from dustpan.llm.words import word_hash
from tests.llm.conftest import words

LARGER = "/root/testdata/sf0.01"


def held_out_rates(spark, name, label):
    scored = queries.all_queries()[name](spark, LARGER)
    rows = scored.join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    hit = lambda y: np.mean([r["predicted"] for r in rows if r[label] == y])
    return hit(1), hit(0)


def test_toxicity_on_held_out_rows(spark):
    found, wrong = held_out_rates(spark, "op8_toxicity", "toxic")
    assert found > 0.6 and wrong < 0.02  # 37 positives to learn from


def test_quality_on_held_out_rows(spark):
    kept, wrong = held_out_rates(spark, "op9_quality_classifier", "quality")
    assert kept > 0.97 and wrong < 0.03


def test_classifiers_take_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(7, 1, 0), (8, None, 1), (None, 1, 1), (9, 0, 1)], "doc_id long, toxic int, quality int")
    none = labels.limit(0)
    for docs in (odd, empty):
        for known in (labels, none):
            model = toxicity.train(docs, known)
            scored = toxicity.score(docs, model).collect()
            assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
            assert toxicity.reject_toxic(docs, model).columns == docs.columns
            graded = qda.quality_scores(docs, known).collect()
            assert len(graded) == docs.count() and all(0 <= r["score"] <= 1 for r in graded)


def presence(seed):
    """Three telling features, three that are noise, and some toxic texts among the unlabelled."""
    rng = np.random.default_rng(seed)
    positive = np.arange(600) < 200
    toxic = positive | (rng.random(600) < 0.1)
    chance = np.where(np.arange(6) >= 3, 0.3, np.where(toxic[:, None], 0.8, 0.02))
    rows, cols = np.nonzero(rng.random((600, 6)) < chance)
    return rows, cols, positive, toxic, rng.integers(0, 4, 600)


def test_non_negative_risk_separates():
    for seed in range(4):
        rows, cols, positive, toxic, part = presence(seed)
        weights, bias = toxicity.fit_checked(rows, cols, positive, part, 6, 0.1)
        assert weights[:3].min() > abs(weights[3:]).max() and bias < 0
        found = np.bincount(rows, weights[cols], minlength=600) + bias > 0
        assert found[toxic].mean() > 0.8 and found[~toxic].mean() < 0.02
        if seed == 1:
            assert weights[:3].min() > 1 > abs(weights[3:]).max()


def test_fit_reaches_the_least_risk():
    """Against plain steps down the penalised risk, from many starts."""
    rows, cols, positive, _, _ = presence(1)
    l2, prior = 1e-2, 0.1
    x = np.zeros((600, 7))
    x[rows, cols], x[:, 6] = 1, 1
    share_p, share_u = positive / positive.sum(), ~positive / (~positive).sum()

    def cost(theta):
        return toxicity.risk(rows, cols, positive, prior, theta[:6], theta[6]) + l2 / 2 * theta[:6] @ theta[:6]

    least = math.inf
    for start in (np.zeros(7), np.full(7, -1.0), np.ones(7)):
        theta = start.copy()
        for _ in range(6000):
            g = x @ theta
            s = 1 / (1 + np.exp(-g))
            clean = (share_u - prior * share_p) @ np.logaddexp(0, g)
            d = prior * share_p * (s - 1) + (clean > 0) * (share_u - prior * share_p) * s
            theta = theta - 0.5 * (x.T @ d + l2 * np.append(theta[:6], 0))
        least = min(least, cost(theta))
    weights, bias = toxicity.fit_nnpu(rows, cols, positive, 6, prior, l2=l2)
    assert cost(np.append(weights, bias)) < least + 5e-3


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    kind = np.arange(31) % 3
    counts = np.where(kind[:, None] != kind[None, :], 40.0, 1.0) + rng.integers(0, 3, (31, 31))
    own = brown.exchange(counts, 3)
    assert own[-1] == 3
    for k in range(3):
        assert len(set(own[:-1][kind[:-1] == k])) == 1


def test_brown_equals_counting(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op10_brown_lm(spark, sf_dir).collect()}
    texts = {r["doc_id"]: words(r["text"]) + [None] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, t in texts.items() if not out[i] for w in t)
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    better = 0
    for i, tokens in texts.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            out[i], len(tokens), sum(w in count for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        better += out[i] and r["score"] > r["base_score"]
    assert better > 0.9 * sum(out.values())


def test_brown_model_is_a_distribution(spark, odd):
    source = odd.select("text")
    counts = brown.word_counts(source)
    model = brown.train(source, counts)
    rows = {r["word"]: r for r in counts.collect()}
    hot = dict(zip(model.classes.hot.view(np.int64).tolist(), model.classes.of_hot.tolist(), strict=True))
    of = {h: hot.get(h, model.classes.of_ending[r["ending"]]) for h, r in rows.items() if r["ending"] >= 0}
    unseen = set(model.classes.of_ending)
    for before in range(brown.CLASSES + 1):
        total = sum((rows[h]["n"] + 1) * 10 ** model.logs[before, k] for h, k in of.items())
        end = next(r["n"] for r in rows.values() if r["ending"] < 0)
        total += (end + 1) * 10 ** model.logs[before, brown.CLASSES] + sum(10 ** model.logs[before, k] for k in unseen)
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_gains_are_differences_in_likelihood():
    """Against counting all bigrams anew for every class of every word; no word stands beside itself."""
    rng = np.random.default_rng(4)
    own = rng.integers(0, brown.CLASSES, 30)
    own = np.append(own, brown.CLASSES)
    pairs = rng.integers(0, 9, (31, 31)) * (rng.random((31, 31)) < 0.2)
    np.fill_diagonal(pairs, 0)

    def table(classes):
        out = np.zeros((brown.CLASSES + 1,) * 2)
        np.add.at(out, (classes[:, None], classes[None, :]), pairs)
        return out

    around = np.zeros((30, 2 * (brown.CLASSES + 1)))
    for w in range(30):
        np.add.at(around[w], own, pairs[:, w])
        np.add.at(around[w], own + brown.CLASSES + 1, pairs[w])
    word, at = np.nonzero(around)
    got = brown.gains(word, at, around[word, at], own[:30], table(own))
    for w in range(30):
        all_ = [brown.likelihood(table(np.where(np.arange(31) == w, c, own))) for c in range(brown.CLASSES)]
        assert np.allclose(got[w] - got[w, own[w]], np.array(all_) - all_[own[w]])


def plain_brown(texts, training):
    """The model and scores with dictionaries, one word at a time."""
    wide = brown.CLASSES + 1
    learned = [t for t, use in zip(texts, training, strict=True) if use]
    count = Counter(w for t in learned for w in t)
    name = {w: int(h) for w, h in zip(count, word_hash(list(count)), strict=True)}
    slot = lambda ws: dict(zip(ws, brown.endings(brown.words_of(pa.array(ws, pa.large_string()))).tolist(), strict=True))
    ending = slot(sorted({w for t in texts for w in t}))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ranked = sorted(count, key=lambda w: (-count[w], signed(name[w])))
    top = {w: k for k, w in enumerate(sorted(ranked[:brown.TOP], key=name.get))}
    unit = lambda w: top[w] if w in top else brown.TOP + ending[w]
    bigrams = np.zeros((brown.UNITS, brown.UNITS))
    for t in learned:
        line = [brown.UNITS - 1, *map(unit, t), brown.UNITS - 1]
        np.add.at(bigrams, (line[:-1], line[1:]), 1)
    units = brown.exchange(bigrams, brown.CLASSES)
    own = {w: int(units[unit(w)]) for w in count}
    of_ending = units[brown.TOP:brown.UNITS - 1]

    def counted(own):
        table, around = np.zeros((wide, wide)), {w: np.zeros(2 * wide) for w in count}
        for t in learned:
            line = [brown.CLASSES, *(own[w] for w in t), brown.CLASSES]
            for k, w in enumerate(t):
                around[w][line[k]] += 1
                around[w][wide + line[k + 2]] += 1
            np.add.at(table, (line[:-1], line[1:]), 1)
        return table, around

    kept, kept_table, round_ = own, None, 0
    while True:
        table, around = counted(own)
        if kept_table is not None:
            rise = brown.likelihood(table) - brown.likelihood(kept_table)
            if rise <= 0:
                own, table = kept, kept_table
                break
            n = table.sum()
            if rise < brown.LEAST_RISE * abs(brown.likelihood(table) + n * math.log(n)):
                break
        kept, kept_table, moved = own, table, dict(own)
        for w in count:
            at = np.flatnonzero(around[w])
            gain = brown.gains(np.zeros(len(at), int), at, around[w][at], np.array([own[w]]), table)[0]
            if gain.max() > gain[own[w]] + max(brown.WORTH, brown.LEAST_GAIN * (1 + table.sum())) and int(brown.mix(np.array([name[w]], np.uint64))[0]) % 2 == round_ % 2:
                moved[w] = int(gain.argmax())
        own, round_ = moved, round_ + 1
    assert round_ > 1
    mass = np.zeros(wide)
    for w, k in own.items():
        mass[k] += count[w] + 1
    mass[-1] = len(learned) + min(len(learned), 1)
    mass += np.isin(np.arange(wide), of_ending)
    step = (table + brown.PRIOR_WEIGHT * mass / mass.sum()) / (table.sum(axis=1, keepdims=True) + brown.PRIOR_WEIGHT)
    logs = np.log10(brown.MIXED * step / np.maximum(mass, 1) + (1 - brown.MIXED) / mass.sum())
    for t in texts:
        line = [brown.CLASSES, *(own.get(w, of_ending[ending[w]]) for w in t), brown.CLASSES]
        yield (sum(math.log10(count[w] + 1) for w in t) + math.log10(len(learned) + 1)
               + sum(logs[a, b] for a, b in zip(line, line[1:], strict=False)))


def test_brown_scores_equal_plain_version(spark, sf_dir):
    rows = queries.op10_brown_lm(spark, sf_dir).collect()
    text = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = plain_brown([text[r["doc_id"]] for r in rows], [not r["held_out"] for r in rows])
    for r, score in zip(rows, want, strict=True):
        assert math.isclose(r["score"], score, rel_tol=1e-6)


def test_brown_takes_odd_rows(odd, empty):
    assert brown.scores(odd).count() == odd.count()
    assert brown.scores(empty).count() == 0


class Task:
    """Takes the function of a ``mapInArrow`` to run it here."""

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def test_brown_round_has_a_row_per_word_in_bounded_memory():
    """Two million words, one of them beside itself more often than an entry can count, in a round of exchange."""
    rng = np.random.default_rng(3)
    texts = [np.minimum(rng.zipf(1.2, 5_000) - 1, 20_000).astype(np.int32) for _ in range(400)]
    texts += [np.zeros(3_000, np.int32), np.array([-1, 5, -3], np.int32), np.zeros(0, np.int32)]
    own = rng.integers(0, brown.CLASSES, 20_001)
    classes = brown.Classes(np.arange(20_001, dtype=np.uint64), own, rng.integers(0, brown.CLASSES, brown.ENDINGS))
    given = [pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary())], names=["words"])]
    task, wide = Task(), brown.CLASSES + 1
    brown.contexts(task, classes)
    tracemalloc.start()
    rows = list(task.run(iter(given)))
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    assert sum(r.num_rows for r in rows) < 2 * 20_001 + wide * wide
    got, table = np.zeros((20_001, 2 * wide)), np.zeros(wide * wide)
    for r in rows:
        for word, around, n in zip(*(c.to_pylist() for c in r.columns), strict=True):
            if word < 0:
                table[-1 - word] += n
            else:
                entries = np.frombuffer(around, np.uint16)
                np.add.at(got[word], entries & 127, entries >> 7)
    want, steps = np.zeros_like(got), np.zeros(wide * wide)
    for t in texts:
        line = np.concatenate([[wide - 1], np.where(t >= 0, own[t], classes.of_ending[-1 - np.minimum(t, -1)]), [wide - 1]])
        np.add.at(steps, line[:-1] * wide + line[1:], 1)
        for word, before, after in ((t, line[:-2], 0), (t, line[2:], wide)):
            np.add.at(want, (word[word >= 0], before[word >= 0] + after), 1)
    assert (got == want).all() and (table == steps).all()
