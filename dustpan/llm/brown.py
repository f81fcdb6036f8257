"""Language model scores from a Brown class-based bigram model.

Words are put into classes by exchange clustering: a word moves to the class
that raises the likelihood of the class bigrams most.  It begins with the
``TOP`` most frequent words, one after the other on the driver against their
bounded table of bigrams, until nothing moves; all other words with one ending
(their last three bytes without punctuation, hashed to one of ``ENDINGS``) move
there as one.  From these classes on, each of the ``HOT`` most frequent words
is exchanged for itself: a round counts the classes to the left and right of
every such word in all texts, finds its best class against the small matrix of
class bigrams, and moves half of the words, the other half in the next round.
Every such word is looked at in every round; it moves if that is ``WORTH`` it.
The texts are written once as places of their words,
and rounds read those.  Rounds go on while the likelihood rises by ``LEAST_RISE`` of its distance from
that of words without any order; a round that does not raise it is undone.
Rarer and unseen words have the class of their ending.  The end of a text is a
class of its own.

With c(w) the training count of w,

    P(w | before) = (c(w) + 1) * M[class before, class of w],
    M[k, j] = mixed * T[k, j] / (N_j + V_j + u_j) + (1 - mixed) / (N + V + u),

where T is the class transition probability, smoothed towards the classes'
shares, and N_j, V_j, u_j are the tokens, distinct words and places for unseen
words of class j.  It adds up to one over all words and the unseen of each
class.  Because a word enters only by log(c(w) + 1) and its class, a text's
score needs exact counts but no table of all words: the hot words travel to all
tasks (a bounded table), counts of the others are joined, added up per text
beforehand.

All counts are over all training texts.  The driver gets the unit bigrams
(at most UNITS squared), the bounded tables, and nothing that grows with the texts.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustpan.llm.words import Words, in_blocks, mix, owner, per_text, words_of
from dustpan.storage import materialize

TOP, ENDINGS, HOT, CLASSES = 768, 255, 400_000, 40
UNITS = TOP + ENDINGS + 1
MIXED, PRIOR_WEIGHT = 0.95, 20.0
LEAST_RISE = 0.01
# A move must gain so much for each token, well above what rounding makes of equal figures.
LEAST_GAIN = 1e-9
# A word's own class must be worth naming: of so many classes one fits a rare word well by chance.
WORTH = 2 * math.log(CLASSES)
# The end of a text, as a word and as the last unit.
END = np.uint64(0x454E44)
# Entries a task gathers before it adds equal ones up.
_PENDING = 1_000_000


class Classes(NamedTuple):
    hot: np.ndarray      # sorted hashes of the hot words
    of_hot: np.ndarray   # class of each
    of_ending: np.ndarray  # class per ending, for all other words

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, place among the hot words, whether it is one) of each word."""
        at, there = find(self.hot, words.hashes)
        own = self.of_hot[at] if len(self.hot) else np.zeros(len(at), np.int64)
        return np.where(there, own, self.of_ending[endings(words)]), at, there


class Model(NamedTuple):
    classes: Classes
    logs: np.ndarray      # log10 M
    hot_logs: np.ndarray  # log10(c + 1) of each hot word
    end_log: float
    total: int           # N
    distinct: int        # V


def endings(words: Words) -> np.ndarray:
    """The ending slot of each word."""
    punctuation = np.zeros(256, bool)
    punctuation[list(b".,;:!?\"')]")] = True
    ends = words.ends.copy()
    for _ in range(2):
        ends -= punctuation[words.data[ends - 1]] & (ends - 1 > words.starts)
    value = np.zeros(len(ends), np.uint64)
    for k in range(1, 4):
        value = value << np.uint64(8) | words.data[np.maximum(ends - k, words.starts)].astype(np.uint64)
    return (mix(value) % np.uint64(ENDINGS)).astype(np.int64)


def find(sorted_hashes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each hash."""
    if not len(sorted_hashes):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    order = np.argsort(hashes)  # neighbours are looked for one after the other, near each other in memory
    at = np.empty(len(hashes), np.int64)
    at[order] = np.minimum(np.searchsorted(sorted_hashes, hashes[order]), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == hashes


def steps(values: np.ndarray, bound: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, after) of all steps of all texts; each starts from and leads to ``end``."""
    where = bound[1:]
    after = np.insert(values, where, end)
    before = np.insert(values, bound[:-1], end)
    return before, after


def _add_up(keys: np.ndarray, extra: np.ndarray, counts: np.ndarray):
    order = np.argsort(keys)
    keys, extra, counts = keys[order], extra[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], extra[first], np.add.reduceat(counts, first) if len(keys) else counts


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, n) of the texts' words and ends; a word is its hash."""
    def run(batches):
        held, size = [], 0

        def rows(parts):
            keys, extra, counts = _add_up(*(np.concatenate(p) for p in zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(extra), pa.array(counts)],
                                              names=["word", "ending", "n"])

        for block in in_blocks(lambda b: b)(batches):
            words = words_of(block.column("text"))
            held.append(_add_up(words.hashes, endings(words), np.ones(len(words.hashes), np.int64)))
            held.append((np.array([END]), np.array([-1]), np.array([block.num_rows])))
            size += len(held[-2][0])
            if size > _PENDING:
                held = [_add_up(*(np.concatenate(p) for p in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > _PENDING // 2:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return (docs.mapInArrow(run, "word bigint, ending bigint, n bigint")
            .groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")))


def _most_frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, ending) of the ``limit`` most frequent words, of equal ones those of smaller hash; sorted by hash."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, words, last = 1 << 62, 0, None
    for row in sorted(levels, key=lambda r: -r["level"]):  # a few hundred rows
        if words + row["words"] > limit:
            last = row
            break
        least, words = row["least"], words + row["words"]
    chosen = counts.where(F.col("n") >= least)
    if last is not None:
        part = counts.where((F.col("n") >= last["least"]) & (F.col("n") < least))
        chosen = chosen.unionByName(part.orderBy(F.desc("n"), "word").limit(limit - words))
    rows = chosen.select("word", "n", "ending").toArrow()
    found, n, ending = (np.asarray(rows.column(k).combine_chunks()) for k in ("word", "n", "ending"))
    found = found.view(np.uint64)
    order = np.argsort(found)
    return found[order], n[order], ending[order]


def places(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(words) of each text, four bytes a word: its place among the hot words, or -1 - ending of any other."""
    def run(batches):
        for block in in_blocks(lambda b: b)(batches):
            words = words_of(block.column("text"))
            at, there = find(hot, words.hashes)
            value = np.where(there, at, -1 - endings(words)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_binary(value, words.bound)], names=["words"])

    return docs.mapInArrow(run, "words binary")


def _binary(values: np.ndarray, bound: np.ndarray) -> pa.Array:
    """A binary column of numbers; entry i holds those of bound[i]:bound[i + 1]."""
    offsets = (bound * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bound) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _numbers(column: pa.Array, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    """(values, bound) of such a column."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bound = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] // np.dtype(kind).itemsize
    held = np.frombuffer(data, kind, bound[-1]) if bound[-1] else np.zeros(0, kind)
    return held[bound[0]:], bound - bound[0]


def _by_place(of_hot: np.ndarray, of_ending: np.ndarray) -> np.ndarray:
    """What each number of ``places`` stands for; those of endings are negative and count from the end."""
    return np.concatenate([of_hot, of_ending[::-1]])


def unit_bigrams(texts: DataFrame, units: np.ndarray) -> np.ndarray:
    """UNITS x UNITS counts of neighbouring units; ``units`` has the unit of each number of the texts (``places``)."""
    def run(batches):
        total = np.zeros(UNITS * UNITS, np.int64)
        for block in in_blocks(lambda b: b, "words")(batches):
            values, bound = _numbers(block.column("words"))
            before, after = steps(units[values], bound, UNITS - 1)
            np.add.at(total, before * UNITS + after, 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["pair", "n"])

    rows = texts.mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(UNITS * UNITS)
    matrix[np.asarray(rows.column("pair").combine_chunks())] = np.asarray(rows.column("n").combine_chunks())
    return matrix.reshape(UNITS, UNITS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """Class per unit, exchanged until nothing moves; the last unit keeps the last class to itself."""
    units = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-weight[:-1], kind="stable")
    own = np.full(units, classes)
    own[order] = np.arange(units - 1) % classes
    member = np.zeros((units, classes + 1))
    member[np.arange(units), own] = 1
    table = member.T @ bigrams @ member
    index = np.arange(classes)
    least = LEAST_GAIN * (1 + bigrams.sum())
    while True:  # every move raises the likelihood
        moved = 0
        for u in order:
            if not weight[u]:
                break
            k, loop = own[u], bigrams[u, u]
            right, left = bigrams[u] @ member, bigrams[:, u] @ member
            right[k] -= loop
            left[k] -= loop
            table[k] -= right
            table[:, k] -= left
            table[k, k] -= loop
            rows, cols = table[:classes], table[:, :classes].T
            gain = (_xlogx(rows + right) - _xlogx(rows)).sum(axis=1) + (_xlogx(cols + left) - _xlogx(cols)).sum(axis=1)
            cell = table[index, index]
            gain += _xlogx(cell + right[:classes] + left[:classes] + loop) + _xlogx(cell)
            gain -= _xlogx(cell + right[:classes]) + _xlogx(cell + left[:classes])
            # Wherever the word goes, the classes around it keep their steps to and from it.
            for sums, more in ((rows.sum(axis=1) + left[:classes], right.sum() + loop), (cols.sum(axis=1) + right[:classes], left.sum() + loop)):
                gain -= _xlogx(sums + more) - _xlogx(sums)
            best = k if gain[k] >= gain.max() - least else int(gain.argmax())
            table[best] += right
            table[:, best] += left
            table[best, best] += loop
            if best != k:
                member[u, k], member[u, best], own[u] = 0, 1, best
                moved += 1
        if not moved:
            break
    return own


# Words whose gains are worked out together.
_CHUNK = 256
# Contexts a task gathers before it counts equal ones.
_GATHERED = 3_000_000
# An entry is a class (less than 1 << 7) and its count in 16 bits; of a higher count it takes several.
_MOST = 511


def contexts(texts: DataFrame, classes: Classes) -> DataFrame:
    """(word, around, n): class bigrams and, per hot word, the classes to its left and right.

    With W = CLASSES + 1 a bigram (a, b) has the word -1 - (a * W + b) and the
    count n.  Any other row is a word's place with ``around``, entries of
    at + (count << 7), two bytes each: ``at`` is a for class a before it, and W + b
    for b after it.  A word has a row for each time a task counts, not one for each class.
    """
    wide = CLASSES + 1
    of = _by_place(classes.of_hot, classes.of_ending)

    def counted(held):
        keys = np.concatenate(held)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(first, len(keys)))
        keys, times = keys[first], -(-n // _MOST)
        if len(keys) and times.max() > 1:
            last = np.cumsum(times) - 1
            rest = n - (times - 1) * _MOST
            keys, n = np.repeat(keys, times), np.full(int(times.sum()), _MOST)
            n[last] = rest
        word, at = np.divmod(keys, np.int32(2 * wide))
        cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        around = _binary((at + (n << 7)).astype(np.uint16), np.append(cuts, len(word)))
        return pa.RecordBatch.from_arrays([pa.array(word[cuts]), around, pa.nulls(len(cuts), pa.int64())],
                                          names=["word", "around", "n"])

    def run(batches):
        matrix = np.zeros(wide * wide, np.int64)
        held, size = [], 0
        for block in in_blocks(lambda b: b, "words")(batches):
            values, bound = _numbers(block.column("words"))
            own = of[values]
            before, after = steps(own, bound, wide - 1)
            matrix += np.bincount(before * wide + after, minlength=wide * wide)
            there = values >= 0
            place = (np.arange(len(own)) + owner(bound))[there]  # each text has one step more than words
            word = values[there] * np.int32(2 * wide)
            held += [word + before[place].astype(np.int32), word + (wide + after[place + 1]).astype(np.int32)]
            size += 2 * len(word)
            if size > _GATHERED:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)
        seen = np.flatnonzero(matrix)
        yield pa.RecordBatch.from_arrays([pa.array((-1 - seen).astype(np.int32)), pa.nulls(len(seen), pa.binary()), pa.array(matrix[seen])],
                                         names=["word", "around", "n"])

    return texts.mapInArrow(run, "word int, around binary, n bigint")


def gains(word: np.ndarray, at: np.ndarray, n: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Gain in likelihood of each class (column) for each word (row of ``own``, its class), as if it alone moved.

    Word ``word[i]`` (ascending) has ``n[i]`` steps from class ``at[i]``, or,
    from CLASSES + 1 on, to class ``at[i] - CLASSES - 1``; ``table`` counts them.
    """
    k, wide, m = CLASSES, CLASSES + 1, np.arange(len(own))
    around = np.zeros((len(own), 2 * wide))
    around[word, at] = n
    left, right = around[:, :wide], around[:, wide:]
    gain = np.zeros((len(own), k))
    for before, sums, mine, other in ((True, table.T, left, right), (False, table, right, left)):
        side = (at < wide) == before
        i, a, steps_ = word[side], at[side] % wide, n[side][:, None]
        # Steps between class a and every class, without those of the word itself.
        base = (table[a, :k] if before else table[:k, a].T).astype(float)
        inside = a == own[i]
        base[inside] -= other[i[inside], :k]
        base[np.arange(len(i)), own[i]] -= steps_[:, 0]
        base = np.maximum(base, 0)  # a word beside itself is counted on both sides
        if len(i):
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            gain[i[first]] += np.add.reduceat(_xlogx(base + steps_) - _xlogx(base), first, axis=0)
        total = mine.sum(axis=1)
        whole = np.repeat(sums.sum(axis=1)[None, :k], len(own), axis=0)
        whole[m, own] -= total
        gain -= _xlogx(whole + total[:, None]) - _xlogx(whole)
    cell = np.repeat(np.diag(table)[None, :k], len(own), axis=0)
    cell[m, own] -= left[m, own] + right[m, own]
    cell, l, r = np.maximum(cell, 0), left[:, :k], right[:, :k]
    return gain + _xlogx(cell + l + r) + _xlogx(cell) - _xlogx(cell + l) - _xlogx(cell + r)


def best_classes(counts: DataFrame, of_hot: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, class) of the hot words that gain by a move.

    The rows of a word come one after the other and are added up as they come,
    so a task holds the words of one batch, however many rows they have.
    """
    wide = CLASSES + 1

    def decided(word, around):
        for start in range(0, len(word), _CHUNK):
            part, own = around[start:start + _CHUNK], of_hot[word[start:start + _CHUNK]]
            row, at = np.nonzero(part)
            gain, rows = gains(row, at, part[row, at], own, table), np.arange(len(part))
            best = gain.argmax(axis=1)
            moves = gain[rows, best] > gain[rows, own] + max(WORTH, LEAST_GAIN * (1 + table.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(word[start:start + _CHUNK][moves].astype(np.int64)), pa.array(best[moves])],
                                             names=["word", "best"])

    def run(batches):
        last, sums = np.zeros(0, np.int32), np.zeros((0, 2 * wide))  # of the word whose rows may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            entries, bound = _numbers(batch.column("around"), np.uint16)
            word, row = np.unique(np.concatenate([last, np.asarray(batch.column("word"))]), return_inverse=True)
            around = np.zeros((len(word), 2 * wide))
            around[:len(last)] = sums
            np.add.at(around, (np.repeat(row[len(last):], np.diff(bound)), entries & 127), entries >> 7)
            yield from decided(word[:-1], around[:-1])
            last, sums = word[-1:], around[-1:].copy()
        yield from decided(last, sums)

    words = counts.where("word >= 0").select("word", "around").repartition("word").sortWithinPartitions("word")
    rows = words.mapInArrow(run, "word bigint, best bigint").toArrow()  # at most HOT rows
    return tuple(np.asarray(rows.column(k).combine_chunks()) for k in ("word", "best"))


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigrams, but for a part that no exchange changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def refine(texts: DataFrame, classes: Classes) -> tuple[Classes, np.ndarray]:
    """Classes after all rounds of exchange over the texts (``places``), and the matrix of their bigrams."""
    wide, round_, kept, kept_table = CLASSES + 1, 0, classes, None
    half = (mix(classes.hot) & np.uint64(1)).astype(np.int64)
    while True:
        counts = materialize(contexts(texts, classes), "contexts")
        table = np.zeros(wide * wide)
        for r in counts.where("word < 0").groupBy("word").agg(F.sum("n").alias("n")).collect():  # CLASSES + 1 squared
            table[-1 - r["word"]] = r["n"]
        table = table.reshape(wide, wide)
        if kept_table is not None:
            rise = likelihood(table) - likelihood(kept_table)
            if rise <= 0:
                return kept, kept_table
            if rise < LEAST_RISE * abs(likelihood(table) + _xlogx(table.sum())):
                return classes, table
        kept, kept_table = classes, table
        word, best = best_classes(counts, classes.of_hot, table)
        moving = half[word] == round_ % 2
        if not len(word):
            return kept, kept_table
        of_hot = classes.of_hot.copy()
        of_hot[word[moving]] = best[moving]
        classes, round_ = classes._replace(of_hot=of_hot), round_ + 1


def train(docs: DataFrame, counts: DataFrame, mixed: float = MIXED) -> Model:
    """The model of ``docs`` (column text) with their word counts."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total["n"] or 0, total["v"]
    inner = counts.where("ending >= 0")
    hot, hot_n, hot_ending = _most_frequent(inner, HOT)
    top = np.sort(hot[np.lexsort((hot.view(np.int64), -hot_n))[:TOP]])
    texts = materialize(places(docs, hot), "places")
    at, there = find(top, hot)
    unit = np.where(there, at, TOP + hot_ending)
    bigrams = unit_bigrams(texts, _by_place(unit, np.arange(TOP, UNITS - 1)))
    units = exchange(bigrams, CLASSES)
    of_ending = units[TOP:UNITS - 1]
    classes, table = refine(texts, Classes(hot, units[unit], of_ending))
    # Tokens and distinct words of each class.
    wide = CLASSES + 1
    n, v = (np.bincount(classes.of_hot, w, minlength=wide).astype(float) for w in (hot_n, np.ones(len(hot))))
    for r in inner.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # ENDINGS rows
        mine = hot_ending == r["ending"]
        n[of_ending[r["ending"]]] += r["n"] - hot_n[mine].sum()
        v[of_ending[r["ending"]]] += r["v"] - mine.sum()
    ends = bigrams[:, -1].sum()
    n[-1], v[-1] = ends, min(ends, 1)
    mass = n + v + np.isin(np.arange(wide), of_ending)
    share = mass / max(mass.sum(), 1.0)
    step = (table + PRIOR_WEIGHT * share) / (table.sum(axis=1, keepdims=True) + PRIOR_WEIGHT)
    with np.errstate(divide="ignore"):
        logs = np.log10(mixed * step / np.maximum(mass, 1.0) + (1 - mixed) / max(mass.sum(), 1.0))
    return Model(classes, logs, np.log10(hot_n + 1.0), math.log10(ends + 1), tokens, distinct)


def scores(docs: DataFrame, id: str = "doc_id", text: str = "text", training: Column | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from the rows where ``training`` (a condition on ``id``) holds.  A
    null or empty text has one token, its end.  Rows with a null id, repeated
    ids or repeated texts are scored like any other.  Without training texts
    all counts are 0 and the base score is 0.
    """
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    learned = source.where(training) if training is not None else source
    counts = materialize(word_counts(learned.select("text")), "counts")
    model = train(learned.select("text"), counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        model, row = shared.value, TaskContext.get().partitionId() << 40
        for block in in_blocks(lambda b: b)(batches):
            words = words_of(block.column("text"))
            rows, size = row + np.arange(block.num_rows), np.diff(words.bound)
            row += block.num_rows
            own, at, there = model.classes.of(words)
            before, after = steps(own, words.bound, CLASSES)
            moves = per_text(model.logs[before, after], words.bound + np.arange(len(words.bound)))
            value = np.where(there, model.hot_logs[at], 0.0) if len(model.hot_logs) else np.zeros(len(there))
            logs = per_text(value, words.bound) + model.end_log
            known = np.bincount(owner(words.bound)[there], minlength=block.num_rows) + (model.end_log > 0)
            # Other words once per text, with their count.
            text, cold = owner(words.bound)[~there], words.hashes[~there]
            order = np.lexsort((cold, text))
            text, cold = text[order], cold[order]
            first = np.ones(len(text), bool)
            first[1:] = (text[1:] != text[:-1]) | (cold[1:] != cold[:-1])
            first = np.flatnonzero(first)
            many = np.diff(np.append(first, len(text)))
            nulls = len(first)
            blank = lambda t: pa.nulls(nulls, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.nulls(len(rows), pa.int64()), pa.array(size + 1), pa.array(known),
                 pa.array(logs), pa.array(moves), block.column("id")],
                names=["row", "word", "n", "known", "logs", "moves", "id"])
            if nulls:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[text[first]]), pa.array(cold[first].view(np.int64)), pa.array(many),
                     blank(pa.int64()), blank(pa.float64()), blank(pa.float64()), blank(block.column("id").type)],
                    names=["row", "word", "n", "known", "logs", "moves", "id"])

    parts = materialize(source.mapInArrow(
        run, f"row bigint, word bigint, n bigint, known bigint, logs double, moves double, id {kind}"), "parts")
    few = counts.where("ending >= 0").select("word", F.col("n").alias("c"))
    rare = (parts.where("word IS NOT NULL").select("row", "word", "n").join(few, "word").groupBy("row")
            .agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("more_logs")))
    whole = parts.where("word IS NULL").drop("word").join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    each = math.log10(model.total + model.distinct + 1)
    return whole.select(
        F.col("id").alias(id), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (logs - F.col("n") * F.lit(each)).alias("base_score"), (logs + F.col("moves")).alias("score"))
