"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its distinct runs of five words (fewer
words: of the whole sequence; no words: the empty set, linked with nothing).
Two sets are linked when ``100 * intersection >= 75 * union``.

1. *Sketch.*  The sketch has ``t`` bins.  In round i < t each element goes to
   one hashed bin with a hashed value; an empty bin takes the smallest value
   of the first round that reaches it.  From round t on, round i puts all
   elements into bin i - t, so every bin of a non-empty set is filled after 2t
   rounds.  A bin of two sets agrees with the probability of their Jaccard
   similarity, with the concentration of sampling without replacement.
2. *Classes.*  Documents of equal sets form one class; its smallest id stands
   for it from here on, so copies are never paired.
3. *Banding.*  A class has one key per band of bins.  In every bucket all
   members are compared with its hub, the member that meets most others over
   all its buckets (an original among its edited copies): a linear number of
   pairs.  Components of the verified links are the families so far.
4. *Rounds.*  In buckets that still hold several families, the hub of those
   outside the largest family is compared with all others, while that helps.
5. *The rest.*  What is still apart is compared pair by pair across families,
   largest family against the rest, but only where it can succeed.  A bucket
   has a reference, the hub of its largest family; of two members each knows
   how many elements it has in common with the reference, and how many others
   that any further set has.  They share no more than the smaller of the first
   plus the smaller of the second, and where that is too little for their sizes
   the pair is not formed.  So edited copies too far from their original do not
   meet all other copies, nor texts with a passage in common each other, and no
   pair that shares a bucket is left out unless it is already connected or
   cannot be alike.

A pair is only formed or verified if one bit per bin (the parity of the
coordinate) lets it: of 560 bits about 70 differ at 0.75, and pairs with more
than 111, over five deviations away, are passed over.  All links are verified
on full sets.

With 80 bands of 7 bins a pair at 0.75 shares no bucket with a probability of
1.1e-5; at 0.8 it is 1e-8.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustpan.llm.words import Words, in_blocks, mix, owner, seeds, words_of
from dustpan.operators.similarity import connected_components
from dustpan.storage import materialize

SHINGLE, BANDS, ROWS, PERCENT, ROUNDS = 5, 80, 7, 75, 1
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(elements, bound): sorted distinct shingle hashes of each text."""
    counts = np.diff(words.bound)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bound = np.concatenate([[0], np.cumsum(runs)])
    text = owner(bound)
    at = np.arange(bound[-1]) - bound[text] + words.bound[text]
    length = np.minimum(counts, size)[text]
    padded = np.concatenate([words.hashes, np.zeros(size, np.uint64)])
    value = length.astype(np.uint64)
    for k, seed in enumerate(seeds(size, 1)):
        value = np.where(k < length, mix(value ^ (padded[at + k] + seed)), value)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, np.searchsorted(text, np.arange(len(counts) + 1))


def sketch(elements: np.ndarray, bound: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` uint64 coordinates per set; rows of empty sets are constant."""
    counts = np.diff(bound)
    result = np.full((len(counts), bins), _NONE, np.uint64)
    # Only sets with empty bins are carried from round to round.
    rest, who = np.flatnonzero(counts > 0), owner(np.concatenate([[0], np.cumsum(counts[counts > 0])]))
    salt, filled = seeds(2 * bins, 2), np.zeros((len(rest), bins), bool)
    for i in range(2 * bins):
        if not len(rest):
            break
        values = mix(elements ^ salt[i])
        place = (values >> np.uint64(32)) % np.uint64(bins) if i < bins else np.full(len(values), i - bins, np.uint64)
        place = who * bins + place.astype(np.int64)
        wanted = ~filled.reshape(-1)[place]
        place, values = place[wanted], mix(values[wanted] + salt[i])
        order = np.lexsort((values, place))
        place, values = place[order], values[order]
        lead = np.ones(len(place), bool)
        lead[1:] = place[1:] != place[:-1]
        place, values = place[lead], values[lead]
        filled.reshape(-1)[place] = True
        result[rest[place // bins], place % bins] = values
        unfilled = ~filled.all(axis=1)
        if not unfilled.all():
            live = unfilled[who]
            elements, who = elements[live], (np.cumsum(unfilled) - 1)[who[live]]
            rest, filled = rest[unfilled], filled[unfilled]
    return result


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 key per set and band, of ``rows`` coordinates each."""
    parts = sketches.reshape(len(sketches), bands, rows)
    value = np.broadcast_to(seeds(bands, 3), (len(sketches), bands))
    for k in range(rows):
        value = mix(value ^ parts[:, :, k]) + np.uint64(k)
    return value.view(np.int64)


def bin_bits(sketches: np.ndarray) -> np.ndarray:
    """One bit per coordinate, 64 to an int64; what is left of the last is 0."""
    odd = (mix(sketches) & np.uint64(1)).astype(np.uint8)
    wide = np.zeros((len(odd), -(-odd.shape[1] // 64) * 64), np.uint8)
    wide[:, :odd.shape[1]] = odd
    return np.packbits(wide, axis=1).view(np.int64)


def _sums(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sums per set modulo 2**64, as int64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[bound[1:]] - total[bound[:-1]]).view(np.int64)


def _features(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    def each(block: pa.RecordBatch) -> pa.RecordBatch:
        elements, bound = shingle_sets(words_of(block.column("text")), size)
        sketches = sketch(elements, bound, bands * rows)
        keys, bits = band_keys(sketches, bands, rows), bin_bits(sketches)
        x, y = (_sums(mix(elements + np.uint64(k)), bound) for k in (1, 2))
        flat, packed = (pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.reshape(-1))
                        for v in (keys, bits))
        columns = [block.column("id"), pa.array(np.diff(bound), pa.int64()),
                   pa.array(x), pa.array(y), flat, packed]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n", "x", "y", "keys", "bits"])

    return docs.mapInArrow(in_blocks(each), "id bigint, n bigint, x bigint, y bigint, keys array<bigint>, bits array<bigint>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def each(block: pa.RecordBatch) -> pa.RecordBatch:
        elements, bound = shingle_sets(words_of(block.column("text")), size)
        flat = pa.ListArray.from_arrays(bound.astype(np.int32), elements.view(np.int64))
        return pa.RecordBatch.from_arrays([block.column("id"), flat], names=["id", "elements"])

    return docs.mapInArrow(in_blocks(each), "id bigint, elements array<bigint>")


def _grown(rows: DataFrame) -> DataFrame:
    """Right side of a join that grows with the data: shuffled at every size, never broadcast."""
    return rows.hint("merge")


def _sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, elements) of the documents with these ids."""
    return materialize(_sets(docs.join(_grown(ids.distinct()), "id", "left_semi"), size), "sets")


def _near(bins: int, percent: int, a: str = "bits", b: str = "bits2") -> Column:
    """Whether the bits of two sets let them be alike."""
    share = (1 - percent / 100) / 2
    limit = math.ceil(bins * share + 5.2 * math.sqrt(bins * share * (1 - share)))
    words = range(-(-bins // 64))
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in words), F.lit(0)) <= limit


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are alike."""
    common = F.size(F.array_intersect("ea", "eb"))
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")
            .select("a", "b", common.alias("c"), F.size("ea").alias("na"), F.size("eb").alias("nb")))
    return materialize(both.where(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * percent)
                       .select("a", "b"), "links")


def _fit(percent: int, n: str = "n", n2: str = "n2"):
    """Sizes at which two sets can be alike at all."""
    return (F.col(n) * 100 >= F.col(n2) * percent) & (F.col(n2) * 100 >= F.col(n) * percent)


def _families(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links), "families")


def _pairs(rows: DataFrame, bits: DataFrame, bins: int, percent: int) -> DataFrame:
    """(a, b) of bucket members and their bucket's ``lead`` where sizes and bits fit."""
    pairs = (rows.where((F.col("id") != F.col("lead")) & _fit(percent, "n", "lead_n"))
             .select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct())
    near = (pairs.join(bits.select(F.col("id").alias("a"), "bits"), "a")
            .join(bits.select(F.col("id").alias("b"), F.col("bits").alias("bits2")), "b").where(_near(bins, percent)))
    return materialize(near.select("a", "b"), "pairs")


def _open(members: DataFrame, families: DataFrame) -> DataFrame:
    """Members of buckets with several families, with their family and the bucket's largest."""
    labelled = materialize(members.join(_grown(families), "id", "left").select(
        "key", "id", "n", "met", F.coalesce("family", "id").alias("family")), "labelled")
    sizes = labelled.groupBy("key", "family").agg(F.count("*").alias("size"), F.max("met").alias("met"))
    # Of equal sizes the one that meets most, so that buckets of the same sets choose the same.
    weight = F.col("size") * F.lit(1 << 40) + F.col("met")
    largest = (sizes.groupBy("key").agg(F.max_by("family", weight).alias("largest"), F.count("*").alias("families"))
               .where("families > 1").select("key", "largest"))
    return materialize(labelled.join(_grown(largest), "key"), "open")


def _to_hubs(rows: DataFrame, bits: DataFrame, bins: int, source: DataFrame, percent: int, size: int) -> DataFrame:
    """Verified links of open buckets' members to the hub of those outside the largest family."""
    hubs = (rows.where("family <> largest").groupBy("key")
            .agg(F.max_by("id", "met").alias("lead"), F.max_by("n", "met").alias("lead_n"), F.max_by("family", "met").alias("lead_family")))
    pairs = _pairs(rows.join(hubs, "key").where("family <> lead_family"), bits, bins, percent)
    return _verified(pairs, _sets_of(source, _both(pairs), size), percent)


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def _across(rows: DataFrame, bits: DataFrame, bins: int, source: DataFrame, percent: int, size: int) -> DataFrame:
    """Verified links between members of an open bucket that are in different families."""
    hubs = rows.groupBy("family").agg(F.max_by("id", "met").alias("ref")).withColumnRenamed("family", "largest")
    rows = materialize(rows.join(hubs, "largest"), "referred")
    sets = _sets_of(source, rows.select("id"), size)
    elements = sets.select("id", F.explode("elements").alias("element"))
    held = elements.groupBy("element").agg(F.count("*").alias("sets")).where("sets > 1").select("element")
    # The elements of each set that some other set has, too.
    shared = elements.join(held, "element").groupBy("id").agg(F.collect_list("element").alias("shared"))
    known = sets.join(shared, "id").where(F.size("shared") * 100 >= F.size("elements") * percent)
    refs = rows.select("id", "ref").distinct().join(known, "id").join(
        sets.select(F.col("id").alias("ref"), F.col("elements").alias("of_ref")), "ref")
    inner, outer = F.size(F.array_intersect("elements", "of_ref")), F.size(F.array_except("shared", "of_ref"))
    bounds = refs.select("id", "ref", inner.alias("inner"), outer.alias("outer"))
    rows = materialize(rows.join(bounds, ["id", "ref"]).join(bits, "id"), "bounded")
    minor = rows.where("family <> largest").select(
        F.col("key").alias("key2"), *[F.col(c).alias(c + "2") for c in ("id", "n", "family", "inner", "outer", "bits")])
    most = F.least("inner", "inner2") + F.least("outer", "outer2")
    pairs = (rows.join(minor, (F.col("key") == F.col("key2")) & (F.col("family") != F.col("family2"))
                       & (most * (100 + percent) >= (F.col("n") + F.col("n2")) * percent) & _fit(percent)
                       & ((F.col("family") == F.col("largest")) | (F.col("id") < F.col("id2"))) & _near(bins, percent))
             .select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct())
    return _verified(materialize(pairs, "pairs"), sets, percent)


def near_duplicate_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", bands: int = BANDS,
                          rows: int = ROWS, percent: int = PERCENT, size: int = SHINGLE,
                          rounds: int = ROUNDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, ``kept`` is true
    for its row.  Null or empty texts have no shingles and stay alone.  A null
    id is no name: such a row is kept and links nothing.  Every row is judged
    by its own text, so repeated rows come out repeated.
    """
    source = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    features = materialize(_features(source, bands, rows, size), "features")
    filled = features.where("n > 0 AND id IS NOT NULL")
    classes = filled.groupBy("x", "y", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    # Only classes of several documents need a row: the others stand for themselves.
    shared = materialize(classes.where("last > rep").select("x", "y", "n", "rep"), "classes")
    plain = filled.join(_grown(shared), ["x", "y", "n"], "left")
    heads = plain.where("rep IS NULL OR rep = id").select("id", "n", F.explode("keys").alias("key"))
    buckets = heads.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    members = materialize(heads.join(_grown(buckets), "key"), "members")
    members = materialize(members.join(_grown(members.groupBy("id").agg(F.sum("rows").alias("met"))), "id"), "members")
    hubs = members.groupBy("key").agg(F.max_by("id", "met").alias("lead"), F.max_by("n", "met").alias("lead_n"))
    # Bits of those that meet anyone.
    bits = materialize(features.select("id", "bits").join(_grown(members.select("id").distinct()), "id", "left_semi")
                       .dropDuplicates(["id"]), "bits")
    bins = bands * rows
    pairs = _pairs(members.join(_grown(hubs), "key"), bits, bins, percent)
    links = _verified(pairs, _sets_of(source, _both(pairs), size), percent)
    families = _families(links)
    for _ in range(rounds):
        more = _to_hubs(_open(members, families), bits, bins, source, percent, size)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        families = _families(links)
    more = _across(_open(members, families), bits, bins, source, percent, size)
    if not more.isEmpty():
        families = _families(links.unionByName(more))

    ids = features.select("id", "n", "x", "y")
    named = ids.join(_grown(shared), ["x", "y", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    joined = named.join(_grown(families.withColumnRenamed("id", "rep")), "rep", "left")
    component = F.coalesce("family", "rep")
    return joined.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest id; columns unchanged.

    Rows with a null id are kept.  A repeated row (same id) is kept once.
    """
    groups = materialize(near_duplicate_groups(docs, id, text, **options), "groups")
    named = groups.where(F.col(id).isNotNull()).groupBy(id).agg(
        F.count("*").alias("rows"), F.min(F.col("kept").cast("int")).alias("kept"))
    odd = materialize(named.where("rows > 1 OR kept = 0").select(F.col(id).alias("__id"), "kept"), "odd")
    once = docs.join(odd, F.col(id) == F.col("__id"), "left_anti")
    repeated = docs.join(odd.where("kept = 1"), F.col(id) == F.col("__id"), "left_semi").dropDuplicates([id])
    return once.unionByName(repeated)
