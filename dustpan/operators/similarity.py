"""Contents that are much alike but not identical, as families for review.

All pairs of a hot family would be quadratic, so the result names each file's
family (connected component of the "alike" relation) instead of pairs:

1. equal feature sets collapse to one representative;
2. representatives get keys that alike ones share, each only with partners
   that can still be alike: for texts the key holds the partner's size class as
   well, and only where sizes and places leave enough in common;
3. in crowded keys members are compared with one leader per round, which
   joins a hot family at one comparison per member and key;
4. all keys are then joined exactly, but only across the families found so
   far: members of a key's largest family never meet each other, and vectors
   of a key that is still crowded by others get longer keys instead;
5. components of the verified links give the families.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustpan.storage import materialize, spread

# Keys with more members than this are first linked through leaders.
CROWDED = 512
_ROUNDS = 3
# So many ids are sent to all tasks, rather than the rows they pick being shuffled.
_FEW = 1_000_000


def _fingerprint(links: DataFrame):
    return links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, family) for every node of (a, b) edges; family is the smallest id.

    Alternating large-star and small-star steps, each written out.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialize(links.distinct(), "links")
    before = _fingerprint(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Every link now leads from a larger to a smaller id.
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lows, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(lows.withColumnRenamed("m", "b")).distinct())
        links = materialize(small, "links")
        state = _fingerprint(links)
        if state == before:
            break
        before = state
    roots = links.select(F.col("b").alias("id")).distinct().withColumn("family", F.col("id"))
    return links.select(F.col("a").alias("id"), F.col("b").alias("family")).unionByName(roots)


def _labelled(keys: DataFrame, links: DataFrame | None) -> DataFrame:
    """Keys with the family of each id so far; an unlinked id is its own."""
    return _with_families(keys, None if links is None else connected_components(links))


def _with_families(keys: DataFrame, families: DataFrame | None) -> DataFrame:
    if families is None:
        return keys.withColumn("label", F.col("id"))
    return keys.join(families, "id", "left").withColumn("label", F.coalesce("family", "id")).drop("family")


def _met(keys: DataFrame) -> DataFrame:
    """Keys that can make a pair, with their number of rows, ``together``; a key has one row of an id at most."""
    own = Window.partitionBy("key")
    counted = keys.withColumn("together", F.count("*").over(own)).withColumn("seekers", F.count_if("seeks").over(own)) \
                  .withColumn("owners", F.count_if("owns").over(own))
    return materialize(counted.where("together > 1 AND seekers > 0 AND owners > 0").drop("seekers", "owners"), "keys")


def _few(ids: DataFrame) -> DataFrame:
    """Distinct written ``ids``, marked for all tasks if they are few."""
    ids = materialize(ids.distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= _FEW else ids


def _leader_links(members: DataFrame, distance: Callable, limit: float) -> DataFrame | None:
    """Verified (a, b) links of members (id, key) of crowded keys to their leaders."""
    links = None
    for step in range(_ROUNDS):
        rows = materialize(_labelled(members, links), "labelled")
        draw = F.xxhash64("id", F.lit(step))
        lowest = rows.groupBy("key").agg(F.min(draw).alias("draw"))
        leaders = rows.select("key", draw.alias("draw"), F.col("id").alias("a"), F.col("label").alias("leading")) \
                      .join(lowest, ["key", "draw"]).drop("draw")
        pairs = (rows.join(leaders, "key").where(F.col("label") != F.col("leading"))
                 .select("a", F.col("id").alias("b")).distinct())
        near = materialize(distance(pairs).where(F.col("d") <= limit).select("a", "b"), "near")
        if near.isEmpty():
            break
        links = near if links is None else links.unionByName(near)
    return links


def _second(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).alias(c + "2") for c in rows.columns])


def _pair() -> list[Column]:
    return [F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")]


def _largest(rows: DataFrame) -> DataFrame:
    """(key, largest, families, others): a key's largest family, and how many rows are not in it."""
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("key").agg(F.max_by("label", "n").alias("largest"), F.count("*").alias("families"),
                                     (F.sum("n") - F.max("n")).alias("others"))


def _cross_pairs(rows: DataFrame, fits: Column) -> DataFrame:
    """Pairs of a seeking and an owning row that share a key but not a family.

    Per key the largest family only meets the others, so no hot family is
    paired with itself; the few rows are the buffered side of the joins.
    """
    # Written, so that adaptive execution can split a crowded key's rows.
    largest = materialize(_largest(rows).where("families > 1").select("key", "largest"), "largest")
    tagged = rows.join(largest, "key").withColumn("minor", F.col("label") != F.col("largest")).drop("largest")
    meet = (F.col("key") == F.col("key2")) & (F.col("label") != F.col("label2")) & fits
    seeking, owning = tagged.where("seeks"), _second(tagged.where("owns"))
    with_minors = seeking.join(owning.where("minor2"), meet)
    with_majors = seeking.where("minor").join(owning.where("NOT minor2"), meet)
    return with_minors.select(*_pair()).unionByName(with_majors.select(*_pair()))


def _links(keys: DataFrame, fits: Column, distance: Callable, limit: float, crowd: int,
           finer: Callable[[DataFrame, int], DataFrame | None] | None = None) -> DataFrame:
    """(a, b) links whose components are those of all pairs within ``limit`` sharing a key.

    ``keys``: id, key, seeks, owns, and what ``fits`` compares (the owning
    row's columns end in 2).  ``finer(ids, level)``, if given, has longer keys
    for ids whose key stays crowded by rows outside its largest family, or None.
    """
    keys = _met(keys)
    seeking, owning = keys.where("seeks"), _second(keys.where("owns"))
    crowded = keys.where(F.col("together") > crowd)
    if crowded.isEmpty():
        pairs = seeking.join(owning, (F.col("key") == F.col("key2")) & fits).select(*_pair()).distinct()
        return distance(pairs).where(F.col("d") <= limit).select("a", "b")
    known = _leader_links(materialize(crowded.select("id", "key"), "members"), distance, limit)
    families = None if known is None else connected_components(known)
    rows = materialize(_with_families(keys, families), "labelled")
    few, many = rows.where(F.col("together") <= crowd), rows.where(F.col("together") > crowd)
    level = 1
    while finer:
        stubborn = materialize(_largest(many).where(F.col("others") > crowd).select("key"), "stubborn")
        longer = None if stubborn.isEmpty() else finer(
            many.join(stubborn, "key", "left_semi").select("id").distinct(), level)
        if longer is None:
            break
        rest = many.join(stubborn, "key", "left_anti")
        many = materialize(rest.unionByName(_with_families(_met(longer), families)), "labelled")
        level += 1
    # Rows of a small key all meet; only a crowded one is worth knowing the largest family of.
    meet = (F.col("key") == F.col("key2")) & (F.col("label") != F.col("label2")) & fits
    pairs = few.where("seeks").join(_second(few.where("owns")), meet).select(*_pair()).unionByName(_cross_pairs(many, fits)).distinct()
    found = distance(pairs).where(F.col("d") <= limit).select("a", "b")
    return found if known is None else found.unionByName(known)


def _representatives(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written ``rows`` of the first id per ``key``, and (id, rep) for all ids.

    They are read as ``rows`` without the copies, and not written again.
    """
    first = rows.groupBy("key").agg(F.min("id").alias("rep"))
    mapping = materialize(rows.select("id", "key").join(first, "key").select("id", "rep"), "reps")
    copies = mapping.groupBy("id").agg(F.max(F.col("id") == F.col("rep")).alias("first")).where("NOT first").select("id")
    return rows.where("id IS NOT NULL").join(_few(copies), "id", "left_anti").drop("key"), mapping


def _families(mapping: DataFrame, links: DataFrame) -> DataFrame:
    """(id, family) for every input row."""
    labels = connected_components(links).withColumnRenamed("id", "rep")
    return mapping.join(labels, "rep", "left").select("id", F.coalesce("family", "rep").alias("family"))


# -- texts ------------------------------------------------------------------

def with_shingles(files: DataFrame, words: int = 3) -> DataFrame:
    """Replace ``text`` by ``features``: sorted distinct hashes of its runs of words.

    Words are lower case and split at anything but letters and digits.  They
    are a column of their own, so that they are computed once per row.
    """
    tokens = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = files.withColumn("__w", tokens)
    runs = F.greatest(F.size("__w") - (words - 1), F.lit(0))
    shifted = [F.slice("__w", F.lit(k + 1), runs).alias(f"w{k}") for k in range(words)]
    hashed = F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(words)]))
    return rows.withColumn("features", F.sort_array(F.array_distinct(hashed))).drop("__w", "text")


def _set_key() -> Column:
    """Equal for equal feature arrays; two independent hashes and the length tell others apart."""
    return F.struct(F.xxhash64("features").alias("x"), F.hash("features").alias("h"), F.size("features").alias("n"))


def _jaccard_distance(sets: DataFrame) -> Callable:
    left = sets.select(F.col("id").alias("a"), F.col("features").alias("fa"))
    right = sets.select(F.col("id").alias("b"), F.col("features").alias("fb"))

    def distance(pairs: DataFrame) -> DataFrame:
        common = F.size(F.array_intersect("fa", "fb"))
        union = F.size("fa") + F.size("fb") - common
        return (pairs.join(left, "a").join(right, "b")
                .select("a", "b", (1 - common / union).alias("d")))

    return distance


# Longs of a set's sketch.
SET_LONGS = 32


def _set_sketches(sets: DataFrame) -> DataFrame:
    """(id, n, sketch): a bit per class of hashes, whether an odd number of the set's features is in it."""
    kind, bits = sets.schema["id"].dataType.simpleString(), 64 * SET_LONGS

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sizes = np.asarray(pc.list_value_length(part.column("features")))
                kinds = np.asarray(part.column("features").flatten()) & (bits - 1)
                at = np.repeat(np.arange(len(sizes)), sizes) * bits + kinds
                odd = (np.bincount(at, minlength=len(sizes) * bits) & 1).astype(np.uint8).reshape(len(sizes), bits)
                cuts = pa.array(np.arange(len(sizes) + 1) * SET_LONGS, pa.int32())
                longs = np.packbits(odd, axis=1).view("int64").reshape(-1)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(cuts, longs)],
                                                 names=["id", "n", "sketch"])

    return sets.select("id", "features").mapInArrow(sketched, f"id {kind}, n bigint, sketch array<bigint>")


def _sifted_jaccard(sets: DataFrame, threshold: float) -> Callable:
    """Distance of the pairs whose sketches do not rule them out; features are only fetched for those.

    One pair of each set comes first, and pairs of sets that these links join
    already are left out then: the pairs of a family are quadratic.

    Where sketches differ in a bit the sets differ in a feature, and sets that
    are alike differ in (1 - t) / (1 + t) of their features at most, so no alike
    pair is lost.
    """
    sketches = materialize(_set_sketches(sets), "sketches")
    differing = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(SET_LONGS)), F.lit(0))
    most = (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-6

    def distance(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        of = lambda some: some.select(F.col("a").alias("id")).unionByName(some.select(F.col("b").alias("id")))
        held = sketches.join(_few(of(pairs)), "id", "left_semi")
        first, second = (held.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x)) for x in "ab")
        near = materialize(pairs.join(first, "a").join(second, "b").where(differing <= most).select("a", "b").distinct(), "sifted")
        exact = lambda some: _jaccard_distance(sets.join(_few(of(some)), "id", "left_semi"))(some)
        ahead = materialize(exact(materialize(near.groupBy("b").agg(F.min("a").alias("a")), "ahead")), "distances")
        families = connected_components(ahead.where(F.col("d") <= 1 - threshold).select("a", "b"))
        at_a, at_b = (families.select(F.col("id").alias(x), F.col("family").alias("f" + x)) for x in "ab")
        open_ = near.join(at_a, "a", "left").join(at_b, "b", "left").where(
            F.coalesce("fa", "a") != F.coalesce("fb", "b")).select("a", "b").join(ahead, ["a", "b"], "left_anti")
        return ahead.unionByName(exact(materialize(open_, "open")))

    return distance


def _size_class(n: Column) -> Column:
    """Classes of set sizes: exact up to 8, then a quarter wider each."""
    wide = F.floor(F.log(n / 8.0) / math.log(1.25)) + 8
    return F.when(n <= 8, n).otherwise(wide).cast("bigint")


def _prefix_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, key, n, most, reach, seeks, owns) of the exact prefix filter, with size classes in the key.

    Alike sets share one of their rarest features.  Where x first meets y, the
    two have at most ``rest`` features in common, the shareable ones from there
    on in either set, and they need t / (1 + t) * (n_x + n_y).  So each entry
    knows the largest partner it can have (``reach``), and the smaller set
    seeks the larger one in the size classes up to ``most``; entries that can
    have no partner at all are not made.
    """
    exploded = sets.select("id", F.size("features").alias("n"), F.explode("features").alias("s"))
    # Features of a single set cannot be shared; they only use up prefix places.
    # Counted beside the rows, which are shuffled once for it; a feature has a narrow row per set, of hundreds that a set has.
    common = exploded.withColumn("df", F.count("*").over(Window.partitionBy("s"))).where("df > 1")
    ranked = (common.groupBy("id", "n")
              .agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared")))
    # The small slack keeps rounding from shortening a prefix.
    places = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1
    take = F.least(F.col("n"), places) - (F.col("n") - F.size("shared"))
    prefix = F.slice("shared", F.lit(1), F.greatest(take, F.lit(0)).cast("int"))
    entries = ranked.select("id", F.col("n").cast("bigint").alias("n"), F.size("shared").alias("size"), F.posexplode(prefix))
    rest = F.col("size") - F.col("pos")
    reach = F.floor(rest * ((1 + threshold) / threshold) - F.col("n") + 1e-9)
    entries = entries.select("id", "n", F.col("col.s").alias("s"), reach.alias("reach"),
                             F.least(F.floor(F.col("n") / threshold + 1e-9), reach).alias("most"))
    own, last = _size_class(F.col("n")), _size_class(F.greatest("most", "n"))
    spread_out = entries.select("*", own.alias("own"), F.explode(F.sequence(own, last)).alias("slot")).select(
        "id", F.xxhash64("s", "slot").alias("key"), "n", "most", "reach", (F.col("most") >= F.col("n")).alias("seeks"),
        ((F.col("slot") == F.col("own")) & (F.col("reach") >= F.col("n") * threshold - 1e-9)).alias("owns"))
    return spread_out.where("seeks OR owns")


def _can_be_alike() -> Column:
    """The smaller set seeks, the larger owns, and each is within the other's reach."""
    smaller = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2")))
    return smaller & (F.col("n2") <= F.col("most")) & (F.col("n") <= F.col("reach2"))


def near_duplicates(files: DataFrame, threshold: float = 0.4, words: int = 3,
                    crowd: int = CROWDED) -> DataFrame:
    """Files of families with two or more different contents alike.

    ``files``: ord, path, hash, text.  Alike means a Jaccard similarity of the
    sets of ``words``-word runs of at least ``threshold``.
    """
    texts = spread(files.select(F.col("ord").alias("id"), "path", "hash", "text"))
    rows = materialize(with_shingles(texts, words).withColumn("key", _set_key()), "features")
    keyed = rows.where(F.size("features") > 0).select("id", "features", "key")
    sets, mapping = _representatives(keyed)
    links = _links(_prefix_keys(sets, threshold), _can_be_alike(), _sifted_jaccard(sets, threshold), 1 - threshold, crowd)
    member = rows.select("id", "path", "hash").join(_families(mapping, links), "id")
    # Contents per family: copies of one content are counted before they meet.
    contents = member.groupBy("family", "hash").agg(F.count("*").alias("n"))
    size = contents.groupBy("family").agg(F.count("*").alias("contents"), F.sum("n").alias("files"))
    return (member.join(size.where("contents > 1"), "family")
            .select("path", "hash", "family", "contents", "files"))


# -- feature vectors --------------------------------------------------------

@F.pandas_udf(T.DoubleType())
def _angle(left: pd.Series, right: pd.Series) -> pd.Series:
    if not len(left):
        return pd.Series([], dtype="float64")
    x, y = np.stack(left.to_numpy()), np.stack(right.to_numpy())
    return pd.Series(np.arccos(np.clip(np.einsum("ij,ij->i", x, y), -1.0, 1.0)))


# Longs of a vector's sketch, and the chance that a pair at the limit differs in more of its bits than are let pass.
SKETCH_LONGS, SKETCH_MISS = 4, 1e-9


def _sketches(vectors: DataFrame, seed: int = 11) -> DataFrame:
    """(id, sketch): the sides of random planes, 64 to a long; planes of their own, independent of the keys'."""
    kind = vectors.schema["id"].dataType.simpleString()

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None  # drawn once per task
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], 64 * SKETCH_LONGS))
            longs = np.packbits(x @ planes > 0, axis=1).view("int64")
            cuts = pa.array(np.arange(len(x) + 1) * SKETCH_LONGS, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(cuts, longs.reshape(-1))],
                                             names=["id", "sketch"])

    return vectors.select("id", "features").mapInArrow(sides, f"id {kind}, sketch array<bigint>")


def _differing(limit: float) -> int:
    """Bits in which the sketches of a pair at the limit differ at most, but for a chance of SKETCH_MISS."""
    bits, p = 64 * SKETCH_LONGS, limit / math.pi
    tail = 0.0
    for k in range(bits, 0, -1):
        tail += math.comb(bits, k) * p**k * (1 - p)**(bits - k)
        if tail > SKETCH_MISS:
            return k
    return 0


def _angle_distance(vectors: DataFrame) -> Callable:
    left = vectors.select(F.col("id").alias("a"), F.col("features").alias("fa"))
    right = vectors.select(F.col("id").alias("b"), F.col("features").alias("fb"))

    def distance(pairs: DataFrame) -> DataFrame:
        return (pairs.join(left, "a").join(right, "b")
                .select("a", "b", _angle("fa", "fb").alias("d")))

    return distance


def _sifted(vectors: DataFrame, limit: float, distance: Callable) -> Callable:
    """``distance`` for pairs whose sketches are near; most pairs wider than ``limit`` are left out.

    So vectors are only fetched for few pairs: a pair is a small row and a
    vector is not.
    """
    sketches = materialize(_sketches(vectors), "sketches")
    first = sketches.select(F.col("id").alias("a"), *[F.col("sketch")[k].alias(f"a{k}") for k in range(SKETCH_LONGS)])
    second = sketches.select(F.col("id").alias("b"), *[F.col("sketch")[k].alias(f"b{k}") for k in range(SKETCH_LONGS)])
    differing = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(SKETCH_LONGS)), F.lit(0))
    most = _differing(limit)

    def sifted(pairs: DataFrame) -> DataFrame:
        return distance(pairs.join(first, "a").join(second, "b").where(differing <= most).select("a", "b"))

    return sifted


def _plane_keys(vectors: DataFrame, bands: int, bits: int, seed: int = 7) -> DataFrame:
    """(id, key, seeks, owns) from the sides of ``bits`` random planes per band."""
    kind = vectors.schema["id"].dataType.simpleString()

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None  # drawn once per task
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], bands * bits))
            above = (x @ planes > 0).reshape(len(x), bands, bits)
            codes = (above * (1 << np.arange(bits, dtype="int64"))).sum(axis=2)
            cuts = pa.array(np.arange(len(x) + 1) * bands, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(cuts, codes.reshape(-1))],
                                             names=["id", "codes"])

    coded = vectors.select("id", "features").mapInArrow(sides, f"id {kind}, codes array<bigint>")
    both = F.lit(True)
    return coded.select("id", F.posexplode("codes").alias("band", "code")).select(
        "id", F.xxhash64(F.lit(bits), "band", "code").alias("key"), both.alias("seeks"), both.alias("owns"))


# Planes added per band where a bucket stays crowded by unlike vectors, and the most per band.
FINER_BITS, MOST_BITS = 8, 30


def near_duplicate_vectors(vectors: DataFrame, min_cosine: float = 0.95,
                           miss: float = 1e-6, crowd: int = CROWDED) -> DataFrame:
    """Families of feature vectors (id, vector) with a cosine of at least ``min_cosine``.

    Planes per band grow with the number of vectors, and bands are chosen so
    that a pair at the limit is missed with probability ``miss`` at most.
    Vectors of a bucket that is crowded by unlike ones get longer keys in more
    bands, again with ``miss``, instead of being paired there.  Sketches that
    pairs are sifted by add SKETCH_MISS to it.
    """
    unit = F.transform("vector", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x))
    rows = (vectors.withColumn("__norm", norm).where("__norm > 0")
            .select("id", F.transform(unit, lambda x: x / F.col("__norm")).alias("features")))
    points, mapping = _representatives(materialize(spread(rows).withColumn("key", _set_key()), "vectors"))
    limit = math.acos(min_cosine)
    bits = min(max(math.ceil(math.log2(max(points.count(), 2))), 8), MOST_BITS)

    def keys_of(some: DataFrame, bits: int) -> DataFrame:
        agree = (1 - limit / math.pi) ** bits
        return _plane_keys(some, math.ceil(math.log(miss) / math.log(1 - agree)), bits)

    def finer(ids: DataFrame, level: int) -> DataFrame | None:
        wanted = bits + level * FINER_BITS
        return keys_of(points.join(ids, "id", "left_semi"), wanted) if wanted <= MOST_BITS else None

    distance = _sifted(points, limit, _angle_distance(points))
    links = _links(keys_of(points, bits), F.col("id") < F.col("id2"), distance, limit, crowd, finer)
    families = _families(mapping, links)
    sizes = families.groupBy("family").agg(F.count("*").alias("members")).where("members > 1")
    return families.join(sizes, "family").select("id", "family", "members")
