"""Document fingerprints by winnowing.

Every run of ``k`` code points is hashed; of every ``w`` neighbouring hashes
the smallest is selected, of equal ones the rightmost, and the selected hashes
with their positions are the fingerprint.  So two texts that share ``w + k - 1``
code points in a row share a selected hash, whatever stands around them, and
nothing shorter than ``k`` counts.  A text of fewer than ``w`` runs has one
window of all its runs, a text shorter than ``k`` one run of all its code
points, a null or empty text no entries.

An entry is one number: the upper 38 bits of the hash, below them the position
counted down.  The smaller entry is the smaller hash, or the righter of equal
ones, so window minima need only comparisons of shifted arrays, doubling the
width each time.  Positions are kept modulo 2**26; only beyond that a tie may
go to the left.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K, WINDOW = 8, 8
_PLACE_BITS = 26
_PLACES = (1 << _PLACE_BITS) - 1
# Texts that are put next to each other by id are dealt to ranges of about so many.
RANGE_ROWS, MAX_RANGES = 1_000, 16_384


def _entries(text: Column, k: int) -> Column:
    """The entries of all runs, in order."""
    # One code point is consumed at a time, so no run begins inside a surrogate pair.
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    runs = F.when(F.length(text) >= k, every).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    high = F.lit(-1 << _PLACE_BITS)
    return F.transform(runs, lambda run, i: F.xxhash64(run).bitwiseAND(high).bitwiseOR(
        F.lit(_PLACES) - i.bitwiseAND(F.lit(_PLACES))))


def entry_hash(entry: Column) -> Column:
    return F.shiftright(entry, _PLACE_BITS)


def entry_position(entry: Column) -> Column:
    return F.lit(_PLACES) - entry.bitwiseAND(F.lit(_PLACES))


def with_fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint", k: int = K, w: int = WINDOW) -> DataFrame:
    """``docs`` with ``to``: array<bigint> of the selected entries in order of position.

    An existing column of that name is replaced.
    """
    other = [F.col(c) for c in docs.columns if c != to]
    rows = docs.select(*other, _entries(F.coalesce(F.col(text), F.lit("")), k).alias(to))
    wide = 1
    while wide < w:
        shift = min(wide, w - wide)
        # Past the end there is nothing, and least() passes over it.
        wider = F.zip_with(to, F.slice(to, F.lit(shift + 1), F.size(to)), lambda a, b: F.least(a, b))
        rows = rows.select(*other, wider.alias(to))
        wide += shift
    windows = F.slice(to, F.lit(1), F.greatest(F.size(to) - (w - 1), F.lit(1)))
    return rows.select(*other, F.array_distinct(windows).alias(to))


def hashes(entries: str) -> Column:
    """The distinct selected hashes, without positions."""
    return F.array_distinct(F.transform(entries, entry_hash))


def likeness(a: str, b: str) -> Column:
    """Share of the hashes of either set that both have; two empty sets are alike."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - common
    return F.when(either == 0, F.lit(1.0)).otherwise(common / either)


def digest(entries: str) -> Column:
    """A fingerprint in 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(entries, F.lit(1))), 16, "0"), F.lpad(F.hex(F.xxhash64(entries, F.lit(2))), 16, "0")))


def _ranges(docs: DataFrame, id: str, rows: int) -> list[int]:
    """Lower bounds of ranges of ids, of about ``rows`` rows each; at most MAX_RANGES, each bound an id."""
    total = docs.where(F.col(id).isNotNull()).agg(F.count("*").alias("n"), F.min(id).alias("least")).first()
    if not total["n"]:
        return []
    count = min(math.ceil(total["n"] / rows), MAX_RANGES)
    at = [i / count for i in range(1, count)]
    cuts = docs.agg(F.percentile_approx(id, at, max(10_000, 8 * count)).alias("cuts")).first()["cuts"] if at else []
    return sorted({total["least"], *cuts})


def in_order(docs: DataFrame, id: str = "doc_id", rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` dealt to ranges of ids, with ``__range`` and ``__guest``, sorted by both and id in its partitions.

    Each range also gets the first rows of the next one as guests, behind its
    own; the last range gets those of the first.  So the next row of every row
    is found inside its range.  Rows with a null id are spread by their hash.
    """
    bounds = _ranges(docs, id, rows)
    own = F.struct((-1 - F.pmod(F.xxhash64(*docs.columns), F.lit(4096))).cast("int").alias("__range"), F.lit(False).alias("__guest"))
    placed = F.array(own)
    if bounds:
        step = math.isqrt(len(bounds) - 1) + 1
        every, outer = F.lit(bounds), F.lit(bounds[::step])
        upto = lambda bound: F.size(F.filter(bound, lambda b: b <= F.col(id)))
        coarse = (upto(outer) - 1) * step
        fine = coarse + upto(F.slice(every, coarse + 1, F.lit(step))) - 1
        home = F.struct(fine.alias("__range"), F.lit(False).alias("__guest"))
        guest = F.struct(F.pmod(fine - 1, F.lit(len(bounds))).alias("__range"), F.lit(True).alias("__guest"))
        first = F.get(every, fine) == F.col(id)
        placed = F.when(F.col(id).isNull(), placed).when(first, F.array(home, guest)).otherwise(F.array(home))
    dealt = docs.select("*", F.explode(placed).alias("__p")).select(*docs.columns, "__p.__range", "__p.__guest")
    return dealt.repartition("__range").sortWithinPartitions("__range", "__guest", id)


def compare_edits(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, w: int = WINDOW) -> DataFrame:
    """Fingerprints of each text, of an edited text, and their likeness.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many (or all) of the next document's, in ascending order of id, the
    first after the last.  Null texts are empty.  Rows with a null id have no
    next document: their edited text is cut only and near_next is null.  Among
    rows of one id the order is left open.
    """
    base = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = in_order(base, "id")
    marked = with_fingerprints(ordered, "text", "entries", k, w).select("*", hashes("entries").alias("hashes"))
    order = W.partitionBy("__range").orderBy("__guest", "id")
    known = F.col("id").isNotNull()
    paired = marked.select("*", F.when(known, F.lead("text").over(order)).alias("next_text"),
                           F.when(known, F.lead("hashes").over(order)).alias("next_hashes")).where("NOT __guest")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = paired.select("id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), digest("entries").alias("fingerprint"),
                         "hashes", likeness("hashes", "next_hashes").alias("near_next"))
    both = with_fingerprints(rows, "edited", "entries", k, w).select("*", hashes("entries").alias("edited_hashes"))
    return both.select(F.col("id").alias(id), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                       digest("entries").alias("edited_fingerprint"), likeness("hashes", "edited_hashes").alias("near_edited"), "near_next",
                       F.size("edited_hashes").cast("bigint").alias("n_entries"))
