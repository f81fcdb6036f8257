"""Boilerplate out of texts by a tree of line templates.

A *unit* is a sentence of a line (lines are split behind ``.``, ``!`` and ``?``
before a space), with its white space turned to single spaces.  Units run down
a tree of fixed depth: the number of words, then the leading third of the words
(two at least), which names the leaf.  Words with a digit are variable fields
from the start, ``<*>``, unless they are most of the unit.

In a leaf the other words are counted by position.  A word that stands in its
place in few units of the leaf is a variable field, and as what is few depends
on how far a template has spread, ``LEVELS`` gives several answers: at each
level a unit's template keeps the words at least so frequent and has ``<*>``
for the others, a fifth of the words at most, or one (sentences that differ in more
are different sentences, however they begin and end).

A template, with fields or without, is dropped from every text where it recurs
in ``LEAST`` documents that are otherwise different.  Units of fewer than
``SHORT`` words have no fields but those with digits, must begin or end a line,
and need ``LEAST_SHORT`` documents.  Copies and near copies of one document are
one document: each text has a sketch, the least hash of its words in each of
sixteen classes of hashes, and a document is different from two reference documents of
the template where it agrees with neither in more than half of the classes.  A
passage weighs in this by its share of the texts' words, so it does not matter
how many texts have it.

All of it is DataFrame functions.  Units travel as narrow rows; counts are
combined before they are shuffled, and the templates and leaves that hold more
than a thousandth of all rows, a thousand at most, are joined by broadcast, so
that none of them lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustpan.llm.rows import packed, unpacked
from dustpan.storage import materialize

LEAST, SHORT, LEAST_SHORT = 3, 5, 10
# A word is part of a template where it is at least so frequent; the last level lies beyond any table.
LEVELS = tuple(3 * 4 ** k for k in range(16))
FIELD = "<*>"
# Units of a line are numbered below this.
_LINE_BITS = 24
_LINE = 1 << _LINE_BITS
# Short units so near to a dropped one on both sides go with it.
_NEAR = 3
_BINS, _HEAVY = 16, 1000

_WHITE = r"[\x20\x09-\x0D]+"
# A word with a digit; tried at the beginnings of words only.
_DIGITS = r"(?<![^\x20])[^\x200-9]*+[0-9][^\x20]*+"


def _sentences(line: Column) -> Column:
    """Sentences of a line; a line break marks where they end, as plain replacing and splitting are quicker than expressions."""
    for end in ".!?":
        line = F.replace(line, F.lit(f"{end} "), F.lit(f"{end}\n "))
    return F.split(line, "\n")


def _plain(unit: Column) -> Column:
    """A unit with spaces for all white space, and none at its ends."""
    return F.trim(F.when(unit.rlike(r"[\x09-\x0D]"), F.regexp_replace(unit, _WHITE, " ")).otherwise(unit))


def _squeezed(plain: Column) -> Column:
    """A plain unit with one space between words."""
    return F.when(plain.contains("  "), F.regexp_replace(plain, "  +", " ")).otherwise(plain)


def _n_words(squeezed: Column) -> Column:
    """Words of a squeezed unit; 1 if it has none."""
    return F.octet_length(squeezed) - F.octet_length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1


def _masked(squeezed: Column, n: Column) -> Column:
    """A squeezed unit with fields for words with a digit, unless they are more than half of its ``n`` words."""
    fields = F.regexp_count(squeezed, F.lit(_DIGITS))
    masked = F.when(fields * 2 <= n, F.regexp_replace(squeezed, _DIGITS, FIELD)).otherwise(squeezed)
    return F.when(squeezed.rlike("[0-9]"), masked).otherwise(squeezed)


def _lead(n: Column) -> Column:
    """How many leading words name the leaf."""
    return F.greatest(F.lit(2), F.floor(n / 3)).cast("int")


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t"), F.hash(text).alias("t2")]


def _hashes(text: Column) -> Column:
    """Sorted hashes of a text's words, and before the hashes of each class (their first four bits) its lower bound."""
    bounds = F.array(*[F.lit(k << 60) for k in range(-_BINS // 2, _BINS // 2)])
    return F.sort_array(F.concat(F.transform(F.split(text, " "), lambda w: F.xxhash64(w)), bounds))


def _least(hashes: str) -> Column:
    """What follows each class's lower bound in ``_hashes``: its least hash, or the next bound, or null."""
    return F.array(*[F.get(hashes, F.array_position(hashes, F.lit(k << 60)).cast("int")) for k in range(-_BINS // 2, _BINS // 2)])


def _sketch(least: str) -> list[Column]:
    """Two longs, a byte per class: of the class's least hash, 0 if it has none."""
    half = _BINS // 2
    in_class = lambda x, i: F.shiftright(x, 60) == i - half
    byte = F.transform(least, lambda x, i: F.when(in_class(x, i), x.bitwiseAND(255)).otherwise(F.lit(0).cast("bigint")))

    def packed_bytes(first: int) -> Column:
        last_first = F.reverse(F.slice(byte, first + 1, half))
        return F.aggregate(last_first, F.lit(0).cast("bigint"), lambda sum_, x: F.shiftleft(sum_, 8).bitwiseOR(x))

    return [packed_bytes(0).alias("s1"), packed_bytes(half).alias("s2")]


def _alike(one: str, other: str) -> Column:
    """Whether two sketches (column prefixes) agree in more than half of the classes."""
    same = F.lit(0)
    for s in ("s1", "s2"):
        differ = F.col(one + s).bitwiseXOR(F.col(other + s))
        for k in range(_BINS // 2):
            same += (F.shiftrightunsigned(differ, 8 * k).bitwiseAND(255) == 0).cast("int")
    return same > _BINS // 2


def _parts(texts: DataFrame, columns: list[str], places: str | None = None) -> DataFrame:
    """``columns`` with (place, edge, odd, part) of all units of ``text``, or of those whose place is in ``places``.

    ``edge`` says whether the unit begins or ends its line, ``odd`` whether the
    line has white space other than spaces, or digits.
    """
    hit = F.array_distinct(F.transform(places, lambda p: F.shiftright(p, _LINE_BITS).cast("int"))) if places else F.lit(None)
    # Outer, as otherwise the optimizer tests for empty arrays, and splits twice for that; there are none.
    lines = texts.select(*columns, hit.alias("hit"), F.split("text", "\n").alias("lines")).select(
        *columns, "hit", F.posexplode_outer("lines").alias("line", "content"))
    if places:
        lines = lines.where(F.array_contains("hit", F.col("line")))
    odd = F.col("content").rlike(r"[\x09-\x0D0-9]")
    cut = lines.select(*columns, "line", odd.alias("odd"), _sentences(F.col("content")).alias("parts"))
    # The size by itself, as otherwise the whole array would be carried along with each of its parts.
    told = cut.select(*columns, "line", "odd", F.size("parts").alias("n_parts"), "parts")
    parts = told.select(*columns, "line", "odd", "n_parts", F.posexplode_outer("parts").alias("unit", "part"))
    place = F.col("line") * F.lit(_LINE).cast("bigint") + F.col("unit")
    if places:
        parts = parts.where(F.array_contains(places, place))
    edge = (F.col("unit") == 0) | (F.col("unit") == F.col("n_parts") - 1)
    return parts.select(*columns, place.alias("place"), edge.alias("edge"), "odd", "part")


def units(docs: DataFrame, text: str = "text") -> DataFrame:
    """(t, t2, s1, s2, place, key, leaf, needs) of all units that may be dropped, and of some that have no ``needs``.

    t and t2 name the whole text, s1 and s2 are its sketch; ``key`` is the
    template without other fields than those with digits, and ``needs`` the
    documents it must recur in.  A unit stays one string here: its words are
    counted and cut off, never made an array, as that is most of the work.
    """
    whole = docs.select(F.col(text).alias("text")).where("text <> ''")
    # Of each text once, before its lines are exploded.
    hashed = whole.select("text", _hashes(F.col("text")).alias("h"))
    named = hashed.select("text", _least("h").alias("least")).select(
        "text", *_text_key(F.col("text")), *_sketch("least"))
    # Most that are too short, told without their words; the others have no ``needs``.
    spaced = F.octet_length(F.substring_index("part", " ", SHORT - 1)) < F.octet_length("part")
    parts = _parts(named, ["t", "t2", "s1", "s2"]).where(F.col("edge") | F.col("odd") | spaced)
    squeezed = _squeezed(F.when(F.col("odd"), _plain(F.col("part"))).otherwise(F.trim("part")))
    own = ["t", "t2", "s1", "s2", "place", "edge"]
    plain = parts.select(*own, "odd", squeezed.alias("plain"))
    counted = plain.select(*own, "odd", "plain", _n_words(F.col("plain")).alias("n"))
    masked = F.when(F.col("odd"), _masked(F.col("plain"), F.col("n"))).otherwise(F.col("plain"))
    masked = counted.select(*own, "n", "plain", masked.alias("w"))
    lead = F.call_function("substring_index", F.col("w"), F.lit(" "), _lead(F.col("n")))
    key = F.xxhash64("w")
    leaf = F.when(F.col("n") >= SHORT, F.xxhash64(F.lit("leaf"), "n", lead)).otherwise(key)
    needs = F.when(F.col("n") >= SHORT, LEAST).when(F.col("edge") & (F.col("plain") != ""), LEAST_SHORT)
    return masked.select("t", "t2", "s1", "s2", "place", key.alias("key"), leaf.alias("leaf"), needs.alias("needs"))


def _joined(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """Written ``rows`` joined to a written ``side`` of one row per ``key`` with its number of rows, ``n_rows``.

    Of keys with more than a thousandth of the ``total`` rows there are a
    thousand at most: they are broadcast, and their rows are not shuffled.
    """
    heavy = side.where(F.col("n_rows") * _HEAVY > total)
    if heavy.isEmpty():
        return rows.join(side, key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(side, key))


def recurring(rows: DataFrame) -> DataFrame:
    """(key, n_rows) of the templates of ``rows`` (key, needs, t, s1, s2) that recur in as many different documents as they need."""
    seen = materialize(rows.groupBy("key", "t").agg(
        F.min("needs").alias("needs"), F.min("s1").alias("s1"), F.min("s2").alias("s2"), F.count("*").alias("n")), "seen")
    text = F.struct("t", "s1", "s2")
    refs = (seen.groupBy("key").agg(F.min(text).alias("lo"), F.max(text).alias("hi"), F.count("*").alias("n_rows"),
                                    F.sum("n").alias("all_rows"), F.min("needs").alias("needs")).where("n_rows >= needs")
            .select("key", "n_rows", "all_rows", "needs", F.col("lo.s1").alias("lo_s1"), F.col("lo.s2").alias("lo_s2"),
                    F.col("hi.s1").alias("hi_s1"), F.col("hi.s2").alias("hi_s2")))
    refs = materialize(refs.withColumn("base", F.when(_alike("lo_", "hi_"), 1).otherwise(2)), "references")
    met = _joined(seen.drop("needs", "n"), refs, "key", seen.count())
    apart = ~_alike("", "lo_") & ~_alike("", "hi_")
    # Both references are alike to themselves, so they are not counted here.
    counted = met.groupBy("key").agg(F.count_if(apart).alias("others"), F.max("base").alias("base"),
                                     F.max("needs").alias("needs"), F.max("all_rows").alias("n_rows"))
    return counted.where("others + base >= needs").select("key", "n_rows")


def _with_fields(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(t, t2, s1, s2, place, key, needs): templates with variable fields of the units ``rows`` (t, t2, s1, s2, place)."""
    own = ["t", "t2", "s1", "s2"]
    wanted = materialize(rows.groupBy("t", "t2").agg(F.min("s1").alias("s1"), F.min("s2").alias("s2"),
                                                     F.collect_set("place").alias("places")), "suspects")
    first, second = _text_key(F.col("text"))
    texts = docs.select(F.col(text).alias("text")).where("text <> ''").join(
        wanted.hint("shuffle_hash"), (first == F.col("t")) & (second == F.col("t2"))).select(*own, "places", "text")
    lead = _lead(F.col("n"))
    plain = _parts(texts, [*own, "places"], "places").select(*own, "place", _squeezed(_plain(F.col("part"))).alias("plain"))
    words = plain.select(*own, "place", F.split(_masked(F.col("plain"), _n_words(F.col("plain"))), " ").alias("w"))
    found = words.select(*own, "place", F.size("w").alias("n"), "w").select(
        *own, "place", "n", lead.alias("lead"),
        F.xxhash64("n", F.slice("w", F.lit(1), lead)).alias("leaf"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    # A text's units once, however many rows have it.
    found = materialize(found.dropDuplicates(["t", "place"]), "words")
    each = found.select("t", "place", "s1", "s2", "n", "lead", "leaf", F.posexplode("h").alias("pos", "word")).where("pos >= lead")
    each = each.withColumn("at", F.xxhash64("leaf", "pos", "word"))
    often = materialize(each.groupBy("at").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= LEVELS[0]), "often")
    total = int(found.agg(F.sum(F.col("n") - F.col("lead"))).first()[0] or 0)
    kept = _joined(each.select("t", "place", "pos", "at"), often, "at", total).groupBy("t", "place").agg(
        F.sort_array(F.collect_list(F.struct("pos", "at", "n_rows"))).alias("kept"))
    most = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    fixed = lambda level: F.filter("kept", lambda k: k["n_rows"] >= level)
    template = lambda level: F.xxhash64(F.lit("fields"), "leaf", F.transform(fixed(level), lambda k: k["at"]))
    keys = F.array(*[F.when(F.col("n") - F.col("lead") - F.size(fixed(level)) <= most, template(level)) for level in LEVELS])
    return (found.drop("h").join(kept, ["t", "place"]).where(F.size("kept") >= F.col("n") - F.col("lead") - most)
            .select("t", "t2", "s1", "s2", "place", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"),
                    F.lit(LEAST).alias("needs")))


def dropped_places(docs: DataFrame, text: str = "text") -> DataFrame:
    """(t, t2, places): units to drop, for texts that have any."""
    # Filtered when read: a filter before it would work out all words twice.
    rows = materialize(units(docs, text), "units").where("needs IS NOT NULL")
    total = rows.count()
    both = rows.groupBy("leaf").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n_rows"))
    leaves = materialize(both.where("a < b").select("leaf", "n_rows"), "leaves")
    shared = materialize(_joined(rows, leaves, "leaf", total).drop("n_rows"), "shared")
    gone = materialize(recurring(shared.select("key", "needs", "t", "s1", "s2")), "gone")
    found = materialize(_joined(shared, gone, "key", total).select("t", "t2", "place", "key"), "found")
    # What is left, in leaves that still hold units enough for a template.
    open_units = materialize(_without_keys(shared.where(F.col("needs") == LEAST), gone, total).select("t", "t2", "s1", "s2", "place", "leaf"), "open")
    full = materialize(open_units.groupBy("leaf").agg(F.count("*").alias("n_rows"), F.min("t").alias("a"), F.max("t").alias("b"))
                       .where((F.col("n_rows") >= LEAST) & (F.col("a") < F.col("b"))).select("leaf", "n_rows"), "full")
    suspects = _joined(open_units, full, "leaf", total).select("t", "t2", "s1", "s2", "place")
    general = materialize(_with_fields(docs, suspects, text), "general")
    gone = materialize(recurring(general.select("key", "needs", "t", "s1", "s2")), "gone")
    more = _joined(general.select("t", "t2", "place", "key"), gone, "key", max(general.count(), 1))
    places = found.select("t", "t2", "place").unionByName(more.select("t", "t2", "place"))
    return materialize(places.groupBy("t", "t2").agg(F.array_sort(F.collect_set("place")).alias("places")), "places")


def _without_keys(rows: DataFrame, gone: DataFrame, total: int) -> DataFrame:
    """Rows whose key is not ``gone``; heavy keys as in ``_joined``."""
    heavy = gone.where(F.col("n_rows") * _HEAVY > total)
    rest = rows.join(F.broadcast(heavy.select("key")), "key", "left_anti") if not heavy.isEmpty() else rows
    return rest.join(gone.select("key"), "key", "left_anti")


def _without(text: Column, places: Column) -> Column:
    """``text`` less the units at ``places``; a line that loses all its words goes whole."""
    def gone(part: Column, at: Column) -> Column:
        near = lambda *steps: F.arrays_overlap(places, F.array(*[at + k for k in steps]))
        short = _n_words(_squeezed(_plain(part))) < SHORT
        return F.array_contains(places, at) | (
            near(*range(-_NEAR, 0)) & near(*range(1, _NEAR + 1)) & short)

    def line(content: Column, number: Column) -> Column:
        first = number.cast("bigint") * _LINE
        hit = F.exists(places, lambda p: (p >= first) & (p < first + _LINE))
        left = F.array_join(F.filter(_sentences(content), lambda part, i: ~gone(part, first + i)), "")
        # In an array, so that it is worked out once.
        kept = F.get(F.transform(F.array(left), lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.ltrim(x))), F.lit(0))
        return F.when(~hit, content).otherwise(kept)

    lines = F.transform(F.split(text, "\n"), line)
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def drop_templates(docs: DataFrame, text: str = "text", changed: str | None = None) -> DataFrame:
    """``docs`` with recurring templates dropped from ``text``; one row per input row, other columns unchanged.

    Null and empty texts stay as they are; so does every text without a
    dropped unit, to the byte.  A text of boilerplate only becomes empty.
    Repeated rows are one document.  ``changed`` names a column for the number
    of units dropped by template; an existing column of that name is replaced.
    Working columns cannot clash: the caller's travel in one struct.
    """
    places = dropped_places(docs, text)
    columns = [c for c in docs.columns if c != changed]
    others = [c for c in columns if c != text]
    rows = docs.select(packed(docs, others).alias("row"), F.col(f"`{text}`").alias("whole"))
    first, second = _text_key(F.col("whole"))
    joined = rows.join(places.hint("shuffle_hash"), (first == F.col("t")) & (second == F.col("t2")), "left")
    cleaned = F.when(F.col("places").isNull(), F.col("whole")).otherwise(_without(F.col("whole"), F.col("places")))
    own = dict(zip(others, unpacked("row", others), strict=True)) | {text: cleaned.alias(text)}
    result = [own[c] for c in columns]
    if changed:
        result.append(F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias(changed))
    return joined.select(*result)
