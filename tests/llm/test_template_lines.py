"""Line templates against a plain version of the same rules, and against planted boilerplate."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from dustpan.llm import template_lines as tl

SENTENCE = re.compile(r"(?<=[.!?])(?=\x20)")
WHITE = "".join(map(chr, [32, *range(9, 14)]))


def _hash(text):
    n = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return n - (1 << 64) if n >> 63 else n


def _units(text):
    for i, line in enumerate(text.split("\n")):
        parts = SENTENCE.split(line)
        for j, part in enumerate(parts):
            words = [w for w in re.sub(f"[{WHITE}]+", " ", part).split(" ") if w]
            fields = [bool(re.search("[0-9]", w)) for w in words]
            if 2 * sum(fields) <= len(words):
                words = ["<*>" if f else w for w, f in zip(words, fields, strict=True)]
            if words:
                yield (i, j), tuple(words), j in (0, len(parts) - 1)


def _sketch(text):
    hashes = [_hash(w) for w in text.split(" ")]
    least = [min((h for h in hashes if h >> 60 == k), default=None) for k in range(-8, 8)]
    return [0 if h is None else h & 255 for h in least]


def _recurring(uses, needs, sketch, order):
    """Keys whose texts hold as many different documents as they need."""
    out = set()
    alike = lambda a, b: sum(x == y for x, y in zip(sketch[a], sketch[b], strict=True)) > 8
    for key, texts in uses.items():
        low, high = min(texts, key=order.get), max(texts, key=order.get)
        apart = sum(not alike(t, low) and not alike(t, high) for t in texts)
        if len(texts) >= needs[key] and apart + (1 if alike(low, high) else 2) >= needs[key]:
            out.add(key)
    return out


def plain_places(texts):
    """text -> places of the units to drop."""
    texts = sorted({t for t in texts if t})
    sketch, order = {t: _sketch(t) for t in texts}, {t: _hash(t) for t in texts}
    units = [(t, p, w, edge) for t in texts for p, w, edge in _units(t) if len(w) >= tl.SHORT or edge]
    uses = defaultdict(set)
    for t, _, w, _ in units:
        uses[w].add(t)
    needs = {w: tl.LEAST if len(w) >= tl.SHORT else tl.LEAST_SHORT for w in uses}
    gone = _recurring(uses, needs, sketch, order)
    places = defaultdict(set)
    for t, p, w, _ in units:
        if w in gone:
            places[t].add(p)
    lead = lambda w: max(2, len(w) // 3)
    leaf = lambda w: (len(w), w[:lead(w)])
    left = [(t, p, w) for t, p, w, _ in units if len(w) >= tl.SHORT and w not in gone]
    size, texts_of = Counter(leaf(w) for _, _, w in left), defaultdict(set)
    for t, _, w in left:
        texts_of[leaf(w)].add(t)
    left = [(t, p, w) for t, p, w in left if size[leaf(w)] >= tl.LEAST and len(texts_of[leaf(w)]) > 1]
    count = Counter((leaf(w), k, x) for _, _, w in left for k, x in enumerate(w) if k >= lead(w))
    uses, keys = defaultdict(set), defaultdict(set)
    for t, p, w in left:
        for level in tl.LEVELS:
            kept = tuple((k, x) for k, x in enumerate(w) if k >= lead(w) and count[leaf(w), k, x] >= level)
            if len(w) - lead(w) - len(kept) <= max(1, len(w) // 5):
                uses[leaf(w), kept].add(t)
                keys[t, p].add((leaf(w), kept))
    gone = _recurring(uses, dict.fromkeys(uses, tl.LEAST), sketch, order)
    for (t, p), own in keys.items():
        if own & gone:
            places[t].add(p)
    return {t: {i * tl._LINE + j for i, j in p} for t, p in places.items()}


def spark_places(docs):
    keys = {(r["t"], r["t2"]): r["text"] for r in docs.where("text <> ''").select("text", *tl._text_key(docs["text"])).collect()}
    return {keys[r["t"], r["t2"]]: set(r["places"]) for r in tl.dropped_places(docs).collect()}


SYLLABLES = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "is", "or")]


def prose(rng, sentences, words=(6, 16)):
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
    return [" ".join(word() for _ in range(rng.randint(*words))).capitalize() + rng.choice(".!?") for _ in range(sentences)]


@pytest.fixture(scope="module")
def planted():
    """(documents, boilerplate per document, own sentences per document)."""
    rng = random.Random(8)
    passage = prose(rng, 22)  # some 240 words
    middle = lambda: " ".join(prose(rng, 1, (3, 3))).rstrip(".!?").lower()
    docs, own, planted = {}, {}, {}
    for i in range(160):
        sentences = prose(rng, rng.choice([3, 8, 20, 40]))
        extra = []
        if i % 8:  # in most texts
            extra.append(" ".join(passage))
        if i % 3 == 0:
            extra.append("All rights reserved.")
        if i % 4 == 0:
            extra.append("Home\tAbout us\tContact the owner\tLegal matters")
        if i % 4 == 1:
            extra.append(f"Posted by {middle().split()[0]} in the general section.")
        if i % 5 == 2:
            extra.append(f"Page {i} of {2 * i + 3} in this archive")
        unlike = [f"The price of bread in {middle()} is known to all."] if i % 12 == 5 else []
        cut = rng.randint(0, len(sentences))
        docs[i] = "\n".join([" ".join(sentences[:cut]), *extra, *unlike, " ".join(sentences[cut:])])
        own[i], planted[i] = sentences + unlike, extra
    base = prose(rng, 30)
    for i in range(200, 260):  # near copies, a word changed here and there
        copy = " ".join(base).split(" ")
        for _ in range(6):
            copy[rng.randrange(len(copy))] = rng.choice(SYLLABLES)
        docs[i], own[i], planted[i] = " ".join(copy), [" ".join(copy)], []
    for i in range(300, 340):  # exact copies
        docs[i], own[i], planted[i] = docs[1], own[1], planted[1]
    short = prose(rng, 3)
    for i in range(400, 420):  # near copies of a short text
        docs[i], own[i], planted[i] = " ".join(short) + f" {SYLLABLES[i - 400]}.", short, []
    return docs, own, planted


def test_planted_boilerplate_goes_and_own_text_stays(spark, planted):
    docs, own, boilerplate = planted
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in tl.drop_templates(rows).collect()}
    for i, text in docs.items():
        assert [s for s in own[i] if s not in left[i]] == []
        assert [x for x in boilerplate[i] if re.sub("[0-9]", "", x) in re.sub("[0-9]", "", left[i])] == []
        if not boilerplate[i]:
            assert left[i] == text


def test_equals_plain_version_on_planted_texts(spark, planted):
    rows = spark.createDataFrame(list(planted[0].items()), "doc_id long, text string")
    assert spark_places(rows) == plain_places(planted[0].values())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_equals_plain_version_on_given_texts(spark, folder):
    rows = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("text")
    want = plain_places([r["text"] for r in rows.collect()])
    assert want and spark_places(rows) == want


def test_passage_in_every_text(spark):
    """However many texts have a long passage, it goes from all of them."""
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    passage = " ".join(prose(rng, 27))
    docs = spark.createDataFrame([(i, f"{text}\n{passage}") for i, text in rows if text], "doc_id long, text string")
    assert tl.drop_templates(docs).where(f"contains(text, '{passage[:80]}')").count() == 0


def test_columns_that_clash(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(prose(rng, 4)) + "\nThe same line stands in every one.", "a", i, None) for i in range(6)]
    docs = spark.createDataFrame(rows, "row long, text string, places string, t long, t2 string")
    got = tl.drop_templates(docs, changed="t2")
    assert got.columns == ["row", "text", "places", "t", "t2"] and {r["t2"] for r in got.collect()} == {1}
    assert sorted((r["row"], r["places"], r["t"]) for r in got.collect()) == [(i, "a", i) for i in range(6)]


def test_heavy_keys_join_like_any(spark, planted, monkeypatch):
    rows = spark.createDataFrame(list(planted[0].items()), "doc_id long, text string")
    want = spark_places(rows)
    for heavy in (1, 20, 10**9):
        monkeypatch.setattr(tl, "_HEAVY", heavy)
        assert spark_places(rows) == want


def test_units_stay_strings_in_compiled_code(spark, planted, capsys):
    """The pass over all texts makes no array of a unit's words, and no method too large for the JVM to compile."""
    rows = spark.createDataFrame(list(planted[0].items()), "doc_id long, text string")
    units = tl.units(rows)
    assert [f.name for f in units.schema if f.dataType.typeName() == "array"] == []
    units.explain("codegen")
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))) < 8000


def test_equals_plain_version_on_odd_units(spark):
    """White space of all kinds, empty words, fields at the ends, units of fields only, and sentences that end oddly."""
    rng = random.Random(6)
    odd = ["  Two  spaces between   the words of this. ", "\tTabs\x0b and \x0c feeds\r\tin 12 of  these 7x words\r", "<*> stands for 3 words here now",
           "5 6 7 8 words", "a1 b2 c3 of them here", "No end here ... but ?! there.  And . again", " . ! ? ", "Größe 5 für alle, nicht mehr. Ça va!",
           "٣ is no digit of these here", "1 2 3", "In line five this space is part of a word."]
    texts = ["\n".join([*prose(rng, 12), *(line.replace("7", str(i)) for line in odd if rng.random() < 0.9), " ".join(prose(rng, 12))]) for i in range(60)]
    want = plain_places(texts)
    assert len(want) == 60 and spark_places(spark.createDataFrame([(t,) for t in texts], "text string")) == want
