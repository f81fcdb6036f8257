"""Chat formatting, SentencePiece, quality rules, mixing, and the queries as registered."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dustpan.llm import chat, mixing, pieces, quality_rules, queries
from tests.compare import spark_bag, sql_bag
from tests.llm.conftest import WORD


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_read_back(spark, sf_dir):
    got = {r["conv_id"]: r for r in queries.op1_chat_format(spark, sf_dir).collect()}
    told = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        told.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    assert got.keys() == told.keys()
    for i, turns in told.items():
        turns.sort()
        learned = "".join(t for _, role, t in turns if role == "assistant")
        assert tuple(got[i])[:5] == (i, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned))


def test_rows_of_one_turn_stay_apart(spark):
    """Repeated rows, ties, null turns, roles, texts and conversations: every row is a message of its own."""
    told = [(1, 0, "user", "hello"), (1, 0, "user", "there"), (1, 1, "assistant", "abcuvw"), (1, 1, "assistant", "abcuvw"),
            (1, 1, "assistant", "defxyz"), (1, None, "user", "no turn"), (1, None, "assistant", None), (1, 2, None, "no role"),
            (None, 0, "user", None), (None, 0, "user", "x"), (2, None, None, None), (3, 0, "user", "w " * 50_000)]
    rows = spark.createDataFrame([(*r, 7) for r in told], "conv_id long, turn long, role string, text string, msg long")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.render(chat.fold(queries.conversation_events(rows)))).collect()}
    want = {}
    first = lambda v: (v is not None, v or 0)
    for conv in {r[0] for r in told}:
        turns = sorted((r[1:] for r in told if r[0] == conv), key=lambda r: (first(r[0]), (r[1] is not None, r[1] or ""), r[2] or ""))
        learned = "".join(t or "" for _, role, t in turns if role == "assistant")
        want[conv] = (len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)), len(learned), sha(learned))
    assert got == want
    none = chat.digests(chat.render(chat.fold(queries.conversation_events(rows.limit(0)))))
    assert none.collect() == []


def test_events_fold(spark):
    log = [(1, 1, "start", 1, "user", "hel"), (1, 2, "delta", 1, None, "lo"), (1, 3, "start", 2, "assistant", "bad"),
           (1, 4, "delta", 2, None, " answer"), (1, 5, "start", 3, "user", "why?"), (1, 6, "regenerate", 2, None, None),
           (1, 7, "delta", 2, None, "good"), (1, 8, "edit", 1, None, "hello!"), (1, 9, "start", 4, None, None),
           (1, 10, "start", 5, "user", "x"), (1, 11, "delete", 5, None, None), (1, 12, "delta", 9, None, "no start"),
           (None, 1, "start", 1, "user", "a"), (None, 1, "start", 1, "user", "a")]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg long, role string, text string")
    turns = sorted(((r["conv_id"] or 0, r["turn"], r["role"], r["text"]) for r in chat.fold(events).collect()))
    assert turns == [(0, 0, "user", "aa"), (1, 0, "user", "hello!"), (1, 1, "assistant", "good"), (1, 2, "", "")]
    assert chat.digests(chat.render(chat.fold(events))).count() == 2
    assert chat.digests(chat.render(chat.fold(events.limit(0)))).count() == 0


def test_escapes_are_reversible(spark):
    rng = random.Random(4)
    parts = ["<", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<<SYS>>", "<</SYS>>", "<|end|>", "<|text|>", "<|turn|>", "a", "\n", "[", "|>", "s>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    turns = spark.createDataFrame([(1, i, t, t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    rows = chat.render(turns).orderBy("turn").collect()
    assert [chat.read_segment(r["segment"]) for r in rows] == [(t, t) for t in texts]
    for r in rows:
        assert r["segment"].count("<|turn|>") == r["segment"].count("<|text|>") == r["segment"].count("<|end|>") == 1


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(queries.vocabulary_path())


def test_pieces_equal_the_library(model, odd_rows):
    table = pieces.PieceTable(model, size=5)
    rng = random.Random(1)
    parts = [" ", "  ", "▁", "\n", "\t", "a", "the", "é", "汉", "\U0001f600", "<s>", "</s>", "<0x0A>", "<unk>", "\x00", "Ä", "0", "�"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [r[1] for r in odd_rows if r[1]]
    for text in texts:
        ids = table.library.encode(text)
        assert table.encode(text) == ids
        assert pieces._surface(table.entries([text])[0]) == table.library.decode(ids)
    assert table.encode(None) == table.encode("") == []


def test_piece_rows(odd, odd_rows, empty, model):
    library = pieces.PieceTable(model).library
    rows = pieces.encode_texts(odd, model).collect()
    assert sorted((r["text"] or "", r["ids"]) for r in rows) == sorted((r[1] or "", library.encode(r[1] or "")) for r in odd_rows)
    digests = pieces.piece_digests(odd, model).collect()
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests) == sorted(
        (len(r["ids"]), sha(",".join(map(str, r["ids"]))), sha(r["decoded"])) for r in rows)
    assert pieces.encode_texts(empty, model).count() == 0


def base_figures(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2)), set()
    for k in range(len(w) - 2):
        if seen[tuple(w[k:k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_rules_equal_brute_force(spark, sf_dir, odd, empty):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        texts = sorted((str(r["doc_id"]), *base_figures(r["text"])) for r in docs.collect())
        rows = quality_rules.apply_rules(docs).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == texts
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert quality_rules.apply_rules(empty).count() == 0


def plain_kept(rows):
    """Verdicts from statistics (lang, source, n_words, ..., n_lines), with exact counts per bucket."""
    def bucket(v):
        power = max(v.bit_length() - 6, 0)
        return v if v < 64 else power * 32 + (v >> power)

    def limits(values, rule):
        counts, top = sorted(Counter(map(bucket, values)).items()), len(values)
        low = lambda b: b if b < 64 else (b - (b // 32 - 1) * 32) << (b // 32 - 1)
        upto, at = 0, {}
        for b, n in counts:
            upto += n
            for q in (25, 50, 75):
                if upto * 100 >= top * q:
                    at.setdefault(q, low(b))
        _, _, step, has_lower = quality_rules.RULES[rule]
        high = at[50] + max(quality_rules.SPREAD * (at[75] - at[50]), step)
        return (at[50] - max(quality_rules.SPREAD * (at[50] - at[25]), step) if has_lower else None), high

    value = lambda r, rule: 0 if not r[quality_rules.RULES[rule][1]] else (
        1000 * r[quality_rules.RULES[rule][0]] // r[quality_rules.RULES[rule][1]])
    kept = []
    for r in rows:
        fine = not r["base_failed"]
        for rule in quality_rules.RULES:
            for group in (lambda o: (o["lang"], o["source"]), lambda o: o["lang"], lambda o: 0):
                same = [value(o, rule) for o in rows if group(o) == group(r)]
                if len(same) >= quality_rules.LEAST_ROWS or group(r) == 0:
                    break
            low, high = limits(same, rule)
            fine &= value(r, rule) <= high and (low is None or value(r, rule) >= low)
        kept.append(fine)
    return kept


def test_verdicts_equal_plain_quantiles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality_rules.apply_rules(docs).collect()
    assert [r["kept"] for r in rows] == plain_kept(rows)
    assert {r["kept"] for r in rows} == {True, False}


def test_rules_take_columns_of_any_name(spark):
    row = (1, "a b c " * 30, "en", "s", "x", 1, 2, 3, 4, 5, "y")
    docs = spark.createDataFrame([row] * 3, "doc_id long, text string, lang string, source string, __w string, kept int, __t int, "
                                            "base_failed int, n_words int, c0 int, row string")
    got = quality_rules.apply_rules(docs)
    assert got.columns == ["doc_id", "lang", "source", "__w", "__t", "c0", "row", *quality_rules.STATISTICS, "base_failed", "kept"]
    assert {tuple(r)[:8] for r in got.collect()} == {(1, "en", "s", "x", 2, 5, "y", 90)}
    assert "kept" in quality_rules.with_base_statistics(docs).columns


def test_sketch_buckets_keep_order_and_precision(spark):
    rows = spark.range(0, 200_000, 37).select("id", quality_rules.bucket(F.col("id")).alias("b"))
    rows = rows.select("id", "b", quality_rules.bucket_floor(F.col("b")).alias("low")).orderBy("id").collect()
    assert all(a["b"] <= b["b"] for a, b in zip(rows, rows[1:], strict=False))
    assert all(r["low"] <= r["id"] <= r["low"] * 33 / 32 + 1 for r in rows)


def test_thresholds_follow_their_group(spark):
    text = lambda marks: " ".join(f"w{i}" + ("|" if i < marks else "") for i in range(60))
    rows = [(i, text(30), "en", "tables") for i in range(150)] + [(1000 + i, text(0), "en", "prose") for i in range(150)]
    rows += [(5000, text(30), "en", "prose"), (5001, text(31), "en", "tables")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(5000) and all(got.values())


def test_mixing_reaches_its_target(spark, odd, empty):
    rows = [(i, "x" * 100, "big" if i % 10 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0), ("absent", 9.0)], "source string, weight double")
    got = mixing.replicate(docs, weights, size=2.0, copy="copy").collect()
    count = Counter(r["source"] for r in got)
    assert abs(count["big"] - 2000) < 200 and abs(count["small"] - 6000) < 350  # a rate of 15 each
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.replicate(docs.repartition(7), weights, size=2.0, copy="copy").collect()))
    assert mixing.replicate(odd).columns == odd.columns and mixing.replicate(empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_equals_sql(spark, sql, sf_dir, name):
    assert spark_bag(queries.all_queries()[name](spark, sf_dir)) == sql_bag(sql, queries.all_oracles()[name])


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, before, sf_dir), "stage")
        if name != "encoding":
            assert after.columns == columns
        if name in ("toxicity", "near-dedup"):
            assert after.subtract(before).count() == 0
        if name == "line dedup":
            assert after.count() == before.count()
        before = after
    assert before.count() > 0 and before.columns == [*columns, "ids", "decoded"]
