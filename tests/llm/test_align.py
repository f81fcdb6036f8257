"""Cross-tokenizer alignment against a plain walk over byte offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from dustpan.llm import align, queries


@pytest.fixture(scope="session")
def files():
    return align.read_vocabularies(queries.vocabulary_path("byte_bpe_50k.json"), queries.vocabulary_path())


class Plain:
    """Both libraries themselves, one text and one offset at a time."""

    def __init__(self, files):
        self.a = Tokenizer.from_str(files[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        self.bytes_a, self.bytes_b = align.ByteLevel(files[0]).bytes, align.Pieces(files[1]).bytes

    def tokens(self, text):
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        data = (" " + text).encode()
        if b"".join(self.bytes_a[i] for i in a) != data or b"".join(self.bytes_b[i] for i in b) != data:
            return [], []
        return a, b

    def groups(self, text):
        a, b = self.tokens(text)
        out, i, j, at_a, at_b = [], 0, 0, 0, 0
        left, right = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                left.append(a[i])
                at_a += len(self.bytes_a[a[i]])
                i += 1
            else:
                right.append(b[j])
                at_b += len(self.bytes_b[b[j]])
                j += 1
            if at_a == at_b:
                out.append((left, right))
                left, right = [], []
        return out

    def rows(self, docs):
        of = [(i, *self.tokens(t), self.groups(t)) for i, t in docs]
        counts = Counter((x[-1], y[-1]) for *_, groups in of for x, y in groups)
        highest = defaultdict(int)
        for (_, y), n in counts.items():
            highest[y] = max(highest[y], n)
        for i, a, b, groups in of:
            links = [(x[-1], y[-1]) for x, y in groups]
            written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            yield (i, len(a), len(b), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links),
                   sum(counts[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if groups else "")


def _order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def odd_texts(odd_rows):
    rng = random.Random(11)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "▁", "\U0001f600", "中", " ", "\u0085", "ǆ", "ʯ", "x" * 30, "1", "!", "'s",
                "<|endoftext|>", "<s>", "<0x41>", "\x00", "̀", " ", "﻿", "ﬁ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["a" * 20_000, " " * 5_000, "\n" * 1_000 + "x", "<|endoftext|>", "é" * 900]
    return [(r[0], r[1]) for r in odd_rows] + [(1000 + k, t) for k, t in enumerate(texts)]


def test_odd_texts_equal_plain_walk(spark, files, odd_texts):
    docs = spark.createDataFrame([(*r, "clash") for r in odd_texts], "doc_id long, text string, pairs string")
    got = align.link_scores(docs, files)
    assert _order(got.collect()) == _order(Plain(files).rows(odd_texts))


def test_given_documents_equal_plain_walk(spark, sf_dir, files):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_cross_tokenizer(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert _order(got.collect()) == _order(Plain(files).rows(docs))


def test_groups_and_byte_ranges(spark, files, odd_texts):
    plain = Plain(files)
    docs = spark.createDataFrame([(k, t, "old") for k, (_, t) in enumerate(odd_texts)], "k long, text string, groups string")
    for r in align.align_texts(docs, files).collect():
        want = plain.groups(odd_texts[r["k"]][1])
        assert [(g["a"], g["b"]) for g in r["groups"]] == want
        data = (" " + r["text"]).encode() if want else b""
        assert b"".join(data[g["start"]:g["end"]] for g in r["groups"]) == data
        assert all(data[g["start"]:g["end"]] == b"".join(plain.bytes_a[i] for i in g["a"]) for g in r["groups"])


def test_empty_table(spark, files):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.link_scores(docs, files).collect() == []
    assert align.align_texts(docs, files).collect() == []


def test_characters_of_the_fast_way(files):
    """Below U+0280 both ways of encoding agree on every character in every neighbourhood."""
    first = align.ByteLevel(files[0])
    texts = [" " + s for c in map(chr, range(0x280)) for s in (c, f"a{c}b", f" {c}", c * 3, f"1{c}2", f"{c} x", f"'{c}")]
    assert first.encode(texts, [True] * len(texts)) == first.encode(texts, [False] * len(texts))


def test_terminals_follow_long_chains():
    a, b = np.arange(2, 2002, 2), np.append(np.arange(1, 1999, 2), 2000)
    to = align.terminals(a, b)
    assert set(to.tolist()) == {len(a) - 1}
    assert align.terminals(np.array([1, 3, 5]), np.array([1, 2, 5])).tolist() == [0, 2, 2, 0, 2, 2]


def test_pair_bound_holds():
    a, b = {0: b"ab", 1: b"b", 2: b"xab"}, {0: b"b", 1: b"cab", 2: b"ab"}
    pairs = sum(x.endswith(y) or y.endswith(x) for x in a.values() for y in b.values())
    assert align.pair_bound(a, b) == pairs


def test_vocabularies_without_plain_bytes_are_refused(files):
    with pytest.raises(ValueError):
        align._lengths({0: b""}, {0: b"a"})
    with pytest.raises(ValueError):
        align.ByteLevel(files[0].replace('"add_prefix_space":false', '"add_prefix_space":true')
                        .replace('"add_prefix_space": false', '"add_prefix_space": true'))


def test_plain_marks_long_runs(files):
    aligner = align.Aligner(*files)
    column = pa.array(["plain text", "a" * 500, " " * 500, None, "", "中", "\u027f ok", "\u0280"])
    assert aligner._plain(column) == [True, False, False, True, True, False, True, False]
