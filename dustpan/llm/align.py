"""Alignment of two tokenizers' ids over the same bytes, by pointer jumping.

Both tokenizers cut a text's bytes completely, so their tokens overlap in
chains that end wherever both cut.  Every token points to its farthest-right
overlapping token: the other side's token over its last byte where that one
reaches further, else (both end there) the first side's token, which points to
itself and is the chain's terminal.  Doubling all pointers of a block of texts
at once (``p = p[p]``) until nothing changes leads every token to its terminal
in the logarithm of the longest chain, and the terminal names its group.

Two tokens that end together are a link.  How often an id pair is linked in
the whole corpus is counted by Spark.  The table of counts is bounded by the
vocabularies, not by the corpus: of two tokens that end together one is a
suffix of the other, so ``pair_bound`` limits it, and it is checked before it
travels with the job.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dustpan.llm.words import blocks, text_bytes
from dustpan.storage import materialize

MARK = "▁"
# Rows scored together.
_TOGETHER = 256
# Texts whose bytes stay below this (so that all characters lie below U+0280) and whose runs with or without
# white space are no longer than this are encoded by merging ranks; others by the tokenizer file's own library,
# which is slower, knows its own tables of newer characters, and takes long runs in its stride.  Same ids.
_PLAIN_BYTE, _PLAIN_RUN = 0xCA, 400


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE of a ``tokenizers`` file; special tokens' strings are plain text."""

    def __init__(self, file: str):
        self.library = Tokenizer.from_str(file)
        self.library.encode_special_tokens = True
        parts, alphabet = json.loads(file), _byte_alphabet()
        vocabulary = parts["model"]["vocab"]
        if parts["pre_tokenizer"]["type"] != "ByteLevel" or parts["pre_tokenizer"]["add_prefix_space"] or parts["normalizer"]:
            raise ValueError("not a plain byte-level vocabulary")
        # A special token's own entry never comes out of plain text.
        self.bytes = {i: bytes(alphabet.get(c, 0x3F) for c in entry) for entry, i in vocabulary.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parts["model"]["merges"]]
        ranks = [vocabulary[a + b] for a, b in merges]
        self._ranked = None
        if parts["pre_tokenizer"]["use_regex"] and ranks == sorted(ranks):
            special = {vocabulary.get(t["content"]) for t in parts["added_tokens"]}
            # The library's own cut of texts into words, stated as its documentation gives it.
            words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            known = {entry: i for i, entry in self.bytes.items() if i not in special}
            self._ranked = tiktoken.Encoding("own", pat_str=words, mergeable_ranks=known, special_tokens={})

    def encode(self, texts: list[str], plain: list[bool]) -> list[list[int]]:
        if self._ranked is None:
            plain = [False] * len(texts)
        odd = [text for text, easy in zip(texts, plain, strict=True) if not easy]
        slow = iter(self.library.encode_batch_fast(odd, add_special_tokens=False) if odd else [])
        return [self._ranked.encode_ordinary(text) if easy else next(slow).ids
                for text, easy in zip(texts, plain, strict=True)]


class Pieces:
    """A SentencePiece model, which puts the text's leading space itself."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.vocab_size()
        self.bytes = {i: bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace(MARK, " ").encode()
                      for i in range(size) for piece in [self.library.id_to_piece(i)]}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def pair_bound(a: dict[int, bytes], b: dict[int, bytes]) -> int:
    """How many id pairs can end together: those of which one is a suffix of the other."""
    of_a, of_b = Counter(a.values()), Counter(b.values())
    suffixes = lambda own, other: sum(
        n * other.get(entry[k:], 0) for entry, n in own.items() for k in range(1, len(entry)))
    return suffixes(of_a, of_b) + suffixes(of_b, of_a) + sum(n * of_b.get(entry, 0) for entry, n in of_a.items())


class Lengths(NamedTuple):
    """Bytes per id of both sides, and every id in decimal with each separator behind it."""
    a: np.ndarray
    b: np.ndarray
    written: np.ndarray


_AFTER = (",", "|", ";", "")


def _lengths(a: dict[int, bytes], b: dict[int, bytes]) -> Lengths:
    if not all(a.values()) or not all(b.values()):
        raise ValueError("a vocabulary has an entry without bytes")
    of = lambda entries: np.array([len(entries.get(i, b"")) for i in range(max(entries) + 1)], np.int64)
    top = max(max(a), max(b)) + 1
    return Lengths(of(a), of(b), np.array([f"{i}{end}" for i in range(top) for end in _AFTER], object))


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each token (first side, then second) the terminal of its group, an index into the first side.

    Ends are ascending byte offsets; both sides end at the same last byte.
    """
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)  # the other side's token over this one's last byte
    over_b = np.searchsorted(ends_a, ends_b)
    points = np.concatenate([np.where(ends_b[over_a] > ends_a, n + over_a, np.arange(n)), over_b])
    while True:
        further = points[points]
        if np.array_equal(further, points):
            return points
        points = further


class Aligned(NamedTuple):
    """A block's tokens; the tokens of text i are those from bound[i] to bound[i + 1]."""
    ids_a: np.ndarray
    ids_b: np.ndarray
    bound_a: np.ndarray
    bound_b: np.ndarray
    group_a: np.ndarray   # running number of each token's group in the block
    group_b: np.ndarray
    last_a: np.ndarray    # each group's last token per side; these two end together
    last_b: np.ndarray


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bound = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)]).astype(np.int64)
    return np.fromiter((i for own in ids for i in own), np.int64, int(bound[-1])), bound


class Aligner:
    """Both vocabularies in a task."""

    def __init__(self, file: str, model: bytes):
        self.first, self.second = ByteLevel(file), Pieces(model)
        self.lengths = _lengths(self.first.bytes, self.second.bytes)

    def _plain(self, column: pa.Array) -> list[bool]:
        data, offsets = text_bytes(column)
        if not len(data):
            return [True] * len(column)
        white = (data == 32) | ((data >= 9) & (data <= 13))
        breaks = np.unique(np.concatenate([np.flatnonzero(white[1:] != white[:-1]) + 1, offsets]))
        long = np.flatnonzero(np.diff(breaks) > _PLAIN_RUN)
        odd = np.concatenate([breaks[long], np.flatnonzero(data >= _PLAIN_BYTE)])
        return (np.bincount(np.searchsorted(offsets, odd, "right") - 1, minlength=len(column))[:len(column)] == 0).tolist()

    def align(self, column: pa.Array) -> Aligned:
        texts, plain = column.to_pylist(), self._plain(column)
        whole = [" " + text if text else "" for text in texts]
        ids_a = self.first.encode(whole, plain)
        ids_b = self.second.encode([text or "" for text in texts])
        of_a, of_b = self.first.bytes.__getitem__, self.second.bytes.__getitem__
        for k, text in enumerate(whole):
            data = text.encode("utf-8", "surrogatepass")
            if not text or b"".join(map(of_a, ids_a[k])) != data or b"".join(map(of_b, ids_b[k])) != data:
                ids_a[k] = ids_b[k] = []
        a, bound_a = _flat(ids_a)
        b, bound_b = _flat(ids_b)
        if not len(a):
            none = np.zeros(0, np.int64)
            return Aligned(a, b, bound_a, bound_b, none, none, none, none)
        # Both sides spell the same bytes, so offsets may run on from text to text.
        to = terminals(np.cumsum(self.lengths.a[a]), np.cumsum(self.lengths.b[b]))
        last_a = np.flatnonzero(to[:len(a)] == np.arange(len(a)))
        group_a, group_b = np.searchsorted(last_a, to[:len(a)]), np.searchsorted(last_a, to[len(a):])
        last_b = np.searchsorted(group_b, np.arange(len(last_a)), "right") - 1
        return Aligned(a, b, bound_a, bound_b, group_a, group_b, last_a, last_b)

    def written(self, x: Aligned) -> list[str]:
        """Per text ``a1,a2|b1;a3|b2,b3``: the groups' ids in decimal."""
        groups = np.arange(len(x.last_a))
        place_a = np.arange(len(x.ids_a)) + np.concatenate([[0], x.last_b + 1])[x.group_a]
        place_b = np.arange(len(x.ids_b)) + (x.last_a + 1)[x.group_b]
        after = np.zeros(len(x.ids_a) + len(x.ids_b), np.int64)
        code = np.zeros_like(after)
        code[place_a], code[place_b] = x.ids_a, x.ids_b
        after[place_a[x.last_a[groups]]], after[place_b[x.last_b[groups]]] = 1, 2
        bound = x.bound_a + x.bound_b
        ends = bound[1:][bound[1:] > bound[:-1]] - 1
        after[ends] = 3
        parts = self.lengths.written[code * len(_AFTER) + after].tolist()
        return ["".join(parts[at:to]) for at, to in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


def _lists(values: np.ndarray, bound: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(values, kind))


def _groups_before(x: Aligned) -> np.ndarray:
    """Groups before each text, and in all."""
    return np.searchsorted(x.last_a, x.bound_a)


def read_vocabularies(byte_level: str, pieces: str) -> tuple[str, bytes]:
    """Contents of a ``tokenizers`` file and of a SentencePiece model; they travel with the job."""
    with open(byte_level, encoding="utf-8") as first, open(pieces, "rb") as second:
        return first.read(), second.read()


def align_texts(docs: DataFrame, vocabularies: tuple[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with ``groups``: per group its ids on both sides and its byte range in space + text.

    A text that is null or empty, or that one of the tokenizers changes, has an
    empty list.  An existing column ``groups`` is replaced; all others, and
    repeated rows, are kept as they are.
    """
    kept = [f for f in docs.schema.fields if f.name != "groups"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*vocabularies)
        for batch in batches:
            for block in blocks(batch, text):
                x = aligner.align(block.column(text))
                before = _groups_before(x)
                sizes = np.cumsum(aligner.lengths.a[x.ids_a])
                ends = sizes[x.last_a] if len(x.last_a) else np.zeros(0, np.int64)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                first = np.repeat(starts[np.minimum(before[:-1], max(len(ends) - 1, 0))] if len(ends) else np.zeros(len(block), np.int64),
                                  np.diff(before))
                cut = lambda last: np.concatenate([[0], last + 1])
                groups = pa.StructArray.from_arrays(
                    [_lists(x.ids_a, cut(x.last_a), pa.int32()), _lists(x.ids_b, cut(x.last_b), pa.int32()),
                     pa.array(starts - first, pa.int64()), pa.array(ends - first, pa.int64())], names=["a", "b", "start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [*(block.column(f.name) for f in kept), pa.ListArray.from_arrays(pa.array(before, pa.int32()), groups)],
                    names=[*(f.name for f in kept), "groups"])

    return docs.select([f"`{f.name}`" for f in kept]).mapInArrow(
        run, schema + ", groups array<struct<a:array<int>,b:array<int>,start:bigint,end:bigint>>")


def alignments(docs: DataFrame, vocabularies: tuple[str, bytes], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, pairs, times): digests of the groups, and each linked id pair with its times.

    A pair is written as ``a * S + b``, where S is the size of the second
    vocabulary.  One row per input row; without tokens the digest is ''.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*vocabularies)
        wide = len(aligner.lengths.b)
        span = len(aligner.lengths.a) * wide
        for batch in batches:
            for block in blocks(batch, text):
                x = aligner.align(block.column(text))
                before = _groups_before(x)
                linked = x.ids_a[x.last_a] * wide + x.ids_b[x.last_b]
                row = np.repeat(np.arange(len(block)), np.diff(before))
                keys, times = np.unique(row * span + linked, return_counts=True)
                bound = np.searchsorted(keys, np.arange(len(block) + 1) * span)
                digests = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in aligner.written(x)]
                yield pa.RecordBatch.from_arrays(
                    [block.column(id), pa.array(np.diff(x.bound_a)), pa.array(np.diff(x.bound_b)), pa.array(np.diff(before)),
                     pa.array(digests, pa.string()), _lists(keys % span, bound, pa.int64()), _lists(times, bound, pa.int32())],
                    names=[id, "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    return docs.select(id, text).mapInArrow(
        run, f"`{id}` {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, "
             "pairs array<bigint>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold each id pair; added up before they are shuffled."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.*")
    return each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))


def link_scores(docs: DataFrame, vocabularies: tuple[str, bytes], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    ``n_best`` counts the links whose id pair is linked as often in the corpus
    as any pair of its second id; ``count_sum`` adds the counts of all links.
    A null id is kept; texts without tokens have zeros and the digest ''.
    """
    aligned = materialize(alignments(docs, vocabularies, id, text), "aligned")
    first, second = ByteLevel(vocabularies[0]).bytes, Pieces(vocabularies[1]).bytes
    wide = max(second) + 1
    counted = pair_counts(aligned).toArrow()  # at most pair_bound rows
    if counted.num_rows > pair_bound(first, second):
        raise AssertionError("more linked id pairs than the vocabularies allow")
    order = np.argsort(counted.column("pair").to_numpy())
    pairs, counts = counted.column("pair").to_numpy()[order], counted.column("n").to_numpy()[order]
    highest = np.zeros(wide, np.int64)
    np.maximum.at(highest, pairs % wide, counts)
    best = counts == highest[pairs % wide]
    kind = aligned.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(start, _TOGETHER)
                linked, times = (part.column(c).flatten().to_numpy() for c in ("pairs", "times"))
                bound = np.concatenate([[0], np.cumsum(pc.list_value_length(part.column("pairs")).to_numpy())])
                at = np.searchsorted(pairs, linked)
                sums = [np.concatenate([[0], np.cumsum(v, dtype=np.int64)]) for v in
                        (times, times * best[at], times * counts[at])]
                columns = [pa.array(s[bound[1:]] - s[bound[:-1]]) for s in sums]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in (id, "n_a", "n_b", "n_groups")), *columns, part.column("groups_sha256")],
                    names=[id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return aligned.mapInArrow(
        run, f"`{id}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
             "count_sum bigint, groups_sha256 string")
