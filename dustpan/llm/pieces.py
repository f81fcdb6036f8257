"""SentencePiece encoding and decoding through tables of distinct marked words.

The library turns every space into the marker U+2581 and puts one in front of
the text.  When no piece of a vocabulary has a marker behind another character,
no merge crosses the place in front of a marker run, so a text is the sequence
of its *marked words* (a run of markers and what follows up to the next run),
each segmented on its own.  A task therefore keeps a table of the distinct
marked words it has met, segments each once with the library, and joins the ids
back by position.  The table is emptied when it is full, which only costs the
segmentation of its words anew.

A vocabulary whose pieces do cross a marker, or whose normaliser changes texts,
is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MARK = "▁"
# Distinct marked words a task keeps, besides those of the texts at hand.
TABLE_WORDS = 300_000

_MARKED = re.compile(f"{MARK}+[^{MARK}]*")
# Texts looked up together; their words may stand beside a full table.
_TOGETHER = 64


class Entry(NamedTuple):
    ids: tuple[int, ...]
    written: str  # the ids in decimal, joined by commas
    text: str     # what the library decodes the ids to inside a text


class PieceTable:
    """Encoder and decoder of whole texts, exactly as the library's own.

    Its keys are marked words without their first marker; "" is a marker alone.
    """

    def __init__(self, model: bytes, size: int = TABLE_WORDS):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = size
        self._table: dict[str, Entry] = {}
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces of this vocabulary cross white space markers")
        if self.library.encode(" ", out_type=str) != [MARK * 2]:
            raise ValueError("this vocabulary's normaliser drops or adds white space")
        # In front of a word's ids it takes the library's handling of a text's start upon itself.
        self._start = self.library.piece_to_id(MARK)

    @staticmethod
    def keys(text: str | None) -> list[str]:
        """Keys of a text's marked words, by position."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [word[1:] for word in _MARKED.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def _learn(self, keys: list[str]) -> None:
        # The library puts a marker in front of a text, but none in front of an empty one.
        ids = [tuple(i) or (self._start,) for i in self.library.encode(keys, num_threads=1)]
        texts = self.library.decode([[self._start, *i] for i in ids], num_threads=1)
        for key, own, text in zip(keys, ids, texts, strict=True):
            self._table[key] = Entry(own, ",".join(map(str, own)), text)

    def entries(self, texts: list[str | None]) -> list[list[Entry]]:
        """For each text the rows of its marked words, by position."""
        keys = [self.keys(text) for text in texts]
        if len(self._table) > self.size:
            self._table.clear()
        table = self._table
        missing = {key for own in keys for key in own if key not in table}
        if missing:
            self._learn(list(missing))
        return [[table[key] for key in own] for own in keys]

    def encode(self, text: str | None) -> list[int]:
        return [i for entry in self.entries([text])[0] for i in entry.ids]


def _surface(entries: list[Entry]) -> str:
    """Decoded text; the marker the library put in front is taken away again."""
    return "".join([e.text for e in entries])[1:]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _TOGETHER):
            yield batch.slice(at, _TOGETHER)


def read_model(path: str) -> bytes:
    """A vocabulary file's bytes; they travel with the job, so executors need no copy of the file."""
    with open(path, "rb") as file:
        return file.read()


def encode_texts(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded``, one row per input row.

    A null text is an empty one: no ids, decoded to "".  Existing columns named
    ``ids`` or ``decoded`` are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(model)
        for part in _parts(batches):
            rows = table.entries(part.column(text).to_pylist())
            columns = [part.column(f.name) for f in kept]
            columns.append(pa.array([[i for e in r for i in e.ids] for r in rows], pa.list_(pa.int32())))
            columns.append(pa.array([_surface(r) for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "ids", "decoded"])

    return docs.select([f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def piece_digests(docs: DataFrame, model: bytes, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of ``encode_texts`` without shipping the ids."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(model)
        for part in _parts(batches):
            rows = table.entries(part.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(id), pa.array([sum([len(e.ids) for e in r]) for r in rows], pa.int64()),
                 pa.array([_hex(",".join([e.written for e in r])) for r in rows], pa.string()),
                 pa.array([_hex(_surface(r)) for r in rows], pa.string())],
                names=[id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id, text).mapInArrow(
        run, f"`{id}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
