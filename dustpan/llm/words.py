"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return, with A-Z lower-cased.  Words are named by a 64-bit
hash of their bytes, the same in every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A block of rows is cut so that its texts hold about so many bytes; one longer text is a block of its own.
BLOCK_BYTES = 1 << 17


class Words(NamedTuple):
    data: np.ndarray    # lower-cased bytes of all texts
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray    # byte after each word
    bound: np.ndarray   # the words of text i are bound[i]:bound[i + 1]
    hashes: np.ndarray  # uint64 per word


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` well-spread uint64 constants."""
    steps = np.arange(1 + salt * 1_000_003, 1 + salt * 1_000_003 + n, dtype=np.uint64)
    return mix(steps * np.uint64(0x9E3779B97F4A7C15))


_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array) -> Words:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    solid = np.ones(256, bool)
    solid[[9, 10, 11, 12, 13, 32]] = False
    raw, offsets = text_bytes(column)
    data = lower[raw]
    inside = solid[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    at, to = offsets[:-1][full], offsets[1:][full] - 1
    first[at], last[to] = inside[at], inside[to]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bound = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(data, starts, ends, bound, np.zeros(0, np.uint64))
    lengths = ends - starts
    # Only bytes of words, one word after the other; a byte counts by its place in its word.
    value = seeds(256)[data[inside]]
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(value), dtype=np.int32) - np.repeat(at.astype(np.int32), lengths)
    value *= np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))[place]
    return Words(data, starts, ends, bound, mix(np.add.reduceat(value, at) + lengths.astype(np.uint64)))


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of single words, as ``words_of`` gives them."""
    return words_of(pa.array(words, pa.large_string())).hashes


def owner(bound: np.ndarray) -> np.ndarray:
    """Index of the text each entry belongs to."""
    return np.repeat(np.arange(len(bound) - 1), np.diff(bound))


def per_text(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sums of float values per text; 0 for a text without any."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bound[1:]] - total[bound[:-1]]


def blocks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about BLOCK_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // BLOCK_BYTES
    cuts = np.flatnonzero(np.diff(part)) + 1
    for at, to in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if to > at:
            yield batch.slice(at, to - at)


def in_blocks(each: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text") -> Callable:
    """A function for ``mapInArrow`` that hands ``each`` one block at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text):
                yield each(block)
    return run
