"""Words of whole Arrow batches as 64-bit hashes, without a Python object per word.

A word is a run of bytes other than the six ASCII white-space bytes, with A-Z lower-cased. Its hash is a polynomial in
its bytes modulo 2^64, taken from one running sum over the batch, then mixed with the word's length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18
#: Bytes of text that are turned into strings at once.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def give_back_memory() -> None:
    """Free memory goes back to the system. A Python worker serves one task after another and keeps what an earlier one
    has freed, beside what the next one asks for."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values. numpy's own unique() goes by a hash table, which is many times slower than its sort."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def distinct_places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and where each element of x is among them."""
    order = np.argsort(x)
    in_order = x[order]
    first = np.concatenate([[True], in_order[1:] != in_order[:-1]]) if len(x) else np.zeros(0, dtype=bool)
    places = np.empty(len(x), dtype=np.int64)
    places[order] = np.cumsum(first) - 1
    return in_order[first], places


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of one block of texts. ``first[i]:first[i + 1]`` are those of text i."""

    __slots__ = ("first", "hashes", "lengths")

    def __init__(self, first: np.ndarray, hashes: np.ndarray, lengths: np.ndarray):
        self.first, self.hashes, self.lengths = first, hashes, lengths


class WordHasher:
    def __init__(self):
        self.up, self.down = _powers(BLOCK_BYTES + 1, _BASE), _powers(BLOCK_BYTES + 1, _BASE_INVERSE)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """data: the texts' bytes, one after another; offsets: where each starts, and the end."""
        n = len(data)
        up, down = (self.up, self.down) if n < len(self.up) else (_powers(n + 1, _BASE), _powers(n + 1, _BASE_INVERSE))
        inside = ~_BLANK[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begins[edges] = inside[edges]  # a word ends where its text ends
        starts = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[edges - 1] = inside[edges - 1]
        stops = np.flatnonzero(ends) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        lengths = (stops - starts).astype(np.uint64)
        hashes = mix((sums[stops] - sums[starts]) * down[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))
        return Words(np.searchsorted(starts, offsets), hashes, lengths)


def _large(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts with 64-bit offsets, nulls as empty, and those offsets."""
    texts = (pc.fill_null(texts, "") if texts.null_count else texts).cast(pa.large_string())
    return texts, np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]


def _runs_of_rows(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end
        row = end


def blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to) of about BLOCK_BYTES of text, with their bytes and offsets. Null texts are empty."""
    if not batch.num_rows:
        return
    texts, offsets = _large(batch.column(column))
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    for row, end in _runs_of_rows(offsets, BLOCK_BYTES):
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of about SLICE_BYTES of text, with their texts as strings: only so much of a batch exists as Python
    objects at a time. Null texts are empty."""
    if not batch.num_rows:
        return
    texts, offsets = _large(batch.column(column))
    for row, end in _runs_of_rows(offsets, SLICE_BYTES):
        yield batch.slice(row, end - row), texts.slice(row, end - row).to_pylist()


def binary_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """The same of a binary column; nulls stay null."""
    values = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for row, end in _runs_of_rows(np.concatenate([[0], np.cumsum(sizes)]), SLICE_BYTES):
        yield batch.slice(row, end - row), values.slice(row, end - row).to_pylist()


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of every run of ``width`` words: len(hashes) - width + 1 values. Runs that cross a text's end are the caller's to drop."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += hashes[k : k + n]
    return mix(out)
