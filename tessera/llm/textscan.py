"""Arrow text batches as NumPy arrays: chunks, words and rolling hashes.

Texts are UTF-8 bytes throughout.  A null text is an empty one.  Hashes are
64-bit polynomials over the integers modulo 2**64 with random byte values and
a finaliser; equal strings always agree, so hashing never loses a match.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def whitespace_words() -> np.ndarray:
    """Bytes of words `[^\\x20\\x09-\\x0D]+`."""
    is_word = np.ones(256, dtype=bool)
    is_word[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return is_word


def alnum_words() -> np.ndarray:
    """Bytes of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` (after lower-casing)."""
    is_word = np.zeros(256, dtype=bool)
    is_word[0x30:0x3A] = is_word[0x61:0x7B] = is_word[0x80:] = True
    return is_word


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 14) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of up to `limit` bytes of text and `rows` texts (one at least): (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        column = pc.fill_null(column.cast(pa.large_binary()) if not pa.types.is_null(column.type) else pa.nulls(len(column), pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at, n = 0, batch.num_rows
        while at < n:
            end = min(n, at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1))
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes; first[i]:first[i+1] are those of text i."""
    n = len(data)
    inside = is_word[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    fresh[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        _powers[base] = have = np.cumprod(table, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Rolling:
    """Hashes of any range of a sequence of values, each in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _power(n, _BASE), out=self.sums[1:])
        self.back = _power(n + 1, _INVERSE)

    def raw(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def of(self, start, end) -> np.ndarray:
        return mix(self.raw(start, end))


def byte_rolling(data: np.ndarray) -> Rolling:
    return Rolling(_BYTE[data])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return byte_rolling(data).of(starts, ends)


def row_of(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(first: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the words at which `width` words of one text start."""
    total = int(first[-1])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return np.flatnonzero(room >= width)


def ids(batch: pa.RecordBatch, column: str = "doc_id", null: int = np.iinfo(np.int64).max) -> np.ndarray:
    """The ids as int64; a null id is the largest integer."""
    return pc.fill_null(batch.column(column).cast(pa.int64()), null).to_numpy(zero_copy_only=False)
