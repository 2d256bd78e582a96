"""Whole texts as byte arrays: word hashes and shingles of many documents at once.

A word is a maximal run of letters and digits in UTF-8 (ASCII letters and digits, and every byte from
0x80 on); ASCII letters compare in lower case. Words hash to 64 bits by a polynomial over their bytes,
taken from prefix sums, then mixed. Documents never share a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in pieces of about this size: some ten arrays of eight times as much are all that a worker holds.
CHUNK_BYTES = 512 << 10
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SEED = np.uint64(0xD1B54A32D192ED03)
#: Another odd number: its hashes are independent of the first one's.
OTHER = 0xC2B2AE3D27D4EB4F

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, CHUNK_BYTES + 4096), base & _MASK, np.uint64)
        found[0] = 1
        found = _powers[base] = np.multiply.accumulate(found)
    return found


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets of each; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def give_back() -> None:
    """Freed memory goes back to the system, which the allocators would keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU C library only
    if trim is not None:
        trim(0)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``limit`` bytes of text, one row at least, with bytes and offsets."""
    raw, offsets = texts_of(batch.column(batch.schema.get_field_index(text)))
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start), raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end
    give_back()  # a worker lives on; its next task may be another operator's


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of members; a run ends with its document."""
    n = len(member)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = member.copy()
    starts[1:] &= ~member[:-1] | first[1:n]
    ends = member.copy()
    ends[:-1] &= ~member[1:] | first[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class Spans:
    """64-bit hashes of spans of some bytes, from prefix sums that are taken once."""

    def __init__(self, raw: np.ndarray, base: int = _ODD):
        n = len(raw)
        self.powers = powers(base, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(pow(base, -1, 1 << 64), n + 1)[:n], out=self.prefix[1:])

    def runs(self, size: int) -> np.ndarray:
        """Hashes of all spans of one size, by the place where they start."""
        n = max(0, len(self.prefix) - size)
        value = self.prefix[size:] - self.prefix[:n]
        value *= self.powers[:n]
        return mix64(value ^ np.uint64(size * int(_SEED) & _MASK))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.prefix[ends] - self.prefix[starts]) * self.powers[starts]
        return mix64(value ^ ((ends - starts).astype(np.uint64) * _SEED))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    return Spans(raw)(starts, ends)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its hash; for each document the place of its first word (one more at the end)."""
    starts, ends = spans(_WORD[raw], offsets)
    return hash_spans(_LOWER[raw], starts, ends), np.searchsorted(starts, offsets)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The document of each item, from the places of the first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each document, and the places of the first ones.

    A document of one to k - 1 words has one shingle, of all its words; one without words has none.
    """
    n, doc = len(words), rows_of(first)
    if n >= k:
        value = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            value = value * np.uint64(_ODD) + words[j : n - k + 1 + j]
        whole = doc[: n - k + 1] == doc[k - 1 :]
        value, owner = mix64(value[whole]), doc[: n - k + 1][whole]
    else:
        value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.diff(first)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        short = np.uint64(counts[d])
        for w in words[first[d] : first[d + 1]]:
            short = mix64(np.array([short ^ w]))[0]
        value, owner = np.append(value, short), np.append(owner, d)
    return distinct(value, owner, len(first) - 1)


def distinct(value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each of n documents, and the places of the first ones."""
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n + 1))


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column from all values and the places of the first ones."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
