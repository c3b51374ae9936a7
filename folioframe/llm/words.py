"""Vectorised word scanning over the UTF-8 bytes of whole Arrow string columns.

A word is a maximal run of bytes outside 00-2F, 3A-60 and 7B-7F after A-Z are lower-cased, so it holds ASCII
digits, ASCII letters and every non-ASCII character. Words never cross rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[0x00:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False
#: Bytes of words without digits.
IS_LETTER = IS_WORD.copy()
IS_LETTER[0x30:0x3A] = False
#: Bytes of words that only blanks part.
NO_BLANK = np.ones(256, dtype=bool)
NO_BLANK[0x20] = NO_BLANK[0x09:0x0E] = False
#: An odd base, and its inverse modulo 2**64, of the rolling polynomial hashes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Text is scanned in slices of about so many bytes, so working memory is a small multiple of it.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the result shares no memory with x."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end and each row's offsets in them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of the batch that hold about `most` bytes of text; a longer row is a slice alone."""
    _, offsets = text_bytes(batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column)))
    row, n = 0, batch.num_rows
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        stop = min(max(stop, row + 1), n)
        yield batch.slice(row, stop - row)
        row = stop


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        grown = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        grown[0] = 1
        have = _powers[base] = np.multiply.accumulate(grown)
        if size > 16 * SLICE_BYTES:
            del _powers[base]
    return have[:n]


class Prefix:
    """Polynomial prefix sums over bytes: hash(start, end) of any spans in constant time each."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + U64(1)) * powers(base, len(data)), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), len(data) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * U64(INVERSE))


class Words:
    """starts, ends and hash of every word of the rows; first[i] is the index of row i's first word. kind: the bytes of words."""

    def __init__(self, column: pa.Array, kind: np.ndarray = IS_WORD):
        self.data, self.offsets = text_bytes(column)
        self.low = LOWER[self.data]
        inside = kind[self.low]
        before = np.empty_like(inside)
        before[1:], before[:1] = inside[:-1], False
        filled = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        before[filled] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1], after[-1:] = inside[1:], False
        lasts = self.offsets[1:][self.offsets[1:] > 0] - 1
        after[lasts] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.prefix = Prefix(self.low)
        self.hash = self.prefix.hash(self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of n consecutive words; a row of fewer words, but not none, has one run of all its words."""
    counts = words.counts
    per_row = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), per_row)
    at = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + words.first[:-1][row]
    padded = np.concatenate([words.hash, np.zeros(n, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    left = (words.first[1:][row] - at).astype(np.int64)
    for j in range(n):
        term = padded[at + j] * U64(pow(BASE, 2 * j + 3, 1 << 64))
        total += term if j == 0 else np.where(left > j, term, U64(0))
    return row, mix(total)


def counted(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) in order, and how often each occurs."""
    if not len(row):
        return row, value, np.zeros(0, np.int64)
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))
