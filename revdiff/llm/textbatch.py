"""Words of a batch of texts as numpy arrays.

All functions work on UTF-8 bytes of many texts at once. Separators are ASCII
bytes, so no character is ever cut. Texts are handled whole; a batch is walked
in slices of about ``SLICE_BYTES`` only to bound memory, and a longer text is a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Bytes of a word above which its hash is no polynomial: for long words, equal ones could be built.
LONG_WORD = 512

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator: a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def word_table(separators: bytes) -> np.ndarray:
    """256 booleans: which bytes belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = word_table(b"\x20" + bytes(range(0x09, 0x0E)))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text in lower case.
ALNUM = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and their n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a column of texts, of at most about ``limit`` bytes each, or of one row."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return slices(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), limit)


class Words:
    """Words of the texts ``buf[offsets[i]:offsets[i + 1]]``.

    ``start``, ``end``: byte positions in ``buf``; ``doc``: row of each word;
    ``hash``: 64-bit hash of the word; ``first``: n + 1 positions of each row's
    words in these arrays.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, lower: bool = True):
        n = len(offsets) - 1
        self.buf = _LOWER[buf] if lower else buf
        inside = table[self.buf]
        if len(buf):
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[heads] = inside[heads]
            ends = inside.copy()
            ends[:-1] &= ~inside[1:]
            tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            ends[tails] = inside[tails]
            self.start = np.flatnonzero(begins)
            self.end = np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        if len(self.start):
            value = np.where(inside, _BYTE_VALUE[self.buf], np.uint64(0))
            value *= _power_table(_BASE, len(buf))
            total = np.add.reduceat(value, self.start)
            total *= _power_table(_INVERSE, len(buf))[self.start]
            self.hash = mix64(total + (self.end - self.start).astype(np.uint64))
            for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
                self.hash[i] = int.from_bytes(blake2b(self.buf[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def strings(self, which: np.ndarray) -> list[str]:
        """Words at the given positions, as strings."""
        raw = self.buf.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]


_PLACE = mix64(np.arange(1, 65, dtype=np.uint64))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of each run of ``k`` words, in order, repeats kept.

    A row with fewer words, but not none, has its whole sequence as one shingle.
    """
    h, first = words.hash, words.first
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    row = np.repeat(np.arange(len(count)), n)
    at = first[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    total = np.zeros(len(row), np.uint64)
    size = np.minimum(count, k)[row]
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        part = mix64(padded[at + j] ^ _PLACE[j])
        total += part if j == 0 else np.where(j < size, part, np.uint64(0))
    return row, mix64(total + size.astype(np.uint64))


def distinct_pairs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted by row, then value. ``row`` must be ascending."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def sorted_union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct values of both, ascending (sorting beats numpy's hashing here)."""
    both = np.sort(np.concatenate([a, b]))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    return both[new]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
