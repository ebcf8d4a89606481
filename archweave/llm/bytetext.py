"""Vectorised views of UTF-8 text columns inside a task: byte buffers, word spans, polynomial hashes.

All offsets are byte offsets. The delimiters in use are ASCII, and no UTF-8 multi-byte sequence contains an
ASCII byte, so splitting bytes is the same as splitting characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd 64-bit multipliers of the polynomial hashes; two give independent hashes.
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
ROLL_A = np.uint64(0xD1342543DE82EF95)
ROLL_B = np.uint64(0xAF251AF3B0F025B5)

_SPACES = b" \t\n\x0b\x0c\r"


def _table(of_word: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[np.frombuffer(of_word, dtype=np.uint8)] = 1
    return table


#: Words that are runs of anything but ASCII white space.
SPACED = _table(bytes(b for b in range(256) if b not in _SPACES))
#: Words that are runs of ASCII letters, digits and anything beyond ASCII.
ALNUM = _table(bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum()))
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end and its n + 1 offsets; a null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of about ``most`` bytes, one row at least, so that work arrays stay in cache."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


@dataclass
class Words:
    """Words of several rows: byte spans, each row's first word in ``first`` (n + 1), and their hashes."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a polynomial hash are usable."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64; kept in the worker up to a bounded length."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 64), base, dtype=np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if len(known) <= 1 << 16:
            _POWERS[int(base)] = known
    return known[:n]


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True) -> Words:
    """The words of each row, by a table of word bytes; a word never crosses rows."""
    n = len(data)
    inside = table[data]
    before = np.empty(n + 1, np.uint8)
    before[0] = 0
    before[1:] = inside
    begins = before[:n].copy()
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = 0
    start = np.flatnonzero(inside > begins)
    after = np.zeros(n, np.uint8)
    if n:
        after[:-1] = inside[1:]
        after[edges - 1] = 0
    end = np.flatnonzero(inside > after) + 1
    first = np.searchsorted(start, offsets)
    return Words(start, end, first, hash_words(data, start, end) if hashed else np.zeros(0, np.uint64))


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    at = np.arange(int(length.sum()), dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    at -= np.repeat(begin, length)
    value = data[np.repeat(start, length) + at].astype(np.uint64)
    value += np.uint64(1)
    value *= powers(WORD_BASE, int(length.max()))[at]
    return mix(np.add.reduceat(value, begin) ^ (length.astype(np.uint64) << np.uint64(56)))


def roll(values: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all runs of k values, by joining runs of doubling length; len(values) - k + 1 of them."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        have, at, out, done, scale = values, 1, None, 0, base
        while True:
            if k & at:
                if out is None:
                    out, done = have, at
                else:  # the runs so far, then a run of `at`
                    m = len(values) - done - at + 1
                    out = out[:m] * scale + have[done : done + m]
                    done += at
            if done == k:
                return out
            m = len(have) - at
            have = have[:m] * scale + have[at : at + m]
            at, scale = at * 2, scale * scale


def gather(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Rows of ``length`` bytes from each start."""
    return data[start[:, None] + np.arange(length)[None, :]]


def covered(n: int, start: np.ndarray, length: int) -> np.ndarray:
    """Which of n positions lie in a window of ``length`` at one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def all_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """``spans`` of any number of rows, block by block."""
    parts = []
    words = 0
    for row, end in blocks(offsets):
        at = offsets[row]
        w = spans(data[at : offsets[end]], offsets[row : end + 1] - at, table)
        parts.append(Words(w.start + at, w.end + at, w.first[:-1] + words, w.hash))
        words += len(w.start)
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(1, np.int64), np.zeros(0, np.uint64))
    return Words(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("start", "end")), np.concatenate([*(p.first for p in parts), [words]]), np.concatenate([p.hash for p in parts]))


def row_intervals(offsets: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals covered by windows at the sorted starts, never across rows: row, start, end."""
    if not len(start):
        return start, start, start
    row = np.searchsorted(offsets, start, side="right") - 1
    new = np.concatenate(([True], (start[1:] > start[:-1] + length) | (row[1:] != row[:-1])))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))
    return row[new], start[new], start[last] + length
