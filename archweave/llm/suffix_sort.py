"""Hash-compared suffix sort: merge sort whose comparisons find common extensions by binary search on prefix hashes."""

from __future__ import annotations

import numpy as np

_BASE = 0xD1342543DE82EF95


class Suffixes:
    """Suffixes of many short byte records, given as (record, offset), compared on their first ``limit`` bytes.

    ``bytes`` has one record a row, padded; every suffix asked for has at least ``limit`` bytes in its row.
    """

    def __init__(self, records: np.ndarray, limit: int):
        self.bytes, self.limit = records, limit
        width = records.shape[1]
        scale, inverse = [1], [1]
        for _ in range(width):
            scale.append(scale[-1] * _BASE % (1 << 64))
            inverse.append(inverse[-1] * pow(_BASE, -1, 1 << 64) % (1 << 64))
        self.inverse = np.array(inverse, dtype=np.uint64)
        self.prefix = np.zeros((len(records), width + 1), np.uint64)
        np.cumsum((records.astype(np.uint64) + np.uint64(1)) * np.array(scale[:width], np.uint64), axis=1, out=self.prefix[:, 1:])

    def _same(self, r: np.ndarray, i: np.ndarray, s: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        one = (self.prefix[r, i + n] - self.prefix[r, i]) * self.inverse[i]
        two = (self.prefix[s, j + n] - self.prefix[s, j]) * self.inverse[j]
        return one == two

    def common(self, r: np.ndarray, i: np.ndarray, s: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension, up to ``limit``, in log2(limit) hash comparisons."""
        low = np.zeros(len(r), np.int64)
        high = np.full(len(r), self.limit, np.int64)
        for _ in range(self.limit.bit_length()):
            middle = (low + high + 1) >> 1
            same = self._same(r, i, s, j, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def before(self, r: np.ndarray, i: np.ndarray, s: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the first suffix is smaller, and whether both are the same."""
        n = self.common(r, i, s, j)
        same = n >= self.limit
        n = np.where(same, 0, n)
        return ~same & (self.bytes[r, i + n] < self.bytes[s, j + n]), same

    def order(self, record: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Stable sorted order of the suffixes.

        Their first eight bytes, as numbers, part them into groups; inside each, runs of doubling length are merged,
        all groups at once: an element's new place is its place in its run plus its rank in the sibling run.
        """
        head = np.zeros(len(record), np.uint64)
        for b in range(min(8, self.limit)):
            head = (head << np.uint64(8)) | self.bytes[record, offset + b]
        order = np.argsort(head, kind="stable")
        if len(order) < 2:
            return order
        ordered = head[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.append(firsts, len(order)))
        begin, size = np.repeat(firsts, sizes), np.repeat(sizes, sizes)
        run = 1
        while len(at := np.flatnonzero(size > run)):
            start = begin[at]
            place = at - start
            own = place // run
            sibling = start + (own ^ 1) * run
            end = np.minimum(sibling + run, start + size[at])
            paired = sibling < end
            at, start, place, own, sibling, end = (x[paired] for x in (at, start, place, own, sibling, end))
            me = order[at]
            low, high = sibling.copy(), end.copy()
            right = (own & 1).astype(bool)
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) >> 1
                other = order[middle]
                less, same = self.before(record[other], offset[other], record[me[open_]], offset[me[open_]])
                goes = less | (same & right[open_])
                low[open_] = np.where(goes, middle + 1, low[open_])
                high[open_] = np.where(goes, high[open_], middle)
            target = start + (own >> 1) * 2 * run + (place - own * run) + (low - sibling)
            order[target] = me
            run *= 2
        return order

    def classes(self, record: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted order, and the number of the class of each place in it; equal hashes are confirmed byte by byte."""
        order = self.order(record, offset)
        r, i = record[order], offset[order]
        same = self.common(r[1:], i[1:], r[:-1], i[:-1]) >= self.limit
        span = np.arange(self.limit)
        for at in range(0, len(same), 1 << 16):
            hit = at + np.flatnonzero(same[at : at + (1 << 16)])
            a = self.bytes[r[hit + 1, None], i[hit + 1, None] + span]
            b = self.bytes[r[hit, None], i[hit, None] + span]
            same[hit] = (a == b).all(axis=1)
        return order, np.concatenate(([0], np.cumsum(~same))) if len(order) else np.zeros(0, np.int64)
