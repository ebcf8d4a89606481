"""Periodic runs of words, found in a grammar of each text.

A *run* is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring
word extends, and that holds ``repeats`` periods and ``words`` words at least.

Each text's word ids are compressed by Re-Pair: a pair of neighbouring symbols that recurs in the text gets a
nonterminal, the more frequent of two overlapping pairs first, until no pair recurs. What is left, the start rule, is made
binary by pairing neighbours level by level. A run lies across the boundary of the lowest node of the derivation tree
that holds it; so it is enough to compute, for each nonterminal *once*, the runs across the boundary of its two parts,
cut at its ends, and to carry them to every position that the nonterminal derives. Runs cut at a node's ends are parts
of runs of nodes above; merging intervals of one period leaves the maximal ones. Highly periodic texts, which have most
runs, have few nonterminals.

Across a boundary, each period is tried that leaves room (as in the merge step of Main and Lorentz): on one side of the
boundary lies half of the run, so two neighbouring words and then prefix hashes of that half rule out nearly every
period; hashes and binary search find how far the others reach, and the words themselves confirm each run. A period
that is a multiple of the smallest gives the same interval and is dropped.

Texts are independent: one pass, nothing is shuffled. Blocks of about 1 MB, one text at least, are worked on at a time
with numpy; a text of n words takes about 200 n bytes of a task's memory.

Defined results: a null text has no words and no runs, its collapsed text is empty; each input row gives one output row;
ties and repeated rows are judged alike; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archweave.llm import bytetext as bt
from archweave.ship import ship_package

WORDS, REPEATS = 6, 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_PRIMES, _BASES = (np.uint64(2147483647), np.uint64(2147483629)), (np.uint64(1103515245), np.uint64(69069069))
_PAIRS = 1 << 21


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An id for each word, equal for equal words, and each row's first word (n + 1 numbers)."""
    words = bt.spans(data, offsets, bt.SPACED, hashed=False)
    held = data[bt.SPACED[data] > 0]
    ends = np.zeros(len(words.start) + 1, np.int64)
    np.cumsum(words.end - words.start, out=ends[1:])
    column = pa.Array.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(held))])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64), words.first


@dataclass
class Grammar:
    """Nonterminals by number: text position of the first derivation, of the second part in it, and of the end.

    of, at: all derivations, as number of the nonterminal and text position. left, right, row: the symbols of the start
    rules as text intervals.
    """

    first: np.ndarray
    mid: np.ndarray
    end: np.ndarray
    of: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    row: np.ndarray


def _alternate(symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of overlapping pairs of one symbol, as in a a a, every other one."""
    n = len(symbol) - 1
    equal = (symbol[1:] == symbol[:-1]) & (row[1:] == row[:-1])
    begin = np.maximum.accumulate(np.where(equal & ~np.concatenate(([False], equal[:-1])), np.arange(n), 0))
    return ~equal | ((np.arange(n) - begin) % 2 == 0)


def repair(ids: np.ndarray, first_word: np.ndarray) -> Grammar:
    """Re-Pair of each row by itself, all rows of a block at a time.

    A round counts the pairs of each row, and replaces those occurrences that overlap no occurrence of a more frequent pair
    (ties by a hash). Pairs seen once can't recur later unless one of their symbols is new, so they aren't counted again;
    rows without a recurring pair are done.
    """
    rows = len(first_word) - 1
    symbol, at = ids.copy(), np.arange(len(ids))
    row = np.repeat(np.arange(rows), np.diff(first_word))
    end = at + 1
    live = np.ones(len(ids), bool)
    next_symbol = int(ids.max()) + 1 if len(ids) else 0
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    made: list[tuple[np.ndarray, ...]] = []
    n_rules = 0
    while len(symbol) > 1:
        n = len(symbol) - 1
        pair = live[:n] & (row[1:] == row[:-1])
        counted = np.flatnonzero(pair & _alternate(symbol, row))
        size = next_symbol
        key = (row[counted] * size + symbol[counted]) * size + symbol[counted + 1]
        known, which, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[which] >= 2
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((bt.mix(known.astype(np.uint64)), count))] = np.arange(1, len(known) + 1)
        priority = np.zeros(n + 2, np.int64)
        priority[counted[again] + 1] = rank[which[again]]
        here = priority[1:-1]
        taken = (here[counted] > 0) & (here[counted] > priority[counted]) & (here[counted] > priority[counted + 2])
        rules, of = np.unique(which[taken], return_inverse=True)
        twice = np.bincount(of, minlength=len(rules)) >= 2 if len(rules) else np.zeros(0, bool)
        where = counted[taken][twice[of]] if len(rules) else counted[:0]
        active = np.zeros(rows, bool)
        active[row[where]] = True
        if len(where):
            number = np.cumsum(twice) - 1
            of = number[of[twice[of]]]
            begin = np.zeros(int(twice.sum()), np.int64)
            begin[of[::-1]] = where[::-1]
            made.append((at[begin], at[begin + 1], end[begin + 1], of + n_rules, at[where]))
            # Pairs that recur, or with a new symbol, stay live.
            fresh = np.zeros(n + 1, bool)
            fresh[where] = True
            still = pair.copy()
            still[counted] = again
            symbol[where] = next_symbol + of
            end[where] = end[where + 1]
            gone = np.zeros(n + 1, bool)
            gone[where + 1] = True
            live = np.append(still, False)
            stay = ~gone
            symbol, at, end, row, live, fresh = (x[stay] for x in (symbol, at, end, row, live, fresh))
            live |= fresh
            live[:-1] |= fresh[1:]
            next_symbol += len(begin)
            n_rules += len(begin)
        over = ~active[row]
        done.append((at[over], end[over], row[over]))
        symbol, at, end, row, live = (x[~over] for x in (symbol, at, end, row, live))
    done.append((at, end, row))
    left, right, of_row = (np.concatenate([d[i] for d in done]) for i in range(3))
    order = np.argsort(left, kind="stable")
    none = np.zeros(0, np.int64)
    return Grammar(*(np.concatenate([m[i] for m in made]) if made else none for i in range(5)), left[order], right[order], of_row[order])


def start_nodes(g: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The start rules made binary: begin, boundary and end of every node."""
    left, right, row = g.left, g.right, g.row
    found = []
    while len(left) > 1:
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        nth = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
        head = (nth % 2 == 0) & np.append(row[1:] == row[:-1], False)
        at = np.flatnonzero(head)
        if not len(at):
            break
        found.append((left[at], left[at + 1], right[at + 1]))
        right = right.copy()
        right[at] = right[at + 1]
        stay = nth % 2 == 0
        left, right, row = left[stay], right[stay], row[stay]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([f[i] for f in found]) if found else none for i in range(3))


class _Stretches:
    """Equality of stretches of a block by prefix hashes modulo two primes."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            power = np.ones(1, np.uint64)
            step = base
            while len(power) < len(ids) + 1:
                power = np.concatenate((power, power * step % prime))
                step = step * step % prime
            power = power[: len(ids) + 1]
            total = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(bt.mix(ids.astype(np.uint64) + np.uint64(1)) % prime * power[:-1] % prime, out=total[1:])
            self.sums.append(total)
            self.powers.append(power)

    def shifted(self, at: np.ndarray, length: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Which stretches equal those ``shift`` words on."""
        same = np.ones(len(at), bool)
        for total, power, prime in zip(self.sums, self.powers, _PRIMES, strict=True):
            one = (total[at + length] - total[at]) % prime * power[shift] % prime
            same &= one == (total[at + shift + length] - total[at + shift]) % prime
        return same

    def reach(self, at: np.ndarray, most: np.ndarray, shift: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``at`` on, or before it, equal those ``shift`` on; ``most`` at most."""
        got = np.zeros(len(at), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            tried = got + step
            fits = np.flatnonzero(tried <= most)
            start = at[fits] - tried[fits] if back else at[fits]
            ok = fits[self.shifted(start, tried[fits], shift[fits])]
            got[ok] += step
            step >>= 1
        return got


def _confirmed(ids: np.ndarray, low: int, high: int, start: int, end: int, q: int) -> tuple[int, int]:
    """The run of period q, by its words."""
    if np.array_equal(ids[start : end - q], ids[start + q : end]):
        return start, end
    off = np.flatnonzero(ids[low : high - q] != ids[low + q : high]) + low  # a collision of both hashes: the stretch around its middle
    at = int(np.searchsorted(off, (start + end - q) // 2))
    return (int(off[at - 1]) + 1 if at else low), (int(off[at]) + q if at < len(off) else high)


def crossing_runs(ids: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray, words: int, repeats: int) -> tuple[np.ndarray, ...]:
    """Runs across each node's boundary, cut at its ends: node, start, end, period. Each period that leaves room is tried."""
    large = np.flatnonzero(high - low >= max(words, repeats))
    stretches = _Stretches(ids) if len(large) else None
    found = []
    for left in (True, False):
        # Half of a run, at least, lies on one side: half(q) = ceil(repeats * q / 2) words, more than q.
        room = mid[large] - low[large] if left else high[large] - mid[large]
        most = np.minimum(2 * room // repeats, (high[large] - low[large]) // repeats)
        upto = np.cumsum(most)
        node, done = 0, 0
        while done < (int(upto[-1]) if len(upto) else 0):
            until = min(done + _PAIRS, int(upto[-1]))
            last = int(np.searchsorted(upto, until, side="left"))
            nodes = np.arange(node, last + 1)
            begin = np.maximum(upto[nodes] - most[nodes], done)
            count = np.minimum(upto[nodes], until) - begin
            rep = np.repeat(nodes, count)
            q = np.arange(done, until) - (upto - most)[rep] + 1
            m = mid[large[rep]]
            shift = -q if left else q
            ok = np.flatnonzero(ids[m - 1] == ids[m - 1 + shift])
            ok = ok[ids[m[ok]] == ids[(m + shift)[ok]]]
            rep, q, m = rep[ok], q[ok], m[ok]
            half = (repeats * q + 1) // 2
            ok = stretches.shifted(m - half if left else m, half - q, q)
            rep, q, m = large[rep[ok]], q[ok], m[ok]
            if len(rep):
                at = m - q if left else m
                ahead = stretches.reach(at, high[rep] - q - at, q, back=False)
                behind = stretches.reach(at, at - low[rep], q, back=True)
                start, end = at - behind, at + ahead + q
                ok = (end - start >= np.maximum(words, repeats * q)) & (start < m) & (end > m)
                found.append((rep[ok], start[ok], end[ok], q[ok]))
            node, done = last, until
    none = np.zeros(0, np.int64)
    node, start, end, q = (np.concatenate([f[i] for f in found]) if found else none for i in range(4))
    order = np.lexsort((q, end, start, node))  # multiples of a period give its interval again
    node, start, end, q = node[order], start[order], end[order], q[order]
    new = (np.diff(node, prepend=-1) != 0) | (np.diff(start, prepend=-1) != 0) | (np.diff(end, prepend=-1) != 0)
    node, start, end, q = node[new], start[new], end[new], q[new]
    for i in range(len(node)):
        start[i], end[i] = _confirmed(ids, int(low[node[i]]), int(high[node[i]]), int(start[i]), int(end[i]), int(q[i]))
    ok = (end - start >= np.maximum(words, repeats * q)) & (start < mid[node]) & (end > mid[node])
    return node[ok], start[ok], end[ok], q[ok]


def maximal(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that share as many words are one run; of equal intervals the smallest period stays. By start, then period."""
    if not len(start):
        return start, end, q
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    group = np.cumsum(np.diff(q, prepend=q[0]) != 0) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + group)
    new = np.concatenate(([True], (group[1:] != group[:-1]) | ((start + q + group)[1:] > reach[:-1])))
    begins = np.flatnonzero(new)
    start, end, q = start[begins], np.maximum.reduceat(end, begins), q[begins]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    keep = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))
    start, end, q = start[keep], end[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def runs_of(ids: np.ndarray, first_word: np.ndarray, words: int = WORDS, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of a block's texts, by positions in the block: start, end, period."""
    g = repair(ids, first_word)
    n_rules = len(g.first)
    left, boundary, right = start_nodes(g)
    low, mid, high = (np.concatenate(x) for x in ((g.first, left), (g.mid, boundary), (g.end, right)))
    node, start, end, q = crossing_runs(ids, low, mid, high, words, repeats)
    of_rule = node < n_rules
    # Runs of nonterminals go to all positions that these derive.
    order = np.argsort(g.of, kind="stable")
    begins = np.searchsorted(g.of[order], np.arange(n_rules + 1))
    of, s, e, p = node[of_rule], start[of_rule], end[of_rule], q[of_rule]
    times = (begins[1:] - begins[:-1])[of] if n_rules else np.zeros(0, np.int64)
    each = np.repeat(np.arange(len(of)), times)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
    move = g.at[order[begins[of[each]] + nth]] - g.first[of[each]] if len(each) else each
    return maximal(*(np.concatenate(x) for x in ((start[~of_rule], s[each] + move), (end[~of_rule], e[each] + move), (q[~of_rule], p[each]))))


def _block(text: pa.Array, words: int, repeats: int) -> tuple[list[int], list[list[dict]], list[bytes]]:
    data, offsets = bt.column_bytes(text)
    counts: list[int] = []
    runs: list[list[dict]] = []
    texts: list[bytes] = []
    for row, stop in bt.blocks(offsets):
        held = data[offsets[row] : offsets[stop]]
        at = offsets[row : stop + 1] - offsets[row]
        ids, first = word_ids(held, at)
        start, end, q = runs_of(ids, first, words, repeats)
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, start + q, 1)
        np.add.at(edge, end, -1)
        kept = np.cumsum(edge[:-1]) == 0
        of = np.searchsorted(first, start, side="right") - 1
        begins = np.searchsorted(of, np.arange(stop - row + 1))
        raw = held.tobytes()
        for r in range(stop - row):
            split = raw[at[r] : at[r + 1]].split()
            counts.append(len(split))
            mine = slice(begins[r], begins[r + 1])
            shifted = (start[mine] - first[r]).tolist()
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in zip(shifted, (end - start)[mine].tolist(), q[mine].tolist(), strict=True)])
            if shifted:
                split = [split[i] for i in np.flatnonzero(kept[first[r] : first[r + 1]])]
            texts.append(b" ".join(split))
    return counts, runs, texts


def find_runs(docs: DataFrame, words: int = WORDS, repeats: int = REPEATS) -> DataFrame:
    """Per row of (doc_id, text): its number of words, its runs by start and period, and the text without repeats.

    A word goes from the collapsed text if any run holds it after that run's first period; the rest is joined by one space.
    """
    if repeats < 3:
        raise ValueError("repeats: 3 at least, so that half of a run is longer than its period")
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = _block(batch.column(1), words, repeats)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed_text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def longest(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equals the first by start, then period; null if there is none."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda best, run: F.when(better(best, run), run).otherwise(best))


def listed(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    return F.concat(F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where one text of ten repeats a stretch of its words to its end.

    By h = crc32 of the decimal doc_id and g = h div 10: if 10 divides h, a text of n words keeps those before
    a = g mod n, and repeats its next p = 1 + (n - a) div (3 + g mod 8) words from there on. Documents without doc_id stay.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        word = lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = F.element_at(F.transform(F.array(words), repeated), 1)
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(planted, F.col("text"))).otherwise(F.col("text")).alias("text"))
