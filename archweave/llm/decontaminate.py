"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``window`` consecutive words of a benchmark item; an item of fewer words, but not none, is one
pattern. Patterns of one length m share a searcher. Its symbols are words, its blocks are pairs of words:

* SHIFT[block hash] is how far the search may move on when a text block ends at the cursor: the least distance of such
  a block from the end of any pattern, m - 1 if no pattern holds it. Most positions are never looked at.
* Where the shift is 0, some pattern's last block may end here. Patterns lie in buckets by the hash of their last
  block, and in a bucket by the hash of their first; those whose first block is that of the m words up to here are
  compared with them, word by word and then byte by byte.

All patterns are places in one buffer of item texts: arrays of numbers, no strings. Equal windows are one pattern.

Many cursors move at once: texts are cut into stretches of window ends, each with its own cursor.

Words: A-Z are lower-cased; a word is a run of ASCII letters, digits and characters beyond ASCII.

Only the patterns are broadcast, in blocks of at most ``BLOCK_BYTES`` of item texts; more items mean more passes over
the documents, not more memory. Nothing is shuffled.

Defined results: a null or wordless text has no words and is clean; items without words match nothing; an item without
item_id marks words but isn't listed or counted; items that share an item_id are one; repeated documents each give a
row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archweave.lineage import cut
from archweave.llm import bytetext as bt
from archweave.ship import ship_package

WINDOW = 10
#: Of item text; its tables take some 25 times as much on the driver while they are made.
BLOCK_BYTES = 8 << 20
#: Window ends that one cursor passes, and those whose buckets are tested at once.
_STRETCH, _TESTED = 64, 1 << 14
_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
SCHEMA = "doc_id long, text string, n_words long, spans array<struct<first_word: long, n_words: long>>, item_ids array<string>"


@dataclass
class Searcher:
    """Tables for patterns of m words."""

    m: int
    shift: np.ndarray  # by the low bits of the block hash
    bucket: np.ndarray  # sorted: half of the last block's hash, then half of the first one's
    first: np.ndarray  # the patterns' first words, in the same order
    item_at: np.ndarray  # where the items of each pattern begin in ``item``
    item: np.ndarray  # item numbers

    def block(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the block that ends at a word."""
        h = words[end]
        if self.m > 1:
            h = words[end - 1] * bt.ROLL_B + h
        return bt.mix(h)

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block & np.uint64(len(self.shift) - 1)).astype(np.int64)

    def bucket_of(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        half = np.uint64(32)
        return (self.block(words, end) >> half << half) | (self.block(words, end - self.m + min(self.m, 2)) >> half)


@dataclass
class Patterns:
    """The words of a block of items, their ids, and a searcher for each length of pattern."""

    words: bt.Words
    data: bytes
    ids: list[str | None]
    searchers: list[Searcher]


def patterns(ids: list[str | None], texts: pa.ChunkedArray, window: int) -> Patterns:
    data, offsets = bt.column_bytes(texts)
    data = bt.LOWER[data] if len(data) else data
    words = bt.all_words(data, offsets, bt.ALNUM)
    known = list(dict.fromkeys(ids))
    number = {x: i for i, x in enumerate(known)}
    code = np.array([number[x] for x in ids], np.int32)
    count = words.count()
    own = np.minimum(count, window)
    found = []
    for m in sorted(set(own[own > 0].tolist())):
        row = np.flatnonzero(own == m)
        n = count[row] - m + 1
        first = np.repeat(words.first[row], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(code[row], n)
        s = Searcher(m, np.full(1 << max(12, (4 * len(first)).bit_length()), max(1, m - 1), np.uint8), first, first, first, of)
        for back in range(max(1, m - 1)):
            np.minimum.at(s.shift, s.slot(s.block(words.hash, first + m - 1 - back)), np.uint8(back))
        # Equal windows: equal in two independent hashes of all words.
        both = np.zeros(len(first), np.dtype([("bucket", "<u8"), ("a", "<u8"), ("b", "<u8")]))
        both["bucket"] = s.bucket_of(words.hash, first + m - 1)
        for i in range(m):
            both["a"], both["b"] = both["a"] * bt.ROLL_A + words.hash[first + i], both["b"] * bt.WORD_BASE + bt.mix(words.hash[first + i].copy())
        order = np.lexsort((of, both["b"], both["a"], both["bucket"]))
        both, of, first = both[order], of[order], first[order]
        new = np.concatenate(([True], both[1:] != both[:-1]))
        again = np.concatenate(([False], ~new[1:] & (of[1:] == of[:-1])))
        s.bucket, s.first, s.item = both["bucket"][new].copy(), first[new].astype(np.int32), of[~again]
        s.item_at = np.append(np.flatnonzero(new[~again]), len(s.item))
        found.append(s)
    return Patterns(words, data.tobytes(), known, found)


def occurrences(p: Patterns, s: Searcher, words: bt.Words, data: bytes) -> Iterator[tuple[int, int]]:
    """(first word, pattern number) of every occurrence; words hold several rows, and none spans two."""
    count = np.maximum(words.count() - s.m + 1, 0)
    stretches = -(-count // _STRETCH)
    row = np.repeat(np.arange(len(count)), stretches)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(stretches) - stretches, stretches)) * _STRETCH
    cursor = words.first[row] + s.m - 1 + at
    stop = np.minimum(cursor + _STRETCH, words.first[row + 1])
    maybe = []
    while len(cursor):
        step = s.shift[s.slot(s.block(words.hash, cursor))].astype(np.int64)
        maybe.append(cursor[step == 0])
        cursor = cursor + np.maximum(step, 1)
        going = cursor < stop
        cursor, stop = cursor[going], stop[going]
    end = np.concatenate(maybe) if maybe else np.zeros(0, np.int64)
    bucket = s.bucket_of(words.hash, end)
    low, high = np.searchsorted(s.bucket, bucket, "left"), np.searchsorted(s.bucket, bucket, "right")
    for a in range(0, len(end), _TESTED):
        n = (high - low)[a : a + _TESTED]
        first = np.repeat(end[a : a + _TESTED] - s.m + 1, n)
        pattern = np.repeat(low[a : a + _TESTED], n) + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        for i in range(s.m):
            same = words.hash[first + i] == p.words.hash[s.first[pattern] + i]
            first, pattern = first[same], pattern[same]
        for f, k in zip(first.tolist(), pattern.tolist(), strict=True):
            q = int(s.first[k])
            if all(data[words.start[f + i] : words.end[f + i]] == p.data[p.words.start[q + i] : p.words.end[q + i]] for i in range(s.m)):
                yield f, k


def _pass(held: Patterns, batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = bt.column_bytes(batch.column("text"))
    n_words = np.zeros(batch.num_rows, np.int64)
    spans = [[(s["first_word"], s["n_words"]) for s in row or []] for row in batch.column("spans").to_pylist()]
    items = [set(row or []) for row in batch.column("item_ids").to_pylist()]
    for row, stop in bt.blocks(offsets):
        base = offsets[row]
        low = bt.LOWER[data[base : offsets[stop]]]
        words = bt.spans(low, offsets[row : stop + 1] - base, bt.ALNUM)
        n_words[row:stop] = words.count()
        raw = low.tobytes()
        for s in held.searchers:
            for first, k in occurrences(held, s, words, raw):
                r = int(np.searchsorted(words.first, first, side="right")) - 1
                spans[row + r].append((first - int(words.first[r]), s.m))
                items[row + r].update(held.ids[i] for i in s.item[s.item_at[k] : s.item_at[k + 1]].tolist())
    out = []
    for own in spans:
        joined: list[list[int]] = []
        for first, n in sorted(own):
            if joined and first <= joined[-1][0] + joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], first + n - joined[-1][0])
            else:
                joined.append([first, n])
        out.append([{"first_word": f, "n_words": n} for f, n in joined])
    return pa.record_batch(
        [batch.column("doc_id"), batch.column("text"), pa.array(n_words), pa.array(out, _SPANS), pa.array([sorted(i for i in own if i is not None) for own in items], pa.list_(pa.string()))],
        names=["doc_id", "text", "n_words", "spans", "item_ids"],
    )


def _broadcasts(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """The patterns of one block of items after the other, and whether it is the last."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") > 0)
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = own.select("item_id", "text").toArrow()
        yield spark.sparkContext.broadcast(patterns(rows["item_id"].to_pylist(), rows["text"], window)), block == blocks - 1


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, the word spans that benchmark windows cover, and the item_ids of those windows (sorted).

    Columns doc_id, text, n_words, spans, item_ids; one row for each row of ``docs``.
    """
    ship_package(docs.sparkSession)
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    state = state.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast("array<struct<first_word: long, n_words: long>>"), "item_ids": F.lit(None).cast("array<string>")})
    for tables, last in _broadcasts(benchmark, window, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _pass(tables.value, batch)

        state = state.mapInArrow(run, SCHEMA)
        if not last:
            state = cut(state)
    return state


def n_hit(spans: str = "spans") -> Column:
    """Words inside any occurrence; the spans of a row don't overlap."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["n_words"])


def _any_hit(held: Patterns, text: pa.Array) -> np.ndarray:
    data, offsets = bt.column_bytes(text)
    hit = np.zeros(len(text), bool)
    for row, stop in bt.blocks(offsets):
        base = offsets[row]
        low = bt.LOWER[data[base : offsets[stop]]]
        words = bt.spans(low, offsets[row : stop + 1] - base, bt.ALNUM)
        raw = low.tobytes()
        for s in held.searchers:
            for first, _ in occurrences(held, s, words, raw):
                hit[row + int(np.searchsorted(words.first, first, side="right")) - 1] = True
    return hit


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark window occurs. Map-only."""
    ship_package(docs.sparkSession)
    for tables, last in _broadcasts(benchmark, window, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(~_any_hit(tables.value, batch.column("text"))))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = cut(docs)
    return docs
