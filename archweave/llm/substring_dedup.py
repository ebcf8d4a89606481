"""Removal of repeated token windows: Rabin-Karp hashes of every window of k words, compared in Spark.

A word is removed if some window of ``k`` consecutive words of its document covers it, and the same word sequence also
starts in a document with a smaller doc_id. Windows are judged on the input. Repeated windows merge into maximal
removal intervals.

Two rounds between chunks and hash buckets (see ``chunks``): the first sends 32 bits (and the bucket) of every window
hash, the second 64 bits of an independent hash for the windows that the first could not rule out. Within a chunk the
first hash is compared in full and confirmed by the second.

Defined results: a null text has no words; a document with fewer than k words loses nothing; a document without doc_id
neither causes nor suffers removal; rows with the same doc_id do not remove from each other; each input row gives one
output row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from archweave.llm import bytetext as bt
from archweave.llm import chunks as ch
from archweave.ship import ship_package

WINDOW = 50
SCHEMA = "doc_id long, n_words long, n_removed long, n_intervals long, removed array<struct<first_word: long, n_words: long>>, kept_text string, kept_sha256 string"
_INTERVAL = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))


@dataclass
class _Windows:
    """All windows of a chunk: the word each starts at, its row, and two hashes."""

    words: bt.Words
    at: np.ndarray
    row: np.ndarray
    one: np.ndarray
    two: np.ndarray


def _windows(table: pa.Table, data: np.ndarray, offsets: np.ndarray, k: int) -> _Windows:
    words = bt.all_words(data, offsets, bt.SPACED)
    count = np.maximum(words.count() - k + 1, 0)
    if table["doc_id"].null_count:
        count[table["doc_id"].is_null().to_numpy(zero_copy_only=False)] = 0
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + words.first[row]
    one, two = (bt.mix(bt.roll(words.hash, k, base))[at] if len(at) else np.zeros(0, np.uint64) for base in (bt.ROLL_A, bt.ROLL_B))
    return _Windows(words, at, row, one, two)


def _first_message(k: int, plan: ch.Layout):
    def f(chunk: int, table: pa.Table) -> pa.Table:
        w = _windows(table, *bt.column_bytes(table["text"]), k)
        short = ch.short_keys(np.unique(w.one), plan)
        short = short[np.diff(short, prepend=short[:1] - np.uint64(1)) != 0] if len(short) else short
        return ch.packed(chunk, plan, short, np.dtype("<u4"), by=short << np.uint64(64 - 32 - plan.buckets.bit_length() + 1))

    return f


def _candidates(w: _Windows, told: pa.Table, plan: ch.Layout) -> np.ndarray:
    return ch.among(ch.short_keys(w.one, plan), ch.answered_keys(told, plan, "<u4"))


def _second_message(k: int, plan: ch.Layout):
    def f(chunk: int, table: pa.Table, told: pa.Table) -> pa.Table:
        w = _windows(table, *bt.column_bytes(table["text"]), k)
        hit = _candidates(w, told, plan)
        one, two = w.one[hit], w.two[hit]
        _, first = np.unique(two, return_index=True)
        one, two = one[first], two[first]
        order = np.argsort(one, kind="stable")
        return ch.packed(chunk, plan, two[order], np.dtype("<u8"), by=one[order])

    return f


def _in_chunk(w: _Windows, ids: np.ndarray) -> np.ndarray:
    """Windows that a document with a smaller doc_id in the same chunk has too; rows are in order of doc_id."""
    order, leader = ch.groups(w.one)
    repeated = np.flatnonzero(leader != np.arange(len(order)))
    here, first = order[repeated], order[leader[repeated]]
    hit = np.zeros(len(order), bool)
    hit[here[(w.two[here] == w.two[first]) & (ids[w.row[here]] > ids[w.row[first]])]] = True
    return hit


def _finish(k: int):
    def f(chunk: int, table: pa.Table, told: pa.Table) -> pa.Table:
        data, offsets = bt.column_bytes(table["text"])
        w = _windows(table, data, offsets, k)
        ids = table["doc_id"].fill_null(0).to_numpy()
        hit = _in_chunk(w, ids)
        hit |= ch.among(w.two, ch.answered_keys(told, None, "<u8"))
        row, start, end = bt.row_intervals(w.words.first, w.at[hit], k)
        out: dict[str, list] = {c: [] for c in ("n_removed", "n_intervals", "removed", "kept_text", "kept_sha256")}
        gone: list[list[tuple[int, int]]] = [[] for _ in range(table.num_rows)]
        base = w.words.first[row]
        for r, first, n in zip(row.tolist(), (start - base).tolist(), (end - start).tolist(), strict=True):
            gone[r].append((first, n))
        raw = data.tobytes()
        for r, cuts in enumerate(gone):
            words = raw[offsets[r] : offsets[r + 1]].split()
            kept, at = [], 0
            for first, n in cuts:
                kept += words[at:first]
                at = first + n
            text = b" ".join(kept + words[at:] if cuts else words)
            out["n_removed"].append(sum(n for _, n in cuts))
            out["n_intervals"].append(len(cuts))
            out["removed"].append([{"first_word": a, "n_words": n} for a, n in cuts])
            out["kept_text"].append(text)
            out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_words": pa.array(w.words.count(), pa.int64()),
                "n_removed": pa.array(out["n_removed"], pa.int64()),
                "n_intervals": pa.array(out["n_intervals"], pa.int64()),
                "removed": pa.array(out["removed"], _INTERVAL),
                "kept_text": pa.array(out["kept_text"], pa.binary()).cast(pa.string()),
                "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
            }
        )

    return f


def remove_repeated_windows(docs: DataFrame, k: int = WINDOW, plan: ch.Layout | None = None) -> DataFrame:
    """Per document: n_words, n_removed, the removed intervals, the kept words joined by one space and their SHA-256."""
    ship_package(docs.sparkSession)
    plan = plan or ch.layout(docs, keys_per_byte=1 / 6)
    texts = ch.dealt(docs, plan)
    maybe = ch.compare(ch.send(texts, _first_message(k, plan)), ch.shared_keys("<u4", earlier=False))
    surely = ch.compare(ch.receive(texts, maybe, _second_message(k, plan), ch.MESSAGE), ch.shared_keys("<u8", earlier=True))
    return ch.receive(texts, surely, _finish(k), SCHEMA)
