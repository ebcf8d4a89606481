"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte is removed if a string of ``length`` bytes covers it that lies in its document and also starts in a document
with a smaller doc_id. Strings are judged on the input; overlaps count; matches never cross documents.

Sorting every suffix of the corpus would move many times its size. So suffixes are chosen by their content: of the
grams in each ``length``-byte window, the one with the least hash is the window's anchor (windowed minimisers). Equal
windows have equal anchors, so only windows whose anchor occurs elsewhere can repeat, and the choice loses nothing.

1. Chunks (``chunks``) send 32 bits of each distinct anchor; buckets answer which occur in other chunks.
2. Of those, chunks send the bytes of each distinct run of windows with one anchor. Buckets sort all their suffixes by
   merge sort with hash comparisons (``suffix_sort``), confirm equal ones byte by byte, and answer a bit a window:
   whether an earlier chunk, so a smaller doc_id, has it.
3. Repeats within a chunk are found there in the same way: the chunk's own records of recurring anchors are sorted.

Defined results: a null text is empty; a document shorter than ``length`` loses nothing; a document without doc_id
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
from archweave.llm.suffix_sort import Suffixes
from archweave.ship import ship_package

LENGTH = 50
#: Records whose suffixes are sorted at once, and anchors that a bucket should hold.
_SORTED, _BUCKET = 1 << 13, 500_000
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, n_bytes: long>>, kept binary, kept_sha256 string"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("n_bytes", pa.int64())]))


def _gram(length: int) -> int:
    return length // 2


@dataclass
class _Runs:
    """Runs of windows with one anchor: the first window's start, how many windows, and the anchor's hash."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray


def _runs(table: pa.Table, data: np.ndarray, offsets: np.ndarray, length: int) -> _Runs:
    gram = _gram(length)
    many = length - gram + 1
    skip = table["doc_id"].is_null().to_numpy(zero_copy_only=False)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for row, stop in bt.blocks(offsets):
        base = int(offsets[row])
        block = data[base : offsets[stop]]
        if len(block) < length:
            continue
        hashes = bt.mix(bt.roll(block.astype(np.uint64) + np.uint64(1), gram, bt.ROLL_A))
        least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
        wide = 1
        while wide * 2 <= many:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < many:
            least = np.minimum(least[: -(many - wide)], least[many - wide :])
        edge = np.zeros(len(block) + 1, np.int8)
        begin, n = offsets[row:stop] - base, np.diff(offsets[row : stop + 1])
        begin, n = begin[fit := (n >= length) & ~skip[row:stop]], n[fit]
        edge[begin] += 1
        edge[begin + n - length + 1] -= 1
        at = np.flatnonzero(np.cumsum(edge[: len(least)], dtype=np.int8))
        if not len(at):
            continue
        anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        # Anchors have small hashes; mixed again, they spread over all buckets.
        parts.append((at[first] + base, np.diff(np.append(first, len(at))), bt.mix(hashes[anchor[first]])))
    if not parts:
        none = np.zeros(0, np.int64)
        return _Runs(none, none, np.zeros(0, np.uint64))
    return _Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _first_message(length: int, plan: ch.Layout):
    def f(chunk: int, table: pa.Table) -> pa.Table:
        runs = _runs(table, *bt.column_bytes(table["text"]), length)
        short = np.unique(ch.short_keys(runs.anchor, plan))
        return ch.packed(chunk, plan, short, np.dtype("<u4"), by=short << np.uint64(64 - 32 - plan.buckets.bit_length() + 1))

    return f


def _records(data: np.ndarray, runs: _Runs, hit: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct records of the runs in ``hit``, in order of anchor: one row each of the window count and the bytes.

    Also the run each is taken from, and the record of each run.
    """
    width = 2 * length - _gram(length)
    start, count = runs.start[hit], runs.count[hit]
    rows = np.zeros((len(hit), width + 1), np.uint8)
    rows[:, 0] = count
    for at in range(0, len(hit), 1 << 14):
        here = slice(at, at + (1 << 14))
        column = np.arange(width)
        index = np.minimum(start[here, None] + column, len(data) - 1)
        rows[here, 1:] = np.where(column < (count[here] + length - 1)[:, None], data[index], 0)
    _, first, inverse = np.unique(rows.view(f"V{width + 1}").ravel(), return_index=True, return_inverse=True)
    order = np.argsort(runs.anchor[hit][first], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return rows[first[order]], hit[first[order]], place[inverse.ravel()]


def _second_message(length: int, plan: ch.Layout):
    def f(chunk: int, table: pa.Table, told: pa.Table) -> pa.Table:
        data, offsets = bt.column_bytes(table["text"])
        runs = _runs(table, data, offsets, length)
        hit = np.flatnonzero(ch.among(ch.short_keys(runs.anchor, plan), ch.answered_keys(told, plan, "<u4")))
        if not len(hit):
            return ch.no_message()
        rows, source, _ = _records(data, runs, hit, length)
        return ch.packed(chunk, plan, ch.short_keys(runs.anchor[source], plan), np.dtype("<u4"), extra=rows, by=runs.anchor[source])

    return f


def _earliest(rows: np.ndarray, key: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """Of distinct records, their anchors, and where each is first: for each window, where any record has it first.

    A record whose anchor has no other record shares windows with its own copies only. The suffixes of all others are
    sorted, some thousand records at a time, since anchors don't share windows.
    """
    most = length - _gram(length) + 1
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(order)))
    earliest = np.repeat(least[:, None], most, axis=1)
    several = order[np.repeat(size > 1, size)]
    cuts = np.concatenate(([0], np.cumsum(size[size > 1])))
    done = 0
    while done < len(several):
        stop = int(cuts[max(np.searchsorted(cuts, done + _SORTED, side="right") - 1, np.searchsorted(cuts, done) + 1)])
        some = several[done:stop]
        records = rows[some]
        count = records[:, 0].astype(np.int64)
        record = np.repeat(np.arange(len(some)), count)
        offset = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
        place, number = Suffixes(np.ascontiguousarray(records[:, 1:]), length).classes(record, offset)
        lowest = np.minimum.reduceat(least[some][record[place]], np.flatnonzero(np.diff(number, prepend=-1)))
        earliest[some[record[place]], offset[place]] = lowest[number]
        done = stop
    return earliest


def _sort_suffixes(length: int):
    """Bucket side of the second round."""
    width = 2 * length - _gram(length)
    most = length - _gram(length) + 1

    def f(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, chunk, table = ch.unpacked(table, np.dtype("<u4"))
        rows = np.frombuffer(b"".join(table["extra"].to_pylist()), np.uint8).reshape(-1, width + 1)
        _, first, inverse = np.unique(rows.view(f"V{width + 1}").ravel(), return_index=True, return_inverse=True)
        inverse = inverse.ravel()
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, chunk)
        earliest = _earliest(rows[first], keys[first], least, length)
        mask = np.zeros(len(rows), np.uint64)
        for i in range(most):
            seen = (earliest[:, i][inverse] < chunk) & (i < rows[:, 0])
            mask |= seen.astype(np.uint64) << np.uint64(i)
        return ch.answers(bucket, chunk, (mask << np.uint64(32)) | keys, np.dtype("<u8"))

    return f


def _in_chunk(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, runs: _Runs, length: int) -> np.ndarray:
    """Starts of windows that a document with a smaller doc_id in the chunk has too; rows are in order of doc_id."""
    _, of, times = np.unique(runs.anchor, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[of.ravel()] > 1) if len(runs.anchor) else np.zeros(0, np.int64)
    if not len(hit):
        return hit
    row = np.searchsorted(offsets, runs.start[hit], side="right") - 1
    rows, source, record = _records(data, runs, hit, length)
    least = np.full(len(rows), np.iinfo(np.int32).max, np.int32)
    np.minimum.at(least, record, row.astype(np.int32))
    earliest = _earliest(rows, runs.anchor[source], least, length)
    found = []
    for i in range(earliest.shape[1]):
        here = (i < runs.count[hit]) & (ids[earliest[record, i]] < ids[row])
        found.append(runs.start[hit[here]] + i)
    return np.concatenate(found)


def _finish(length: int, plan: ch.Layout):
    def f(chunk: int, table: pa.Table, told: pa.Table) -> pa.Table:
        data, offsets = bt.column_bytes(table["text"])
        runs = _runs(table, data, offsets, length)
        ids = table["doc_id"].fill_null(0).to_numpy()
        starts = [_in_chunk(data, offsets, ids, runs, length)]
        if told.num_rows:
            told = told.sort_by("bucket")
            told_bucket = np.repeat(told["bucket"].to_numpy(), [len(b) // 8 for b in told["answer"].to_pylist()])
            values = np.frombuffer(b"".join(told["answer"].to_pylist()), np.dtype("<u8"))
            known = np.unique((values & np.uint64(0xFFFFFFFF)) | (told_bucket.astype(np.uint64) << np.uint64(32)))
            hit = np.flatnonzero(ch.among(ch.short_keys(runs.anchor, plan), known))
            _, _, record = _records(data, runs, hit, length)
            mask = (values >> np.uint64(32))[record]
            for i in range(length - _gram(length) + 1):
                seen = hit[(mask >> np.uint64(i)) & np.uint64(1) == 1]
                starts.append(runs.start[seen] + i)
        row, start, end = bt.row_intervals(offsets, np.unique(np.concatenate(starts)), length)
        cuts: list[list[tuple[int, int]]] = [[] for _ in range(table.num_rows)]
        for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
            cuts[r].append((s, e))
        raw = data.tobytes()
        kept, digest = [], []
        for r, own in enumerate(cuts):
            at, pieces = int(offsets[r]), []
            for s, e in own:
                pieces.append(raw[at:s])
                at = e
            pieces.append(raw[at : offsets[r + 1]])
            kept.append(b"".join(pieces))
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                "n_removed": pa.array([sum(e - s for s, e in own) for own in cuts], pa.int64()),
                "n_spans": pa.array([len(own) for own in cuts], pa.int64()),
                "spans": pa.array([[{"start": s - int(offsets[r]), "n_bytes": e - s} for s, e in own] for r, own in enumerate(cuts)], _SPAN),
                "kept": pa.array(kept, pa.binary()),
                "kept_sha256": pa.array(digest, pa.string()),
            }
        )

    return f


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, plan: ch.Layout | None = None) -> DataFrame:
    """Per document: bytes, removed bytes, the maximal removed spans, the remaining bytes and their SHA-256."""
    if not 4 <= length <= 62:
        raise ValueError("length: 4 to 62 bytes, so that a run's windows fit the answer's bits")
    ship_package(docs.sparkSession)
    plan = plan or ch.layout(docs, keys_per_byte=2 / (length - _gram(length) + 2), bucket_keys=_BUCKET)
    texts = ch.dealt(docs, plan)
    maybe = ch.compare(ch.send(texts, _first_message(length, plan)), ch.shared_keys("<u4", earlier=False))
    surely = ch.compare(ch.receive(texts, maybe, _second_message(length, plan), ch.MESSAGE), _sort_suffixes(length))
    return ch.receive(texts, surely, _finish(length, plan), SCHEMA)
