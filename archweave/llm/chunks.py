"""Rounds of messages between document chunks and hash buckets.

Operators that compare all windows of all documents share this plan. Documents are dealt into *chunks* by ranges of
doc_id that hold about the same bytes of text; rows of one doc_id stay together, rows without one are dealt by their text. A chunk sends each bucket the distinct keys it holds, packed into one row; so a
key with a third of all occurrences costs one entry a chunk. A *bucket* compares the keys of all chunks and answers
each chunk. As the chunks are ranges of doc_id, "a smaller doc_id" is "an earlier chunk" between chunks, and no ids
need travel. Chunks meet answers in a cogroup; the exchange of the texts is one and the same for all rounds.

Sizes follow the input: the number of chunks and of buckets grows with the bytes. What one task holds grows with their
fourth root only (8 MB of text a chunk up to 64 GB, about 50 MB at 100 TB), so that messages don't get too small.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archweave.lineage import cut

CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 2_000_000
#: Bytes of input up to which chunks don't grow; bounds that the plan itself may hold.
GROWS_FROM, LITERALS = 1 << 36, 4096

MESSAGE = "bucket long, chunk long, n long, keys binary, extra binary"
ANSWER = "bucket long, chunk long, answer binary"
_MESSAGE = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])
_ANSWER = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("answer", pa.binary())])


@dataclass(frozen=True)
class Layout:
    """bounds: the first doc_id of each chunk but the first. buckets: a power of two. loose: further chunks, of rows without doc_id."""

    bounds: tuple[int, ...]
    buckets: int
    loose: int = 1

    @property
    def shift(self) -> np.uint64:
        return np.uint64(64 - self.buckets.bit_length() + 1)

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).astype(np.int64) if self.buckets > 1 else np.zeros(len(keys), np.int64)


def _pieces_of(step: float):
    """Pieces of about ``step`` bytes of a sorted partition: (id that it begins with, bytes before it), and at last (null, all bytes)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, last, at = 0, None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            before = done + np.cumsum(n) - n
            new = np.concatenate(([last is None or ids[0] != last], ids[1:] != ids[:-1]))
            first, before = ids[new], before[new]
            place = (before // step).astype(np.int64)
            moved = np.diff(place, prepend=at) > 0
            done, last, at = done + int(n.sum()), ids[-1], int(place[-1]) if len(place) else at
            yield pa.record_batch([pa.array(first[moved], pa.int64()), pa.array(before[moved], pa.int64())], names=["bound", "before"])
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([done], pa.int64())], names=["bound", "before"])

    return f


def _joined(pieces: pa.Table, size: float) -> tuple[int, ...]:
    """Where chunks of up to ``size`` bytes begin, each of as many pieces as fit, over all partitions in their order."""
    bounds, held, open_ = [], 0, None
    for bound, before in zip(pieces["bound"].to_pylist(), pieces["before"].to_pylist(), strict=True):
        if open_ is not None:
            begin, n = open_[0], before - open_[1]
            if held and held + n > size:
                bounds.append(begin)
                held = 0
            held += n
        open_ = None if bound is None else (bound, before)
    return tuple(bounds)


def layout(docs: DataFrame, keys_per_byte: float, chunk_bytes: int | None = None, bucket_keys: int = BUCKET_KEYS) -> Layout:
    """From the bytes of each text: documents are sorted by id without their texts, and cut where bytes add up.

    A chunk has twice the aimed bytes at most, or those of one doc_id. The driver holds some numbers a chunk.
    """
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    slim = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n")))
    size = slim.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("loose")).first()
    n_bytes = size["n"] or 0
    aim = chunk_bytes or CHUNK_BYTES * max(1.0, (n_bytes / GROWS_FROM) ** 0.25)
    chunks = max(1, min(max(math.ceil(n_bytes / aim), tasks), n_bytes >> 14))
    buckets = 1 << max(0, math.ceil(math.log2(max(1.0, n_bytes * keys_per_byte / bucket_keys, min(tasks, chunks)))))
    loose = max(1, math.ceil((size["loose"] or 0) * chunks / max(1, n_bytes)))
    if chunks == 1:
        return Layout((), buckets, loose)
    size = n_bytes / chunks
    pieces = slim.where("doc_id is not null").orderBy("doc_id").mapInArrow(_pieces_of(size / 4), "bound long, before long").toArrow()
    return Layout(_joined(pieces, size), buckets, loose)


def _search(table: Column, n: Column, wanted: Column, most: int) -> Column:
    """Binary search: how many of the table's n sorted entries are up to ``wanted``."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) <= wanted), at + step).otherwise(at)).cast("long")


def with_chunk(docs: DataFrame, bounds: tuple[int, ...], loose: int = 1, most: int = LITERALS) -> DataFrame:
    """(chunk, doc_id, text): the number of bounds up to doc_id; without a doc_id one of the ``loose`` last, by the text's hash.

    Bounds stand in the plan while they are few. More are a table of blocks, 8 bytes a bound, which is broadcast; the
    plan has the first bound of each block only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spread = F.pmod(F.xxhash64("text"), F.lit(loose)) + len(bounds) + 1
    pick = lambda c: F.when(F.col("doc_id").isNull(), spread).otherwise(c)
    if not bounds:
        return rows.select(pick(F.lit(0)).cast("long").alias("chunk"), "doc_id", "text")
    if len(bounds) <= most:
        return rows.select(pick(_search(F.lit(list(bounds)), F.lit(len(bounds)), F.col("doc_id"), len(bounds))).alias("chunk"), "doc_id", "text")
    step = max(most, math.isqrt(len(bounds)))
    blocks = [list(bounds[i : i + step]) for i in range(0, len(bounds), step)]
    table = docs.sparkSession.createDataFrame(list(enumerate(blocks, 1)), "block long, inner array<long>")
    heads = [b[0] for b in blocks]
    placed = rows.withColumn("block", _search(F.lit(heads), F.lit(len(heads)), F.coalesce("doc_id", F.lit(heads[0])), len(heads))).join(F.broadcast(table), "block", "left")
    inside = _search(F.col("inner"), F.size("inner"), F.col("doc_id"), step)
    return placed.select(pick(F.when(F.col("block") == 0, 0).otherwise((F.col("block") - 1) * step + inside)).cast("long").alias("chunk"), "doc_id", "text")


def dealt(docs: DataFrame, plan: Layout) -> DataFrame:
    return with_chunk(docs, plan.bounds, plan.loose)


def in_order(table: pa.Table) -> pa.Table:
    """A chunk's rows by doc_id, nulls last; ties by text, so that retries agree."""
    if table.num_rows < 2:
        return table
    ids = table["doc_id"].to_numpy(zero_copy_only=False) if not table["doc_id"].null_count else None
    if ids is not None:
        order = np.argsort(ids, kind="stable")
        if (np.diff(ids[order]) > 0).all():
            return table.take(pa.array(order))
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _pieces(of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Where each run of equal values begins, and the runs."""
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    return cuts, list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=False))


def packed(chunk: int, plan: Layout, keys: np.ndarray, width: np.dtype, extra: np.ndarray | None = None, by: np.ndarray | None = None) -> pa.Table:
    """Message rows of sorted keys, cut by bucket. by: what the bucket is taken from, sorted, if not the keys."""
    by = keys if by is None else by
    bucket = plan.bucket_of(by)
    cuts, pieces = _pieces(bucket)
    return pa.table(
        {
            "bucket": pa.array(bucket[cuts], pa.int64()),
            "chunk": pa.array(np.full(len(cuts), chunk), pa.int64()),
            "n": pa.array([e - s for s, e in pieces], pa.int64()),
            "keys": pa.array([keys[s:e].astype(width).tobytes() for s, e in pieces], pa.binary()),
            "extra": pa.array([extra[s:e].tobytes() if extra is not None else b"" for s, e in pieces], pa.binary()),
        },
        schema=_MESSAGE,
    )


def no_message() -> pa.Table:
    return _MESSAGE.empty_table()


def unpacked(table: pa.Table, width: np.dtype) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """All keys of a bucket with the chunk of each, in order of chunk; and the messages in that order."""
    table = table.sort_by("chunk")
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), dtype=width)
    return keys, np.repeat(table["chunk"].to_numpy(), table["n"].to_numpy()), table


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of the keys, and the place in it of each key's first entry."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, bool)
    return order, np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)


def answers(bucket: int, chunk: np.ndarray, values: np.ndarray, width: np.dtype) -> pa.Table:
    """One row for each chunk of the sorted ``chunk``, with its values."""
    cuts, pieces = _pieces(chunk)
    return pa.table(
        {
            "bucket": pa.array(np.full(len(cuts), bucket), pa.int64()),
            "chunk": pa.array(chunk[cuts], pa.int64()),
            "answer": pa.array([values[s:e].astype(width).tobytes() for s, e in pieces], pa.binary()),
        },
        schema=_ANSWER,
    )


def shared_keys(width: str, earlier: bool) -> Callable[[pa.Table], pa.Table]:
    """Bucket side: tells each chunk which of its keys an earlier chunk has too, or any other chunk."""

    def answer(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, chunk, _ = unpacked(table, np.dtype(width))
        order, leader = groups(keys)
        place = np.arange(len(keys))
        hit = np.zeros(len(keys), bool)
        later = leader != place
        hit[order[later]] = True
        if not earlier:
            hit[order[leader[later]]] = True
        return answers(bucket, chunk[hit], keys[hit], np.dtype(width))

    return answer


def answered_keys(table: pa.Table, plan: Layout, width: str) -> np.ndarray:
    """Chunk side: the answered keys, each put together again with the bits of its bucket, sorted."""
    found = []
    bits = np.dtype(width).itemsize * 8
    for bucket, blob in zip(table["bucket"].to_pylist(), table["answer"].to_pylist(), strict=True):
        keys = np.frombuffer(blob, dtype=np.dtype(width)).astype(np.uint64)
        found.append(keys | np.uint64(bucket << bits) if bits < 64 else keys)
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def short_keys(keys: np.ndarray, plan: Layout) -> np.ndarray:
    """Bucket and the next 32 bits of each hash: what a first round sends, four bytes each."""
    kept = np.uint64(32)
    if plan.buckets == 1:
        return keys >> kept
    rest = np.uint64(plan.buckets.bit_length() - 1)
    return keys >> (kept - rest) if rest < kept else keys


def send(texts: DataFrame, f: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    """Round begins: each chunk's messages."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return f(key[0].as_py(), in_order(table))

    return texts.groupBy("chunk").applyInArrow(run, MESSAGE)


def compare(messages: DataFrame, f: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """In the buckets."""
    return messages.groupBy("bucket").applyInArrow(f, ANSWER)


def receive(texts: DataFrame, answer: DataFrame, f: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Chunks with what the buckets answered."""

    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        return f(key[0].as_py(), in_order(table), told)

    return texts.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInArrow(run, schema)


def concat(tables: Iterable[pa.Table], empty: pa.Schema) -> pa.Table:
    tables = list(tables)
    return pa.concat_tables(tables) if tables else empty.empty_table()
