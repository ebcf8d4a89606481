"""Quartile bucket digests: short fingerprints of texts whose difference tells how alike the texts are.

In each window of five bytes, six triplets begin with the window's first byte; each is hashed to one of 128 buckets. The
counts' quartiles give each bucket a code: 0 up to the first, 1 up to the second, 2 up to the third, 3 beyond. A
fingerprint is, in hexadecimal, a length code (eight steps for each doubling of the bytes), the first and second
quartile against the third (four bits each) and the 128 codes of two bits. The difference of two fingerprints sums what
their codes differ by (0 against 3 counts double), and what lengths and quartiles differ by; it is bounded by ``MOST``
(texts that have nothing but their language in common differ by about 180 in the test tables), and a likeness is 1 - difference / MOST, from 0 to 1.

``digests`` is map-only. ``edited_digests`` also needs each text's neighbour in descending order of doc_id: documents are
dealt into chunks, ranges of doc_id of about equal bytes (see ``chunks``), which is the only exchange of texts; a chunk
is handed the first text of the next one as a guest, so one text in some thousand travels twice.

Defined results: a null text is as an empty one; texts of fewer than three bytes have no triplets and differ by length
alone; each input row gives one output row; rows of one doc_id are ordered by MD5, descending; rows without doc_id come
last, by chunks of their hash; a lone document is its own neighbour; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.llm import bytetext as bt
from archweave.llm import chunks as ch
from archweave.ship import ship_package

BUCKETS = 128
#: The second and third byte of each triplet, counted from the first.
TRIPLETS = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))
MOST = 300
_SPREAD = np.uint32(0x9E3779B1)
_COST = np.array([0, 1, 2, 6], np.int64)
DIGEST = "doc_id long, n_bytes long, fingerprint string"
EDITED = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each row's triplets fall into each bucket."""
    rows = len(offsets) - 1
    total = np.zeros(rows * BUCKETS + 1, np.int64)
    of = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    wide = data.astype(np.uint32)
    for kind, (j, k) in enumerate(TRIPLETS):
        n = len(data) - k
        if n <= 0:
            continue
        hashed = wide[:n] | (wide[j : j + n] << np.uint32(8))
        hashed |= wide[k:] << np.uint32(16)
        hashed |= np.uint32(kind << 24)
        hashed *= _SPREAD
        hashed ^= hashed >> np.uint32(15)
        hashed *= _SPREAD
        hashed >>= np.uint32(25)
        place = of[:n] * np.int32(BUCKETS)
        place += hashed.view(np.int32)
        place[of[:n] != of[k:]] = rows * BUCKETS
        total += np.bincount(place, minlength=len(total))
    return total[:-1].reshape(rows, BUCKETS)


def encoded(counts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Per row 34 bytes: length code, quartile ratios, bucket codes."""
    ordered = np.sort(counts, axis=1)
    one, two, three = (ordered[:, BUCKETS * i // 4 - 1] for i in (1, 2, 3))
    code = (counts > one[:, None]).astype(np.uint8) + (counts > two[:, None]) + (counts > three[:, None])
    out = np.zeros((len(counts), 2 + BUCKETS // 4), np.uint8)
    out[:, 0] = np.minimum(8 * np.log2(length + 1.0), 255)
    out[:, 1] = 16 * (15 * one // np.maximum(three, 1)) + 15 * two // np.maximum(three, 1)
    for i in range(4):
        out[:, 2:] |= code[:, i::4] << np.uint8(6 - 2 * i)
    return out


def digest_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    parts = []
    for row, stop in bt.blocks(offsets):
        at = offsets[row : stop + 1] - offsets[row]
        parts.append(encoded(bucket_counts(data[offsets[row] : offsets[stop]], at), np.diff(at)))
    return np.concatenate(parts) if parts else np.zeros((0, 2 + BUCKETS // 4), np.uint8)


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of digests row by row, from 0 to MOST."""
    out = np.abs(a[:, 0].astype(np.int64) - b[:, 0])
    for shift in (4, 0):
        out += np.abs((a[:, 1] >> shift & 15).astype(np.int64) - (b[:, 1] >> shift & 15))
    for shift in (6, 4, 2, 0):
        out += _COST[np.abs((a[:, 2:] >> shift & 3).astype(np.int64) - (b[:, 2:] >> shift & 3))].sum(axis=1)
    return np.minimum(out, MOST)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - differences(a, b) / MOST


def likeness_of(a: str, b: str) -> float:
    """Of two fingerprints."""
    one, two = (np.frombuffer(bytes.fromhex(x), np.uint8)[None, :] for x in (a, b))
    return float(likeness(one, two)[0])


def _hex(digests: np.ndarray) -> list[str]:
    text, n = digests.tobytes().hex(), 2 * digests.shape[1]
    return [text[i : i + n] for i in range(0, len(text), n)]


def digests(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): bytes and fingerprint."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bt.column_bytes(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(_hex(digest_bytes(data, offsets)), pa.string())], names=["doc_id", "n_bytes", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)


def _descending(ids: list, texts: list[str]) -> list[int]:
    """An order of rows: by doc_id and then MD5, descending, rows without doc_id last."""
    md5 = lambda i: hashlib.md5(texts[i].encode()).hexdigest()
    return sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, md5(i)), reverse=True)


def _edit(key: tuple, own: pa.Table, guest: pa.Table) -> pa.Table:
    ids = own["doc_id"].to_pylist()
    texts = [t or "" for t in own["text"].to_pylist()]
    order = _descending(ids, texts)
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    if not ids:
        return pa.table({f.name: pa.array([], f.type) for f in _EDITED}, schema=_EDITED)
    follows = guest["text"][0].as_py() or ""
    edited = []
    for text, after in zip(texts, [*texts[1:], follows], strict=True):
        n = len(text) // 3
        edited.append(text[: len(text) - n] + after[:n])
    whole = digest_bytes(*bt.column_bytes(pa.array([*texts, follows], pa.large_string())))
    changed = digest_bytes(*bt.column_bytes(pa.array(edited, pa.large_string())))
    columns = [ids, [len(t) for t in texts], edited, _hex(whole[:-1]), _hex(changed), likeness(whole[:-1], changed), likeness(whole[:-1], whole[1:])]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _EDITED, strict=True)], schema=_EDITED)


_EDITED = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _guests(texts: DataFrame, plan: ch.Layout) -> DataFrame:
    """(chunk, text): for each chunk with rows, the text that follows its last row.

    Chunks in their order hand their first row to the one before. Only each chunk's greatest doc_id is found first, so
    that texts of a few rows a chunk are read.
    """
    spark = texts.sparkSession
    loose = F.col("chunk") > len(plan.bounds)
    # Order of chunks: those with doc_ids from the last to the first, then those without.
    place = F.when(loose, F.col("chunk")).otherwise(len(plan.bounds) - F.col("chunk"))
    heads = ch.cut(texts.groupBy("chunk").agg(F.max("doc_id").alias("head")).withColumn("place", place))
    ring = W.orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follows = heads.select("chunk", "head", F.coalesce(F.lag("chunk").over(W.orderBy("place")), F.last("chunk").over(ring)).alias("to"))
    first = texts.join(F.broadcast(follows), "chunk").where(F.col("doc_id").eqNullSafe(F.col("head")))
    text = F.coalesce("text", F.lit(""))
    return first.groupBy(F.col("to").alias("chunk")).agg(F.max_by(text, F.md5(text)).alias("text"))


def edited_digests(docs: DataFrame, plan: ch.Layout | None = None) -> DataFrame:
    """Per row: its characters, the edited text, both fingerprints, and how alike the fingerprint is to the edited text's and to the next document's.

    The edited text ends, for its last third of characters, with as many first ones of the next document, in
    descending order of doc_id; after the last comes the first.
    """
    ship_package(docs.sparkSession)
    plan = plan or ch.layout(docs, keys_per_byte=1 / 6)
    texts = ch.dealt(docs, plan)
    return texts.groupBy("chunk").cogroup(_guests(texts, plan).groupBy("chunk")).applyInArrow(_edit, EDITED)
