"""Language-model scores: stupid backoff over bigrams of the whole corpus, each document left out of its own counts.

    S(w | v) = c(v w) / c(v) if c(v w) > 0, else BACKOFF * c(w) / N, or BACKOFF / N where c(w) is 0

with counts over all documents but the scored one (so that a document can't vouch for itself), and N their words, 1 at
least. A document's first word has only the lower order. score is the sum of natural logarithms over its words.

Relationally: every chunk of documents (``chunks``) holds a table (n-gram, count); buckets, which partition the n-grams
by hash, sum the counts of all chunks and join them back, one number for each n-gram a chunk has sent, in the order in
which it sent them. A chunk joins the totals to its documents' n-grams and sums by document. A frequent n-gram is one
entry a chunk, however often it occurs.

n-grams are told apart by their bucket and 48 more bits of a hash: with ``BUCKET_KEYS`` entries a bucket, the chance
that an n-gram shares its key is about one in a hundred million, at any size of the corpus.

Words are lower-cased (A-Z) runs of anything but ASCII white space.

Defined results: a null text has no words and score 0; repeated rows are documents of their own (each counts for the
others); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.llm import bytetext as bt
from archweave.llm import chunks as ch
from archweave.ship import ship_package

BACKOFF = 0.4
SCHEMA = "doc_id long, n_words long, n_backoff long, score double"
_KEY = np.dtype([("low", "<u4"), ("high", "<u2")])


def _spare(plan: ch.Layout) -> np.uint64:
    return np.uint64(max(0, 16 - plan.buckets.bit_length() + 1))


def _keys(hashes: np.ndarray, plan: ch.Layout) -> np.ndarray:
    """The bits of the bucket and 48 more."""
    return hashes >> _spare(plan)


class _Grams:
    """Unigrams and bigrams of a chunk: the key of each, the row it is in, and the chunk's table (key, count)."""

    def __init__(self, table: pa.Table, plan: ch.Layout):
        data, offsets = bt.column_bytes(table["text"])
        self.words = bt.all_words(bt.LOWER[data] if len(data) else data, offsets, bt.SPACED)
        self.row = np.repeat(np.arange(table.num_rows), self.words.count())
        one = self.words.hash
        two = bt.mix(one[:-1] * bt.ROLL_A + one[1:]) if len(one) else one
        self.first = np.zeros(len(one), bool)
        begins = self.words.first[:-1]
        self.first[begins[self.words.count() > 0]] = True
        # Place of each word, and of each word with the one before it (none for first words).
        inner = ~self.first
        self.keys, inverse, count = np.unique(_keys(np.concatenate((bt.mix(one + np.uint64(1)), two[inner[1:]])) if len(one) else one, plan), return_inverse=True, return_counts=True)
        inverse = inverse.ravel()
        self.uni = inverse[: len(one)]
        self.bi = np.full(len(one), -1, np.int64)
        self.bi[inner] = inverse[len(one) :]
        self.count = count


def _message(plan: ch.Layout):
    def f(chunk: int, table: pa.Table) -> pa.Table:
        g = _Grams(table, plan)
        packed = np.empty(len(g.keys), _KEY)
        packed["low"], packed["high"] = g.keys & np.uint64(0xFFFFFFFF), (g.keys >> np.uint64(32)) & np.uint64(0xFFFF)
        return ch.packed(chunk, plan, packed, _KEY, extra=g.count.astype("<u4"), by=g.keys << _spare(plan))

    return f


def _totals(table: pa.Table) -> pa.Table:
    bucket = table["bucket"][0].as_py()
    packed, chunk, table = ch.unpacked(table, _KEY)
    keys = packed["low"].astype(np.uint64) | (packed["high"].astype(np.uint64) << np.uint64(32))
    counts = np.frombuffer(b"".join(table["extra"].to_pylist()), "<u4")
    order, leader = ch.groups(keys)
    begins = np.flatnonzero(leader == np.arange(len(order)))
    total = np.empty(len(keys), np.int64)
    sums = np.add.reduceat(counts[order].astype(np.int64), begins)
    total[order] = np.repeat(sums, np.diff(np.append(begins, len(order))))
    return ch.answers(bucket, chunk, total, np.dtype("<i8"))


def _score(plan: ch.Layout, words: int):
    def f(chunk: int, table: pa.Table, told: pa.Table) -> pa.Table:
        g = _Grams(table, plan)
        told = told.sort_by("bucket")
        total = np.frombuffer(b"".join(told["answer"].to_pylist()), "<i8")
        # What the document itself has of each n-gram: occurrences of (row, key).
        def own(place: np.ndarray, row: np.ndarray) -> np.ndarray:
            _, inverse, n = np.unique(row * np.int64(len(g.keys)) + place, return_inverse=True, return_counts=True)
            return n[inverse.ravel()]

        counts = g.words.count()
        inner = np.flatnonzero(~g.first)
        others = np.maximum(words - counts, 1)[g.row].astype(np.float64)
        own_uni = own(g.uni, g.row)
        c_word = total[g.uni] - own_uni if len(g.uni) else np.zeros(0, np.int64)
        p = BACKOFF * np.maximum(c_word, 1) / others
        backed = np.ones(len(g.uni), bool)
        if len(inner):
            own_bi = own(g.bi[inner], g.row[inner])
            c_bi = total[g.bi[inner]] - own_bi
            # c(v) is the count of the word before.
            c_before = c_word[inner - 1]
            seen = c_bi > 0
            p[inner[seen]] = c_bi[seen] / c_before[seen]
            backed[inner[seen]] = False
        edge = g.words.first
        log = np.log(p)
        score = np.array([log[a:b].sum() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], np.float64)
        missed = np.concatenate(([0], np.cumsum(backed)))
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(counts, pa.int64()), "n_backoff": pa.array(missed[edge[1:]] - missed[edge[:-1]], pa.int64()), "score": pa.array(score)})

    return f


def stupid_backoff(docs: DataFrame, plan: ch.Layout | None = None) -> DataFrame:
    """(doc_id, n_words, n_backoff, score): n_backoff counts words scored by the lower order."""
    ship_package(docs.sparkSession)
    plan = plan or ch.layout(docs, keys_per_byte=1 / 5)
    texts = ch.dealt(docs, plan)
    trimmed = F.trim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    words = texts.agg(F.sum(F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit(r"[\x20\x09-\x0D]+")) + 1))).first()[0] or 0
    totals = ch.compare(ch.send(texts, _message(plan)), _totals)
    return ch.receive(texts, totals, _score(plan, words), SCHEMA)
