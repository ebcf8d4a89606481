"""All pairs of texts whose sets of word shingles have a Jaccard similarity of ``least`` or more, joined to components.

Near copies (``near_copies``) are looked for by operator 10 first: SimHash fingerprints of the same shingles, and pairs
within its three bits from its vantage-point tree (``simhash.neighbours``), a forest; texts of one fingerprint meet the
one of least key. These pairs are confirmed on the whole sets. Three bits don't reach all pairs of that similarity, and a
forest's pair may be refused where another one would not, so the join below looks for the rest: pairs that the tree has
not joined already.

Texts are lower-cased (A-Z) and split at ASCII white space; each run of ``shingle`` words is a shingle, a 64-bit hash;
fewer words make one; none make the empty set, which is like no other than itself. A key of 64 bits stands for the word
sequence, so exact copies are one node.

Candidates: with shingles in one order for all texts, two sets of that similarity share a shingle among the first
n - ceil(least * n) + 1 of each (n: size of the set). So each text sends only these, and no pair is lost. The order puts
shingles that are common in a bounded sample of texts last; it decides only how many candidates there are, not the
result. Lengths, and the places of the shared shingle, rule out more of them. The rest is confirmed on the whole sets.

Pairs are not listed in groups of copies: first each member of a group is compared with the least one; then only
members of a group that are not yet in one component, pair by pair.

Shingle sets are as large as the texts and don't compress, so none is kept: prefixes are made while texts are read, and
whole sets once more for the texts of candidate pairs only. Before that, a sketch of each set (how many shingles fall
into each of 256 bins) bounds what two sets can share from above, and rules out most pairs that share little else.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.components import components
from archweave.lineage import cut
from archweave.llm import bytetext as bt
from archweave.llm import simhash
from archweave.ship import ship_package

SHINGLE, LEAST = 5, 0.8
#: Texts that the order of shingles is fitted on, about, and the common shingles it knows, at most.
SAMPLE, COMMON = 4_096, 1 << 18
#: Shingles that a bucket should hold.
_BUCKET = 1 << 18
#: Bins of a sketch.
_BINS = 256
#: Candidate pairs that a bucket compares at once.
_BLOCK = 1 << 20
#: Shared shingles of a text that tell where its pairs were seen before.
_HEADS = 16
#: Pairs of sketches that are compared at once.
_ROWS = 1 << 14
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """The text's key, and its distinct shingles as signed longs, sorted."""
    words = text.lower().split()
    key = xxhash.xxh64_intdigest(b" ".join(words))
    if not words:
        return key, np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIERS[i % len(_MULTIPLIERS)] + hashes[i : len(words) - width + 1 + i]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MULTIPLIERS[0]
    return key, np.unique((mixed ^ (mixed >> np.uint64(29))).view(np.int64))


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tag, key, hashes): tag is the MD5 of the text, key that of its words."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bt.column_bytes(batch.column(2))
            raw = data.tobytes()
            found = [shingles(raw[s:e], shingle) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            ends = np.cumsum([0, *(len(h) for _, h in found)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([h for _, h in found]) if found else np.zeros(0, np.int64)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.array([k for k, _ in found], np.uint64).view(np.int64)), sets], names=["doc_id", "tag", "key", "hashes"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag().alias("tag"), text.alias("text")).mapInArrow(run, "doc_id long, tag string, key long, hashes array<long>")


def tag():
    """Tells rows of one doc_id apart; null texts from empty ones too."""
    return F.coalesce(F.md5(F.col("text").cast("string")), F.lit(""))


def needed(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Shingles that sets of sizes a and b share at that similarity, at least."""
    return np.ceil((a + b) * (least / (1 + least)) - 1e-6).astype(np.int64)


def _sizes(sets: DataFrame) -> tuple[int, int]:
    size = sets.agg(F.count("*").alias("n"), F.sum(F.size("hashes")).alias("shingles")).first()
    return size["n"], size["shingles"] or 0


def prefixes(sets: DataFrame, some: DataFrame, shingles_: int, least: float = LEAST, bucket: int = _BUCKET) -> DataFrame:
    """(bucket, h, key, n, at): of each set its first shingles in the common order, with their places, packed by bucket.

    some: sets that the order is fitted on. h is the shingle's lower 32 bits: which bucket it is in tells more, and two
    shingles that share both only make a candidate that isn't confirmed.
    """
    buckets = max(math.ceil((1 - least) * shingles_ / bucket), 4 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    common = some.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    known, times = common["h"].to_numpy(), common["n"].to_numpy()
    order = np.argsort(known)
    held = sets.sparkSession.sparkContext.broadcast((known[order], times[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = held.value
        for batch in batches:
            column = batch.column(1)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            rank = np.zeros(len(flat), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                rank = np.where(known[place] == flat, times[place], 0)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            out_h, out_key, out_n, out_at = [], [], [], []
            for key, s, e in zip(keys.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = e - s
                if not n:
                    continue
                first = n - int(np.ceil(least * n - 1e-6)) + 1
                chosen = np.lexsort((flat[s:e], rank[s:e]))[:first] if rank[s:e].any() else np.arange(first)
                out_h.append(flat[s:e][chosen])
                out_key.append(np.full(first, key))
                out_n.append(np.full(first, n, np.int32))
                out_at.append(np.arange(first, dtype=np.int32))
            if out_h:
                h, key, n, at = map(np.concatenate, (out_h, out_key, out_n, out_at))
                to = (h.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                to = to[order].astype(np.int64)
                starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                offsets = pa.array(np.r_[starts, len(to)].astype(np.int32))
                yield pa.record_batch([pa.array(to[starts]), *(pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (h.astype(np.int32), key, n, at))], names=["bucket", "h", "key", "n", "at"])

    return sets.select("key", "hashes").mapInArrow(run, _PACKED)


_PACKED = "bucket long, h array<int>, key array<long>, n array<int>, at array<int>"


def shared(packed: DataFrame) -> DataFrame:
    """As ``prefixes``, one row a bucket, of the shingles that two keys or more have sent, once a key."""

    def run(table: pa.Table) -> pa.Table:
        h, key, n, at = (table[c].combine_chunks().flatten().to_numpy() for c in ("h", "key", "n", "at"))
        order = np.lexsort((key, h))
        same_h = h[order][1:] == h[order][:-1]
        order = order[np.r_[True, ~(same_h & (key[order][1:] == key[order][:-1]))]]
        same_h = h[order][1:] == h[order][:-1]
        order = order[np.r_[False, same_h] | np.r_[same_h, False]]
        ends = pa.array(np.array([0, len(order)], np.int32))
        return pa.table({"bucket": table["bucket"][:1], **{c: pa.ListArray.from_arrays(ends, pa.array(x[order])) for c, x in (("h", h), ("key", key), ("n", n), ("at", at))}})

    return packed.groupBy("bucket").applyInArrow(run, _PACKED)


def _pairs(h, key, n, at, root, star: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of rows that share h: with the group's least key (star), or all that are of different roots."""
    order = np.lexsort((key, h))
    h, key, n, at, root = h[order], key[order], n[order].astype(np.int64), at[order].astype(np.int64), root[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
    h, key, n, at, root = h[new], key[new], n[new], at[new], root[new]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.r_[starts, len(h)])
    group = np.repeat(np.arange(len(starts)), size)
    last = (starts + size)[group]

    def fit(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.minimum(at[i], at[j]) + 1 + np.minimum(n[i] - at[i] - 1, n[j] - at[j] - 1)
        good = (most >= needed(n[i], n[j], least)) & (star | (root[i] != root[j]))
        return key[i[good]], key[j[good]]

    if star:
        j = np.flatnonzero(np.arange(len(h)) != starts[group])
        yield fit(starts[group[j]], j)
        return
    if not len(h):
        return
    mixed = np.flatnonzero((np.maximum.reduceat(root, starts) != np.minimum.reduceat(root, starts))[group])
    if not len(mixed):
        return
    follow = last[mixed] - mixed - 1
    parts = np.flatnonzero(np.r_[True, np.diff(np.cumsum(follow) // _BLOCK) > 0])
    for a, b in zip(parts, [*parts[1:], len(mixed)], strict=True):
        i = np.repeat(mixed[a:b], follow[a:b])
        step = np.arange(len(i)) - np.repeat(np.cumsum(follow[a:b]) - follow[a:b], follow[a:b])
        yield fit(i, i + 1 + step)


def _found(columns, star: bool, least: float, fits: Callable[[np.ndarray], np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Distinct pairs; ``fits`` tells which of an array of them to keep, block by block, so that no more than these are held."""
    found = np.zeros((0, 2), np.int64)
    for u, v in _pairs(*columns, star, least):
        pairs = np.unique(np.c_[u, v], axis=0)
        if fits is not None:
            pairs = pairs[fits(pairs)]
        found = np.unique(np.r_[found, pairs], axis=0)
    return {"u": found[:, 0], "v": found[:, 1]}


def _room(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of sketches leave room for that similarity."""
    return np.minimum(a, b).sum(axis=1, dtype=np.int64) >= needed(a.sum(axis=1, dtype=np.int64), b.sum(axis=1, dtype=np.int64), least)


def _sketched(table: pa.Table, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Which pairs of keys to tell of: their sketches leave room for that similarity (a key without one leaves room for
    any), and no earlier bucket tells of them, as far as the first shingles that they share tell."""
    known, first = np.unique(table["key"].to_numpy(), return_index=True)
    bucket = table["bucket"][0].as_py() if table.num_rows else 0
    heads = np.full((2, len(known), _HEADS), -1, np.int64)
    heads[1] = -2
    for i, own in enumerate(table["heads"].take(pa.array(first)).to_pylist()):
        own = [x for x in own if x >> 32 < bucket]
        heads[:, i, : len(own)] = own
    held = table["sketch"].take(pa.array(first))
    open_ = held.is_null().to_numpy()
    bins = np.frombuffer(b"".join(x or bytes(_BINS) for x in held.to_pylist()), np.uint8).reshape(-1, _BINS)

    def fits(pairs: np.ndarray) -> np.ndarray:
        u, v = np.searchsorted(known, pairs[:, 0]), np.searchsorted(known, pairs[:, 1])
        keep = open_[u] | open_[v]
        for at in range(0, len(u), _ROWS):
            part = slice(at, at + _ROWS)
            keep[part] |= _room(bins[u[part]], bins[v[part]], least)
            keep[part] &= ~(heads[0, u[part], :, None] == heads[1, v[part], None, :]).any(axis=(1, 2))
        return keep

    return fits


def star_candidates(sent: DataFrame, least: float = LEAST) -> DataFrame:
    """``shared`` -> distinct pairs (u, v) of keys: each with the least key that has the shingle too. Map-only up to distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("h", "key", "n", "at")]
                found = _found([*columns, columns[1]], True, least)
                yield pa.record_batch([pa.array(found["u"]), pa.array(found["v"])], names=["u", "v"])

    return sent.mapInArrow(run, "u long, v long").distinct()


def rest_candidates(sent: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """``shared``, known (key, root, sketch) -> distinct pairs (u, v) of keys that have different roots and sketches that leave room.

    Sketches travel with the keys, once for each shingle that a text shares, so that pairs that they rule out, which are
    nearly all, never leave the bucket that finds them. So do the first few shared shingles, by bucket: a pair that has
    one of an earlier bucket in common is told of there, once, and not here again.
    """
    each = sent.select("bucket", F.explode(F.arrays_zip("h", "key", "n", "at")).alias("x")).select("bucket", "x.*")
    code = F.shiftleft("bucket", 32) + F.col("h").bitwiseAND(F.lit((1 << 32) - 1))
    heads = each.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(code)), 1, _HEADS).alias("heads"))
    told = known.join(heads, "key").select("key", "root", "sketch", "heads")

    def run(table: pa.Table) -> pa.Table:
        columns = [table[c].to_numpy() for c in ("h", "key", "n", "at", "root")]
        return pa.table(_found(columns, False, least, _sketched(table, least)))

    return each.join(told, "key").groupBy("bucket").applyInArrow(run, "u long, v long").distinct()


def confirmed(pairs: DataFrame, chosen: Callable[[DataFrame], DataFrame], least: float = LEAST) -> DataFrame:
    """Those pairs whose whole sets are that similar. chosen: (key) -> (key, hashes) of these keys."""
    pairs = cut(pairs)
    asked = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    held = chosen(asked).groupBy("key").agg(F.first("hashes").alias("hashes"))
    both = pairs.join(held.select(F.col("key").alias("u"), F.col("hashes").alias("a")), "u").join(held.select(F.col("key").alias("v"), F.col("hashes").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, a_at), (b, b_at) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
            good = []
            for i in range(batch.num_rows):
                x, y = a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]
                same = len(np.intersect1d(x, y, assume_unique=True))
                good.append(same >= least * (len(x) + len(y) - same) - 1e-6)
            keep = pa.array(good, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def sketch(hashes: np.ndarray) -> bytes | None:
    """How many shingles fall into each bin; None if some count is beyond a byte."""
    counts = np.bincount((hashes.view(np.uint64) >> np.uint64(40)).astype(np.int64) % _BINS, minlength=_BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def sketches(sets: DataFrame) -> DataFrame:
    """(key, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            yield pa.record_batch([batch.column(0), pa.array([sketch(flat[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["key", "sketch"])

    return sets.select("key", "hashes").mapInArrow(run, "key long, sketch binary")


def possible(pairs: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of different roots whose sketches leave room for that similarity; known (key, root, sketch), a key once.
    Without a sketch a pair stays."""
    side = lambda end, name: known.select(F.col("key").alias(end), F.col("root").alias(f"{end}_root"), F.col("sketch").alias(name))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").where("u_root <> v_root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = bytes([255]) * _BINS
        for batch in batches:
            a, b = (np.frombuffer(b"".join(x or full for x in batch.column(c).to_pylist()), np.uint8).reshape(-1, _BINS) for c in (2, 3))
            keep = pa.array(_room(a, b, least) | batch.column(2).is_null().to_numpy(zero_copy_only=False) | batch.column(3).is_null().to_numpy(zero_copy_only=False))
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def tree_pairs(prints: DataFrame) -> DataFrame:
    """prints (key, fp), a key once -> pairs (u, v) of keys within three bits, from operator 10's vantage-point tree."""
    first = cut(prints.groupBy("fp").agg(F.min("key").alias("key"), F.count("*").alias("n")))
    end = lambda name: first.select(F.col("fp").alias(f"{name}_fp"), F.col("key").alias(name))
    near = simhash.neighbours(first.select("fp")).withColumnsRenamed({"u": "u_fp", "v": "v_fp"}).join(end("u"), "u_fp").join(end("v"), "v_fp")
    same = prints.join(first.where("n > 1").select("fp", F.col("key").alias("u")), "fp").where("key <> u")
    return near.select("u", "v").union(same.select("u", F.col("key").alias("v"))).distinct()


def _rooted(known: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, root, sketch) of known (key, sketch) and roots (node, root); keys without a root are their own."""
    return known.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"), "sketch")


def _linked(sent: DataFrame, known: DataFrame, chosen: Callable[[DataFrame], DataFrame], least: float, near: DataFrame | None = None) -> DataFrame:
    """near: pairs to confirm before those of ``sent``, which aren't looked for among what they join."""
    own = known.select("key", F.col("key").alias("root"), "sketch")
    links = None
    if near is not None:
        links = cut(confirmed(possible(near, own, least), chosen, least))
        own = _rooted(known, cut(components(links)))
    stars = cut(confirmed(possible(star_candidates(sent, least), own, least), chosen, least))
    links = stars if links is None else links.union(stars)
    of = cut(components(links))
    rest = cut(confirmed(rest_candidates(sent, _rooted(known, of), least), chosen, least))
    return of if rest.isEmpty() else components(links.union(rest))


def similar(sets: DataFrame, least: float = LEAST, sample: int = SAMPLE, bucket: int = _BUCKET) -> DataFrame:
    """sets (key, hashes) -> (node, root) of every key that is similar to another; root is the component's least key."""
    n, total = _sizes(sets)
    some = sets.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // sample))) == 0)
    sent = cut(shared(prefixes(sets, some, total, least, bucket)))
    return _linked(sent, sketches(sets.dropDuplicates(["key"])), lambda asked: sets.select("key", "hashes").join(asked, "key", "left_semi"), least)


def _keys(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, tag, key, n, sketch, fp) of each row: n shingles; fp is operator 10's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bt.column_bytes(batch.column(2))
            raw = data.tobytes()
            found = [shingles(raw[s:e], shingle) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            keys = np.array([k for k, _ in found], np.uint64).view(np.int64)
            prints = np.array([simhash.fingerprint(raw[s:e], shingle) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys), pa.array([len(h) for _, h in found], pa.int64()), pa.array([sketch(h) for _, h in found], pa.binary()), pa.array(prints.view(np.int64))], names=["doc_id", "tag", "key", "n", "sketch", "fp"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag().alias("tag"), text.alias("text")).mapInArrow(run, "doc_id long, tag string, key long, n long, sketch binary, fp long")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(doc_id, tag) of the rows of a component that don't have its smallest (doc_id, tag); rows without doc_id stay.
    Pairs are operator 10's, within three bits and confirmed, and all others of that similarity."""
    ship_package(docs.sparkSession)
    keyed = cut(_keys(docs, shingle))
    size = keyed.agg(F.count("*").alias("n"), F.sum("n").alias("shingles")).first()
    rows = keyed.where("doc_id is not null").select("doc_id", "tag", "key", "sketch", "fp")
    own = cut(rows.groupBy("key").agg(F.min(F.struct("doc_id", "tag", "sketch", "fp")).alias("first")))
    known, prints = own.select("key", "first.sketch"), own.select("key", "first.fp")
    own = own.select("key", F.struct("first.doc_id", "first.tag").alias("first"))
    rows = rows.drop("sketch", "fp").distinct()
    texts = docs.where("doc_id is not null").withColumn("_tag", tag())
    some = shingle_sets(texts.where(F.pmod(F.xxhash64("_tag"), F.lit(max(1, size["n"] // SAMPLE))) == 0), shingle)
    sent = cut(shared(prefixes(shingle_sets(texts, shingle), some, size["shingles"] or 0, least)))

    def chosen(asked: DataFrame) -> DataFrame:
        """The sets of these keys, from the texts of their first rows."""
        first = own.join(asked, "key", "left_semi").select(F.col("first.doc_id").alias("_doc"), F.col("first.tag").alias("_tag"))
        of = texts.withColumn("_doc", F.col("doc_id").cast("long")).join(first, ["_doc", "_tag"], "left_semi")
        return shingle_sets(of, shingle).select("key", "hashes")

    linked = cut(_linked(sent, known, chosen, least, tree_pairs(prints)).join(own, F.col("node") == F.col("key")).select("key", "root", "first"))
    best = linked.groupBy("root").agg(F.min("first").alias("keeper"))
    keepers = cut(own.join(linked.join(best, "root").select("key", "keeper"), "key", "left").select("key", F.coalesce("keeper", "first").alias("keeper")))
    return rows.join(keepers, "key").where(F.struct("doc_id", "tag") != F.col("keeper")).select("doc_id", "tag").distinct()
