"""SimHash near-duplicates: fingerprints of word shingles, and vantage-point trees that find pairs within few bits.

Fingerprint: texts are lower-cased (A-Z), split at ASCII white space; each run of ``shingle`` words, joined by one
space, repeats included, is hashed by XXH64 (seed 42); a bit is 1 if it is set in over half the hashes. Fewer words
make one shingle; none make fingerprint zero, which links like any other.

Pairs: distinct fingerprints are dealt into shards by a vantage-point tree. A node holds a vantage point v and a
distance m; fingerprints with d(x, v) <= m go to one side, the rest to the other. By the triangle inequality a
fingerprint's partners within r bits lie in the near side only if d - r <= m, and in the far side only if d + r > m; so
each is sent, as a query, to every shard that its ball of radius r overlaps, and no pair is lost. Shards search by a
vantage-point tree of their own and return a forest that joins what they have found linked, not all pairs.

The tree over shards is fitted on a bounded sample (``SAMPLE`` fingerprints, those of least hash); it only decides
which shard holds what, so the result doesn't depend on it.

Defined results: a null text has no words; a null doc_id counts for no component's smallest doc_id (a component of
only such documents has none); repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.components import components
from archweave.lineage import cut
from archweave.llm import bytetext as bt
from archweave.ship import ship_package

SHINGLE, SEED, BITS = 3, 42, 3
#: Fingerprints that the tree over shards is fitted on, at most, and those a shard should hold.
SAMPLE, SHARD = 65_536, 16_384
#: Fingerprint pairs that a shard compares at once.
_BLOCK = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(words) - shingle + 1]
    end = end[shingle - 1 :]
    ones, n = np.zeros(64, np.int64), len(start)
    for at in range(0, n, 1 << 14):
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(start[at : at + (1 << 14)].tolist(), end[at : at + (1 << 14)].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bt.column_bytes(batch.column(1))
            raw = data.tobytes()
            found = np.array([fingerprint(raw[s:e], shingle) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """Of a few points, the one whose distances spread most, and their median; None if nothing parts the points."""
    best = None
    probe = points[:: max(1, len(points) // 512)]
    for v in points[:: max(1, len(points) // 8)][:8]:
        d = _distance(probe, v)
        if best is None or d.var() > best[0]:
            best = (d.var(), v)
    d = _distance(points, best[1])
    m = int(np.median(d))
    if m >= d.max():
        m = int(d.max()) - 1
    return (best[1], m) if d.min() <= m else None


def shard_tree(points: np.ndarray, depth: int) -> list:
    """Nodes (v, m, near, far) in a list, children by index; a leaf is a shard's number."""
    nodes: list = []
    shards = 0

    def build(own: np.ndarray, deep: int) -> int:
        nonlocal shards
        place = len(nodes)
        split = _vantage(own) if deep and len(own) >= 16 else None
        if split is None:
            nodes.append(shards)
            shards += 1
            return place
        v, m = split
        nodes.append(None)
        near = _distance(own, v) <= m
        nodes[place] = (v, m, build(own[near], deep - 1), build(own[~near], deep - 1))
        return place

    build(points, depth)
    return nodes


def overlapped(nodes: list, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards that each point's ball overlaps: point index, shard, whether it is the point's own."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    open_ = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while open_:
        place, index, home = open_.pop()
        if not len(index):
            continue
        node = nodes[place]
        if not isinstance(node, tuple):
            out.append((index, node, home))
            continue
        v, m, near, far = node
        d = _distance(points[index], v)
        to_near, to_far = d - radius <= m, d + radius > m
        open_.append((near, index[to_near], home[to_near] & (d[to_near] <= m)))
        open_.append((far, index[to_far], home[to_far] & (d[to_far] > m)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate([i for i, _, _ in out]), np.concatenate([np.full(len(i), s) for i, s, _ in out]), np.concatenate([h for _, _, h in out])


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of linked nodes; label[x] is x's root before and after."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def joining(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``unite``; gives the linked nodes that joined two trees, which are a forest."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        a, b, high, low = a[apart], b[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        if not len(a):
            return
        order = np.lexsort((low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        label[high[first]] = low[first]
        while (label[label] != label).any():
            label[:] = label[label]
        yield a[first], b[first]


def link(points: np.ndarray, home: np.ndarray, radius: int, forest: list | None = None) -> np.ndarray:
    """Roots of all points after joining each to the home points within the radius; all points ask. ``forest`` is
    filled with pairs within the radius, as indexes, that span what is joined."""
    label = np.arange(len(points))
    open_ = [(np.arange(len(points)), np.flatnonzero(home))]
    while open_:
        ask, held = open_.pop()
        if not len(ask) or not len(held):
            continue
        split = _vantage(points[held]) if len(held) > 64 and len(ask) * len(held) > _BLOCK // 4 else None
        if split is None:
            step = max(1, _BLOCK // len(held))
            for at in range(0, len(ask), step):
                some = ask[at : at + step]
                i, j = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[held][None, :]) <= radius)
                if forest is None:
                    unite(label, some[i], held[j])
                else:
                    forest.extend(joining(label, some[i], held[j]))
            continue
        v, m = split
        d, of = _distance(points[ask], v), _distance(points[held], v)
        open_.append((ask[d - radius <= m], held[of <= m]))
        open_.append((ask[d + radius > m], held[of > m]))
    return label


def _shards(distinct: DataFrame, radius: int, shard: int, sample: int) -> DataFrame:
    """distinct (fp) -> (shard, fp, home): each fingerprint in its own shard (home), and in all that its ball overlaps."""
    ship_package(distinct.sparkSession)
    spark = distinct.sparkSession
    n = distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, n / shard))))
    some = [r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(min(sample, 64 << depth)).collect()] if depth else []
    nodes = spark.sparkContext.broadcast(shard_tree(np.array(some, np.int64).view(np.uint64), depth))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            index, to, home = overlapped(nodes.value, fp.view(np.uint64), radius)
            for at in range(0, len(index), 1 << 16):
                cut_ = slice(at, at + (1 << 16))
                yield pa.record_batch([pa.array(to[cut_], pa.int64()), pa.array(fp[index[cut_]]), pa.array(home[cut_])], names=["shard", "fp", "home"])

    return distinct.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    fp, home = table["fp"].to_numpy(), table["home"].to_numpy()
    order = np.argsort(fp, kind="stable")
    return fp[order], home[order]


def linked(distinct: DataFrame, radius: int = BITS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """distinct (fp) -> (node, root) of every fingerprint that links to another."""

    def search(table: pa.Table) -> pa.Table:
        fp, home = _sorted(table)
        root = link(np.ascontiguousarray(fp).view(np.uint64), home, radius)
        moved = root != np.arange(len(root))
        return pa.table({"u": fp[moved], "v": fp[root[moved]]})

    return components(_shards(distinct, radius, shard, sample).groupBy("shard").applyInArrow(search, "u long, v long"))


def neighbours(distinct: DataFrame, radius: int = BITS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """distinct (fp) -> pairs (u, v) of fingerprints within the radius that join all that ``linked`` joins. Each shard gives
    a forest of pairs that it has compared, so that a check can follow on pairs, of which there are few."""

    def search(table: pa.Table) -> pa.Table:
        fp, home = _sorted(table)
        forest: list[tuple[np.ndarray, np.ndarray]] = []
        link(np.ascontiguousarray(fp).view(np.uint64), home, radius, forest)
        u, v = (np.concatenate([pair[i] for pair in forest]) if forest else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"u": fp[u], "v": fp[v]})

    return _shards(distinct, radius, shard, sample).groupBy("shard").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = BITS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id that links reach."""
    prints = cut(fingerprints(docs, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = linked(distinct.select("fp"), radius, shard)
    of = cut(found.join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "least"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    known = cut(distinct.join(of.join(least, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return prints.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
