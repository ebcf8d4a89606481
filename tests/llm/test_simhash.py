from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from archweave.llm.simhash import link, linked, near_duplicates, neighbours, overlapped, shard_tree


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    reach = {d: d for d in range(len(prints))}
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                a, b = reach[i], reach[j]
                reach = {k: (b if v == a else v) for k, v in reach.items()}
    least: dict = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[reach[i]] = min(least.get(reach[i], d), d)
    return sorted(((d, f"{p:016x}", least.get(reach[i])) for i, (d, p) in enumerate(prints)), key=repr)


def test_matches_brute_force(spark):
    rnd = random.Random(4)
    base = [" ".join(rnd.choice(["Alpha", "beta", "é", "GAMMA", "ÀB", "x", "y", "z"]) + str(rnd.randint(0, 50)) for _ in range(rnd.randint(60, 200))) for _ in range(12)]
    rows = [(i * 5 % 97, t) for i, t in enumerate(base)]
    for i in range(60):
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = "edit"
        rows.append((100 + i, rnd.choice([" ", "\n", "  "]).join(words)))
    rows += [(300, None), (301, ""), (302, " \t"), (303, "one"), (304, "ONE"), (305, "one two"), (None, base[0]), (7, base[1]), (7, base[1]), (None, "alone here and there")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, node int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df, shard=4).collect()), key=repr)
    assert got == brute_components([(d, brute_print(t)) for d, t in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_loses_no_pair(spark, seed):
    rnd = np.random.default_rng(seed)
    base = rnd.integers(0, 2**64, 300, dtype=np.uint64)
    near = base[rnd.integers(0, 300, 900)].copy()
    for _ in range(3):
        near ^= (np.uint64(1) << rnd.integers(0, 64, 900).astype(np.uint64)) * rnd.integers(0, 2, 900).astype(np.uint64)
    points = np.unique(np.concatenate([base, near, np.array([0, 1, 2**64 - 1], np.uint64)]))
    want = link(points, np.ones(len(points), bool), 3)
    pair = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    for i, j in zip(*np.nonzero(pair)):
        assert want[i] == want[j]
    nodes = shard_tree(points, 5)
    index, shard, home = overlapped(nodes, points, 3)
    assert home.sum() == len(points)
    own = dict(zip(index[home], shard[home]))
    seen = set(zip(index, shard))
    assert all((i, own[j]) in seen for i, j in zip(*np.nonzero(pair)))
    got = {r.node: r.root for r in linked(spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long"), shard=32).collect()}
    groups: dict = {}
    for p, root in zip(points.view(np.int64).tolist(), want):
        groups.setdefault(root, set()).add(p)
    mine: dict = {}
    for node, root in got.items():
        mine.setdefault(root, set()).add(node)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_neighbours_are_within_the_radius_and_span_what_is_linked(spark):
    rnd = np.random.default_rng(3)
    points = np.repeat(rnd.integers(0, 2**64, 60, dtype=np.uint64), 12)
    for _ in range(4):
        points ^= (np.uint64(1) << rnd.integers(0, 64, len(points)).astype(np.uint64)) * rnd.integers(0, 2, len(points)).astype(np.uint64)
    points = np.unique(points)
    pairs = neighbours(spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long"), shard=32).toPandas()
    u, v = (np.searchsorted(points, pairs[c].to_numpy().view(np.uint64)) for c in "uv")
    assert np.bitwise_count(points[u] ^ points[v]).max() <= 3 and (u != v).all()
    root = np.arange(len(points))
    for a, b in zip(u, v, strict=True):
        root[root == max(root[a], root[b])] = min(root[a], root[b])
    assert (root == link(points, np.ones(len(points), bool), 3)).all()


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
