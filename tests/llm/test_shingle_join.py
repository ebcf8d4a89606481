from __future__ import annotations

import random

import corpus_pipeline as cp
import pytest

from archweave.llm import shingle_join
from archweave.llm.shingle_join import near_copies, shingle_sets, similar
from archweave.llm.simhash import fingerprint


def shingled(text, k=5):
    words = [w for w in (text or "").encode().lower().split()]
    return words, {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_roots(texts, least=0.8):
    own = [shingled(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            (a, x), (b, y) = own[i], own[j]
            if a == b or (x and y and len(x & y) * 5 >= 4 * len(x | y)):
                p, q = root[i], root[j]
                root = [min(p, q) if r in (p, q) else r for r in root]
    return root


def corpus(seed, common=True):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Alpha", "beta", "é", "GAMMA"]) + str(rnd.randint(0, 300))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(25):
        words = [word() for _ in range(rnd.randint(3, 220))]
        if common and rnd.random() < 0.6:
            words[5:5] = passage[: rnd.randint(10, 30)]
        texts.append(" ".join(words))
    for _ in range(120):
        words = rnd.choice(texts).split(" ")
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6])):
            words[rnd.randrange(len(words))] = word()
        texts.append(rnd.choice([" ", "\n"]).join(words))
    for _ in range(60):  # a passage with few words of its own
        texts.append(" ".join([word() for _ in range(rnd.randint(1, 12))] + passage))
    return texts + ["", None, " \t", "one", "ONE", "one two"]


@pytest.mark.parametrize("sample", [1, 40, 10_000])
def test_similar_matches_brute_force(spark, sample):
    texts = corpus(sample)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = shingle_sets(df).cache()
    key = {r.doc_id: r.key for r in sets.collect()}
    root = {r.node: r.root for r in similar(sets, sample=sample, bucket=500).collect()}
    want: dict = {}
    for i, r in enumerate(brute_roots(texts)):
        want.setdefault(r, set()).add(i)
    got: dict = {}
    for i in range(len(texts)):
        got.setdefault(root.get(key[i], key[i]), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert 3 < sum(len(v) > 1 for v in want.values()) and max(map(len, want.values())) > 5


def test_stage_drops_copies_with_scattered_edits(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(200)]
    edited = [*base]
    for at in (30, 80, 130, 180):  # 20 of 196 shingles: a similarity of 0.81, but many bits
        edited[at] = "edit"
    other = [*base]
    for at in range(10, 200, 30):  # below 0.8
        other[at] = "other"
    df = spark.createDataFrame([(7, " ".join(edited)), (3, " ".join(base)), (9, " ".join(other)), (None, " ".join(base))], "doc_id long, text string")
    assert sorted((r.doc_id for r in cp.near_dedup(spark, df, "").collect()), key=repr) == [3, 9, None]


def test_rows_of_one_doc_id_are_judged_by_their_own_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c + " more"), (4, b), (4, b), (5, "x"), (5, "y"), (5, "y")]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(got) == 5 and {r.text for r in got if r.doc_id == 3} < {c, c + " more"}
    assert sorted(map(tuple, (r for r in got if r.doc_id != 3))) == [(1, a), (2, b), (5, "x"), (5, "y")]


def test_empty_table(spark):
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_stage_takes_links_of_the_fingerprint_tree(spark, monkeypatch):
    """With nothing from the exact join, copies within three bits still go, and only those that the check confirms."""
    rnd = random.Random(8)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(300)]
    once = [*base[:-1], "edit"]
    short = ["same"] * 30 + [f"s{i}" for i in range(12)]  # most shingles are one, repeated: equal bits, sets far apart
    far = ["same"] * 30 + [f"t{i}" for i in range(12)]
    texts = {4: base, 9: once, 2: short, 6: far, 5: base + base[:1], 8: [f"z{i}" for i in range(50)]}
    prints = {d: fingerprint(" ".join(t).encode(), 5) for d, t in texts.items()}
    bits = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    assert bits(4, 9) <= 3 and bits(4, 5) <= 3 and bits(2, 6) <= 3
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    gone = lambda: sorted(r.doc_id for r in near_copies(df).collect())
    assert gone() == [5, 9]
    none = lambda sent, *_: sent.selectExpr("bucket as u", "bucket as v").where("false")
    monkeypatch.setattr(shingle_join, "star_candidates", none)
    monkeypatch.setattr(shingle_join, "rest_candidates", none)
    assert gone() == [5, 9]


@pytest.mark.parametrize("seed", [3, 4])
def test_tree_and_join_together_match_brute_force(spark, seed):
    texts = corpus(seed)
    roots = brute_roots(texts)
    gone = {r.doc_id for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert gone == {i for i, r in enumerate(roots) if r in roots[:i]}
