from __future__ import annotations

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from archweave.llm import grammar_runs as gr
from archweave.llm.queries import op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, words=6, repeats=4):
    """Every period from the smallest on, every stretch: (start, length, period)."""
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(words, repeats * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed, n):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        w = []
        for _ in range(rnd.randint(0, 5)):
            alphabet = rnd.choice([["a"], ["a", "é"], [f"w{i}" for i in range(40)]])
            part = [rnd.choice(alphabet) for _ in range(rnd.randint(1, 8))]
            w += (part * 9)[: rnd.randint(1, 9 * len(part))] if rnd.random() < 0.5 else part
        w *= rnd.choice([1, 1, 1, 4, 5])
        out.append(rnd.choice([" ", "\n", " \t "]).join(w))
    return out


def test_grammar_derives_the_texts():
    """Each nonterminal stands for the same words wherever it is derived, and no pair of a start rule recurs."""
    for text in texts(1, 60):
        w = WORD.findall(text)
        ids = np.array([sorted(set(w)).index(x) for x in w], np.int64)
        g = gr.repair(ids, np.array([0, len(ids)]))
        length = g.end - g.first
        for rule, at in zip(g.of, g.at):
            assert (ids[at : at + length[rule]] == ids[g.first[rule] : g.end[rule]]).all()
        pieces = [tuple(ids[a:b]) for a, b in zip(g.left, g.right)]
        assert [x for p in pieces for x in p] == ids.tolist()
        seen = {}
        for i, pair in enumerate(zip(pieces, pieces[1:])):
            assert i - seen.setdefault(pair, i) <= 1 or pair[0] == pair[1]


@pytest.mark.parametrize("words,repeats", [(6, 4), (3, 3), (10, 5)])
def test_runs_match_brute_force(spark, words, repeats):
    rows = list(enumerate(texts(words, 250))) + [(900, None), (901, ""), (901, ""), (None, "a b a b a b a b"), (902, "x " * 30_000 + "y z " * 20_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, runs long").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in gr.find_runs(df, words, repeats).collect()), key=repr)
    want = []
    for d, t in rows[:-1]:
        w = WORD.findall(t or "")
        runs = brute_runs(w, words, repeats)
        want.append((d, len(w), runs, collapsed(w, runs)))
    want.append((902, 70_000, [(0, 30_000, 1), (30_000, 40_000, 2)], "x y z"))
    assert got == sorted(want, key=repr)


def test_query_matches_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, t if i % 2 else " ".join(f"u{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 90)))) for i, t in enumerate(texts(4, 300))] + [(301, None), (None, "a " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = [], 0
    for d, t in rows:
        w = WORD.findall(t or "")
        if d is not None:
            h = zlib.crc32(str(d).encode())
            g, n = h // 10, len(w)
            if h % 10 == 0 and n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                planted += 1
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        sha = lambda x: sha256(x.encode()).hexdigest()
        want.append((d, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs))))
    assert planted > 10
    assert sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert gr.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_colliding_hashes_are_told_apart():
    ids = np.array([1, 2, 1, 2, 1, 2, 1, 2, 3, 4])
    assert gr._confirmed(ids, 0, 10, 0, 9, 2) == (0, 8)
