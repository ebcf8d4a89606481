from __future__ import annotations

import hashlib
import random
import re

import pytest

from archweave.llm import chunks as ch
from archweave.llm.substring_dedup import remove_repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    first: dict[tuple, int] = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        if doc is not None:
            for i in range(len(words) - k + 1):
                key = tuple(words[i : i + k])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - k + 1 if doc is not None else 0):
            if first[tuple(words[i : i + k])] < doc:
                gone.update(range(i, i + k))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def documents(seed, n=60, k=5):
    rnd = random.Random(seed)
    vocabulary = ["a", "bb", "ccc", "é", "日本", "x" * 40, "d\x00e", " ", "f"]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(k, 3 * k))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 6)):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(1, 9))]
        rows.append((i * 7 - 50, rnd.choice([" ", "  ", "\n", " \t"]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (None, rows[3][1]), (None, " ".join(passages[0])), (5, rows[4][1]), (5, rows[4][1]), (2000, rows[5][1] * 2)]
    return rows


@pytest.mark.parametrize("plan", [None, ch.Layout((0, 70, 200), 4), ch.Layout((), 1)])
def test_matches_brute_force(spark, plan):
    rows = documents(1)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, chunk string")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_windows(df, 5, plan).collect()]
    assert sorted(got, key=repr) == brute(rows, 5)


def test_intervals_are_maximal(spark):
    rows = [(1, "a b c d e f g h"), (2, "x a b c d y"), (3, "e f g h a b c d")]
    got = {r.doc_id: [(i.first_word, i.n_words) for i in r.removed] for r in remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {1: [], 2: [(1, 4)], 3: [(0, 8)]}


def test_empty_table(spark):
    assert remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).collect() == []
