from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from archweave.llm import chunks as ch
from archweave.llm.suffix_dedup import remove_repeated_strings
from archweave.llm.suffix_sort import Suffixes


def brute(rows, n):
    first: dict[bytes, int] = {}
    for doc, text in rows:
        b = (text or "").encode()
        if doc is not None:
            for i in range(len(b) - n + 1):
                first[b[i : i + n]] = min(first.get(b[i : i + n], doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1 if doc is not None else 0):
            if first[b[i : i + n]] < doc:
                gone[i : i + n] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(np.sum(gone[:-1] & ~np.concatenate(([False], gone[:-2])))) if len(b) else 0
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def documents(seed, n=70):
    rnd = random.Random(seed)
    letters = "ab é日"
    passages = ["".join(rnd.choice(letters) for _ in range(rnd.randint(20, 90))) for _ in range(6)] + ["a" * 60]
    rows = []
    for i in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choice("cdefgh") for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 5))]
        rows.append((i * 3 - 20, "".join(parts)))
    return rows + [(900, None), (901, ""), (902, "short"), (None, passages[0]), (4, passages[1]), (4, passages[1]), (903, passages[2] * 2), (904, passages[0][:30] + "Z" + passages[0][31:])]


@pytest.mark.parametrize("length", [20, 25, 50])
@pytest.mark.parametrize("plan", [None, ch.Layout((0, 50, 120), 4), ch.Layout((), 1)])
def test_matches_brute_force(spark, plan, length):
    rows = documents(length)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_strings(df, length, plan).collect()]
    assert sorted(got, key=repr) == brute(rows, length)


def test_empty_table(spark):
    assert remove_repeated_strings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_sort_orders_as_bytes_do():
    rnd = random.Random(3)
    records = np.array([[rnd.choice(b"ab") for _ in range(40)] for _ in range(50)], np.uint8)
    record, offset = np.repeat(np.arange(50), 21), np.tile(np.arange(21), 50)
    order, number = Suffixes(records, 20).classes(record, offset)
    text = [records[r, o : o + 20].tobytes() for r, o in zip(record[order], offset[order])]
    assert text == sorted(text)
    assert len(set(text)) == number[-1] + 1
