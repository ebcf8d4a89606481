from __future__ import annotations

import random
from hashlib import md5, sha256

import numpy as np
import pytest

from archweave.llm import chunks as ch
from archweave.llm import quartile_digest as qd
from archweave.llm.queries import op12_fingerprints


def brute_digest(text):
    data = (text or "").encode()
    counts = [0] * 128
    for kind, (j, k) in enumerate(qd.TRIPLETS):
        for i in range(len(data) - k):
            h = data[i] | data[i + j] << 8 | data[i + k] << 16 | kind << 24
            h = h * 0x9E3779B1 % 2**32
            h = (h ^ h >> 15) * 0x9E3779B1 % 2**32
            counts[h >> 25] += 1
    one, two, three = (sorted(counts)[32 * q - 1] for q in (1, 2, 3))
    codes = [(c > one) + (c > two) + (c > three) for c in counts]
    length = min(255, int(8 * np.log2(len(data) + 1.0)))
    ratio = 16 * (15 * one // max(three, 1)) + 15 * two // max(three, 1)
    return bytes([length, ratio]) + bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 128, 4))


def brute_likeness(a, b):
    codes = lambda d: [x >> s & 3 for x in d[2:] for s in (6, 4, 2, 0)]
    off = abs(a[0] - b[0]) + abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))
    off += sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(codes(a), codes(b)))
    return 1 - min(off, qd.MOST) / qd.MOST


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, md5((r[1] or "").encode()).hexdigest()), reverse=True)
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        own, changed, following = map(brute_digest, (text, edited, after))
        out.append((doc, len(text), edited, own.hex(), changed.hex(), brute_likeness(own, changed), brute_likeness(own, following)))
    return sorted(out, key=repr)


def documents():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefé日 😀") for _ in range(rnd.randint(1, 7)))
    rows = [(i * 5 - 40, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    return rows + [(500, None), (501, ""), (502, "ab"), (503, "abc"), (504, "long é " * 60_000), (7, "tie"), (7, "tie two"), (7, "tie two"), (505, rows[3][1])]


@pytest.mark.parametrize("plan", [None, ch.Layout((-20, 50, 200, 300), 4), ch.Layout((), 1)])
def test_matches_brute_force(spark, plan):
    rows = documents()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, chunk long, fingerprint string").repartition(3)
    assert sorted(map(tuple, qd.edited_digests(df, plan).collect()), key=repr) == brute(rows)
    alone = {(r.doc_id, r.fingerprint, r.n_bytes) for r in qd.digests(df).collect()}
    assert alone == {(d, brute_digest(t).hex(), len((t or "").encode())) for d, t in rows}


def test_rows_without_doc_id_come_last(spark):
    rows = [(1, "one two three four"), (None, "no number at all"), (3, "five six seven eight")]
    assert sorted(map(tuple, qd.edited_digests(spark.createDataFrame(rows, "doc_id long, text string"), ch.Layout((2,), 1)).collect()), key=repr) == brute(rows)


def test_one_document_and_none(spark):
    alone = [(4, "one document is followed by itself")]
    df = spark.createDataFrame(alone, "doc_id long, text string")
    assert list(map(tuple, qd.edited_digests(df).collect())) == brute(alone)
    assert qd.edited_digests(df.where("false")).collect() == qd.digests(df.where("false")).collect() == []


def test_copies_are_alike_and_other_texts_are_not(spark, tmp_path):
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(300)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:5])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op12_fingerprints(spark, str(tmp_path)).collect()}
    assert all(got[i].fingerprint == got[40 + i].fingerprint and qd.likeness_of(got[i].fingerprint, got[40 + i].fingerprint) == 1 for i in range(5))
    assert all(0 <= r.near_next < r.near_edited <= 1 for r in got.values())
    assert got[0].edited_sha256 == sha256((texts[0][: len(texts[0]) - len(texts[0]) // 3] + rows[-1][1][: len(texts[0]) // 3]).encode()).hexdigest()
