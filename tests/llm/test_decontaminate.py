from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from archweave.llm.decontaminate import clean_documents, find_benchmark, n_hit

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    patterns: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for m in range(1, window + 1):
                key = tuple(w[i : i + m])
                if len(key) == m and key in patterns:
                    hit.update(range(i, i + m))
                    found |= patterns[key]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def fixture(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "É", "cc", "日本", "d4"]
    items = [(i % 9, rnd.choice([" ", "-", ", "]).join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 7, 10, 11, 25])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "?!"), (None, " ".join(f"n{i}" for i in range(12))), (23, " ".join(["same"] * 14))]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(0, 8)):
            parts.append(rnd.choice(items)[1] or "" if rnd.random() < 0.3 else " ".join(rnd.choice([*vocabulary, "zz", "Q"]) for _ in range(rnd.randint(0, 90))))
        docs.append((i, "\n".join(parts).swapcase()))
    return docs + [(100, None), (101, ""), (None, items[4][1]), (5, docs[5][1]), (102, " ".join(["same"] * 40))], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_matches_brute_force(spark, block_bytes):
    docs, items = fixture(7)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, doc_id string")
    got = find_benchmark(d, b, block_bytes=block_bytes).select("doc_id", "n_words", n_hit().alias("n_hit"), "item_ids").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r.item_ids)) for r in got), key=repr) == brute(docs, items)


def test_clean_documents_keeps_columns(spark):
    d = spark.createDataFrame([(1, "one two three four", "l"), (2, "nothing here", "l"), (3, None, "l")], "doc_id long, text string, lang string")
    b = spark.createDataFrame([(1, "Two, three")], "item_id int, text string")
    got = clean_documents(d, b)
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted(r.doc_id for r in got.collect()) == [2, 3]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert [(r.n_words, r.item_ids) for r in find_benchmark(d, b.limit(0)).collect()] == [(2, [])]
    assert find_benchmark(d.limit(0), b).select(F.col("doc_id")).collect() == []


def test_tables_of_a_whole_block_stay_small():
    """A block of distinct windows, as large as it may be: what the driver allocates for it, beyond the text."""
    import tracemalloc

    import pyarrow as pa

    from archweave.llm.decontaminate import BLOCK_BYTES, patterns

    rnd = random.Random(1)
    texts, left = [], BLOCK_BYTES
    while left > 0:
        texts.append(" ".join(f"w{rnd.randint(0, 30_000)}" for _ in range(600)))
        left -= len(texts[-1])
    column = pa.chunked_array([texts])
    tracemalloc.start()
    made = patterns([str(i) for i in range(len(texts))], column, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20 and len(made.searchers) == 1 and len(made.searchers[0].first) > 1_000_000


def test_a_very_long_text_and_windows_that_many_items_share(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    items = [(str(i), passage) for i in range(300)] + [("x", "lone word"), ("y", "p1 p2")]
    long = " ".join(f"w{i}" for i in range(200_000)) + " " + passage
    docs = spark.createDataFrame([(1, long), (2, "lone words")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, len(r.item_ids), [tuple(s) for s in r.spans]) for r in find_benchmark(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {1: (200_012, 301, [(200_000, 12)]), 2: (2, 0, [])}
