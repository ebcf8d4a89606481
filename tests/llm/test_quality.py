from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from archweave.llm.quality import bucket, bucket_floor, filter_documents, quality_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_features(text):
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if runs[(w[i], w[i + 1], w[i + 2])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)


def py_floor(v):
    if v < 64:
        return v
    e = v.bit_length() - 6
    return v >> e << e


def brute(rows, min_group=100):
    measured, groups = [], defaultdict(list)
    for doc, text, lang, source in rows:
        n, chars, sym, dup, rep, lines = brute_features(text)
        failed = n < 50 or 100 * rep > 50 * n
        ratio = [chars * 100 // max(n, 1), sym * 10000 // max(n, 1), dup * 10000 // max(lines, 1), rep * 10000 // max(n, 1)]
        measured.append((doc, lang, source, (n, chars, sym, dup, rep), failed, ratio))
        if not failed:
            for key in ((lang, source), (lang,), ()):
                groups[key].append(ratio)
    out = []
    for doc, lang, source, f, failed, ratio in measured:
        kept = not failed
        if kept:
            own = next(g for g in (groups[lang, source], groups[lang,], groups[()]) if len(g) >= min_group or g is groups[()])
            for m, (least, low) in enumerate([(50, True), (500, False), (1200, False), (1000, False)]):
                v = sorted(py_floor(r[m]) for r in own)
                q = lambda s: v[math.ceil(len(v) * s) - 1]
                spread = max(q(0.75) - q(0.25), least)
                kept &= ratio[m] <= q(0.75) + 3 * spread and (not low or ratio[m] >= q(0.25) - 3 * spread)
        out.append((doc, *f, failed, kept))
    return sorted(out, key=repr)


def rows(n=500):
    rnd = random.Random(11)
    out = []
    for i in range(n):
        words = [rnd.choice(["the", "é", "word", "日本語", "x", "longer", "to"]) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(30, 160))]
        if rnd.random() < 0.1:
            words = [w + "$$%" for w in words]
        if rnd.random() < 0.1:
            words = words[:20] * 5
        text = "".join(w + rnd.choice([" ", " ", "  ", "\n", "\t"]) for w in words)
        if rnd.random() < 0.1:
            text += "\nsame line\r\nsame line\r\n\n \nsame line" * rnd.randint(1, 8)
        out.append((i, text, rnd.choice(["en", "en", "fr", None]), rnd.choice(["a", "a", "b", None, ""])))
    return out + [(900, None, "en", "a"), (901, "", None, None), (902, "w " * 60, "xx", "rare"), (3, out[3][1], "en", "a"), (None, out[4][1], "en", "a")]


def test_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, lang string, source string, n_words int")
    got = quality_report(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = brute(data)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {k for *_, f, k in want if not f} == {True, False}
    kept = filter_documents(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((w[0] for w in want if w[-1]), key=repr)


def test_buckets_are_ordered_and_close(spark):
    r = spark.range(0, 5000).select("id", bucket(F.col("id")).alias("b")).withColumn("f", bucket_floor(F.col("b"))).orderBy("id").collect()
    assert all(x.f == py_floor(x.id) for x in r)
    assert [x.b for x in r] == sorted(x.b for x in r)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality_report(df).collect() == []
