from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from archweave.llm import chunks as ch
from archweave.llm.lm_scores import BACKOFF, stupid_backoff


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    uni, bi, n = Counter(w for d in words for w in d), Counter(p for d in words for p in zip(d, d[1:])), sum(map(len, words))
    out = []
    for (doc, _), d in zip(rows, words):
        own, pairs, score, backed = Counter(d), Counter(zip(d, d[1:])), 0.0, 0
        for i, w in enumerate(d):
            seen = i and bi[d[i - 1], w] - pairs[d[i - 1], w]
            if seen:
                score += math.log(seen / (uni[d[i - 1]] - own[d[i - 1]]))
            else:
                backed += 1
                score += math.log(BACKOFF * max(uni[w] - own[w], 1) / max(n - len(d), 1))
        out.append((doc, len(d), backed, round(score, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("plan", [None, ch.Layout((10, 30, 50), 8)])
def test_matches_brute_force(spark, plan):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([" ", "\n", " \t"]).join(rnd.choice(["the", "The", "É", "é", "of", "cat", f"r{rnd.randint(0, 99)}"]) for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "single"), (None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    got = [(r.doc_id, r.n_words, r.n_backoff, round(r.score, 6)) for r in stupid_backoff(df, plan).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_empty_table(spark):
    assert stupid_backoff(spark.createDataFrame([], "doc_id long, text string")).collect() == []
