from __future__ import annotations

import random

import corpus_pipeline as cp

from archweave.llm.line_dedup import remove_repeated_runs
from tests.llm.test_line_dedup import SPACE


def brute(rows, m, long_words):
    docs = {(d, t or ""): [x for x in (t or "").split("\n") if x.strip(SPACE)] for d, t in rows}
    seen, gone = set(), {}
    for key in sorted(docs, key=lambda k: (k[0] is None, k[0] or 0)):
        lines, cut = docs[key], set()
        for width in (1, m):
            for i in range(len(lines) - width + 1):
                window = tuple(lines[i : i + width])
                if width == m or len(window[0].encode().split()) >= long_words:
                    if window in seen:
                        cut.update(range(i, i + width))
                    seen.add(window)
        gone[key] = (len(lines), len(cut))
    return sorted(((d, *gone[d, t or ""]) for d, t in rows), key=repr)


def test_long_lines_match_brute_force(spark):
    rnd = random.Random(8)
    lines = [" ".join(rnd.choice(["a", "É", "c\t", "d e"]) for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    rows = [(i * 7 % 101, "\n".join(rnd.choice(lines) + rnd.choice(["", "", " own " + str(rnd.random())]) for _ in range(rnd.randint(1, 6)))) for i in range(60)]
    rows += [(300 + i, line) for i, line in enumerate(lines[:10] * 2)] + [(None, lines[0]), (500, None)]
    out = remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), long_words=5).collect()
    assert sorted(((r.doc.doc_id, r.n_lines, r.n_removed) for r in out), key=repr) == brute(rows, 2, 5)


def test_stage_deletes_a_long_line_between_other_neighbours(spark):
    passage = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd"), (3, passage), (4, passage), (5, "a"), (6, passage[:-4])], "doc_id long, text string")
    assert sorted(map(tuple, cp.line_dedup_stage(spark, df, "").collect())) == [(1, f"a\n{passage}\nb"), (2, "c\nd"), (5, "a"), (6, passage[:-4])]
