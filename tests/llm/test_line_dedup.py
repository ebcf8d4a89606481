from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from archweave.llm.line_dedup import deduplicated_documents, line_ids, remove_repeated_runs, suffix_classes

SPACE = " \t\n\x0b\f\r"


def brute(rows, m):
    docs = {}
    for doc, text in rows:
        docs[doc, text or ""] = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    order = sorted(docs, key=lambda k: (k[0] is None, k[0] or 0))
    seen, gone = set(), {}
    for key in order:
        lines, cut = docs[key], set()
        for i in range(len(lines) - m + 1):
            window = tuple(lines[i : i + m])
            if window in seen:
                cut.update(range(i, i + m))
            seen.add(window)
        gone[key] = cut
    out = []
    for doc, text in rows:
        cut, seq, kept = gone[doc, text or ""], 0, []
        for line in (text or "").split("\n"):
            word = bool(line.strip(SPACE))
            if not (word and seq in cut):
                kept.append(line)
            seq += word
        out.append((doc, seq, len(cut), sum(s - 1 not in cut for s in cut), "\n".join(kept) if text is not None else None))
    return sorted(out, key=repr)


def documents(seed):
    rnd = random.Random(seed)
    passages = [[f"line {rnd.randint(0, 12)}" for _ in range(rnd.randint(1, 9))] for _ in range(5)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            lines += rnd.choice(passages) if rnd.random() < 0.6 else [rnd.choice([f"own {rnd.random()}", "", " \t", "same"]) for _ in range(rnd.randint(0, 4))]
        rows.append((i * 3, "\n".join(lines)))
    return rows + [(500, None), (501, ""), (None, "\n".join(passages[0] * 2)), (6, rows[2][1]), (6, rows[2][1]), (600, "same\nsame\nsame\nsame\nsame"), (601, "same\n\nsame")]


@pytest.mark.parametrize("m", [1, 2, 4])
def test_matches_brute_force(spark, m):
    rows = documents(m)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, d int, starts string")
    got = [(r.doc.doc_id, r.n_lines, r.n_removed, r.n_runs, r.kept_text) for r in remove_repeated_runs(df, m).collect()]
    assert sorted(got, key=repr) == brute(rows, m)


def test_ranks_are_those_of_the_suffix_array(spark):
    rows = documents(3)
    lines = line_ids(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    of: dict = {}
    for r in lines.collect():
        of.setdefault((r.d, r.g), {})[r.s] = r.h
    lengths = []
    for length, table in suffix_classes(lines):
        lengths.append(length)
        got = {(r.d, r.g, r.s): r.r for r in table.collect()}
        key = {p: tuple(of[p[:2]][p[2] + i] for i in range(length)) for p in got}
        full = [(d, g, s) for (d, g), own in of.items() for s in own if s + length - 1 in own]
        times: dict = {}
        for d, g, s in full:
            k = tuple(of[d, g][s + i] for i in range(length))
            times[k] = times.get(k, 0) + 1
        assert {k for k in times if times[k] > 1} == set(key.values()) and len(got) == sum(n for n in times.values() if n > 1)
        in_order = sorted(got, key=lambda p: got[p])
        assert [key[p] for p in in_order] == sorted(key[p] for p in in_order)
        assert len(set(got.values())) == len(set(key.values()))
    assert lengths[:3] == [1, 2, 4]


def test_deduplicated_documents(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "en", 5), (2, "x\na\nb", "en", 5), (3, "a\nb", "en", 3), (4, "", "en", 0), (5, None, "en", None)], "doc_id long, text string, lang string, n_chars long")
    out = deduplicated_documents(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a\nb\nc", "en", 5), (2, "x", "en", 1), (4, "", "en", 0), (5, None, "en", None)]


def test_empty_table(spark):
    assert remove_repeated_runs(spark.createDataFrame([], "doc_id long, text string")).select(F.col("n_lines")).collect() == []


def brute_longest(rows):
    """The greatest power of two of lines, two at least, that a run has which also starts earlier."""
    docs = {(doc, text or ""): [x for x in (text or "").split("\n") if x.strip(SPACE)] for doc, text in rows}
    order = sorted(docs, key=lambda k: (k[0] is None, k[0] or 0))
    seen, out = set(), {}
    for key in order:
        lines, most = docs[key], 0
        for i in range(len(lines)):
            for n in range(1, len(lines) - i + 1):
                window = tuple(lines[i : i + n])
                most = max(most, n if window in seen else 0)
                seen.add(window)
        out[key] = 1 << (most.bit_length() - 1) if most > 1 else 0
    return out


def test_lengths_come_from_the_deepest_intervals(spark):
    rows = [(i, "\n".join(f"row {k}" for k in range(a, b))) for i, (a, b) in enumerate([(0, 40), (3, 30), (100, 103), (101, 140), (5, 12), (120, 137)])] + documents(5)
    got = {(r.doc.doc_id, r.kept_text is None): r.longest_match for r in remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_longest(rows)
    assert {k: v for k, v in got.items() if k[0] is not None and k[0] < 6} == {(i, False): want[rows[i]] for i in range(6)}
    assert [want[rows[i]] for i in range(6)] == [0, 16, 0, 2, 4, 16]


def test_a_very_long_text(spark):
    long = "\n".join(f"w{i % 50_000}" for i in range(120_000))
    got = {r.doc.doc_id: r for r in remove_repeated_runs(spark.createDataFrame([(1, "w7\nw8"), (2, long)], "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_lines, got[2].n_removed, got[2].n_runs, got[2].longest_match) == (0, 120_000, 70_002, 2, 65_536)
