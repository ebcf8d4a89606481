"""All stages, one after the other, against brute force of the rules in force: long lines, five words, a similarity of 0.8."""

from __future__ import annotations

import random

import corpus_pipeline as cp
from archweave.llm.line_dedup import LONG_WORDS
from tests.llm import test_decontaminate as contamination
from tests.llm import test_mixing as mixing
from tests.llm import test_quality as quality
from tests.llm.test_line_dedup import SPACE
from tests.llm.test_shingle_join import brute_roots


def corpus():
    rnd = random.Random(5)
    items = [(i, " ".join(f"q{rnd.randint(0, 400)}" for _ in range(14))) for i in range(5)]
    rows = []
    for i in range(120):
        text = "\n".join(" ".join(rnd.choice(["the", "of", "é", "data"]) + str(rnd.randint(0, 60)) for _ in range(rnd.randint(5, 25))) + "." for _ in range(rnd.randint(2, 12)))
        if rnd.random() < 0.15 and rows:
            text = rnd.choice(rows)[1]
            if rnd.random() < 0.5:  # the same lines, joined, so that line dedup doesn't see the copy
                text = text.replace("\n", " ")
        if rnd.random() < 0.1:
            text += "\n" + rnd.choice(items)[1].upper()
        if rnd.random() < 0.1:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((i, text, rnd.choice(["en", "fr"]), rnd.choice(["s1", "s1", "s2", None]), len(text)))
    return rows + [(200, None, "en", "s1", None), (200, None, "en", "s1", None), (None, rows[0][1], None, "s2", 1)], items


def without_later_copies(rows):
    """Per row: the text that is left, or None if the document goes."""
    docs = {(r[0], r[1] or ""): [x for x in (r[1] or "").split("\n") if x.strip(SPACE)] for r in rows}
    seen, gone = set(), {}
    for key in sorted(docs, key=lambda k: (k[0] is None, k[0] or 0)):
        lines, cut = docs[key], set()
        for i, line in enumerate(lines):
            if len(line.encode().split()) >= LONG_WORDS:
                if line in seen:
                    cut.add(i)
                seen.add(line)
            two = tuple(lines[i : i + 2])
            if len(two) == 2:
                if two in seen:
                    cut.update((i, i + 1))
                seen.add(two)
        gone[key] = cut
    out = []
    for r in rows:
        cut, lines = gone[r[0], r[1] or ""], docs[r[0], r[1] or ""]
        if lines and len(cut) == len(lines):
            continue
        kept, at = [], 0
        for line in (r[1] or "").split("\n"):
            word = bool(line.strip(SPACE))
            if not (word and at in cut):
                kept.append(line)
            at += word
        text = "\n".join(kept) if cut else r[1]
        out.append((r[0], text, *r[2:4], len(text) if cut else r[4]))
    return out


def without_near_copies(rows):
    named = list(dict.fromkeys(r for r in rows if r[0] is not None))
    roots = brute_roots([r[1] for r in named])
    best: dict = {}
    for r, root in zip(named, roots, strict=True):
        best[root] = min(best.get(root, r[0]), r[0])
    assert len({r[0] for r in named}) == len(named)
    return [r for r, root in zip(named, roots, strict=True) if best[root] == r[0]] + [r for r in rows if r[0] is None]


def test_all_stages_match_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, held, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows, []
    for name, stage in cp.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality_rules":
            kept = {(d, n) for d, n, *_, k in quality.brute([r[:4] for r in held]) if k}
            want = [r for r in held if (r[0], quality.brute_features(r[1])[0]) in kept]
        elif name == "line_dedup":
            want = without_later_copies(held)
        elif name == "simhash_near_dedup":
            want = without_near_copies(held)
        elif name == "benchmark_decontamination":
            clean = {d for d, _, n, _ in contamination.brute([r[:2] for r in held], items) if not n}
            want = [r for r in held if r[0] in clean]
        else:
            taken = {(d, z): t for d, z, _, _, t in mixing.brute([(r[0], r[1], r[3]) for r in held])}
            size = lambda r: len(mixing.WORD.findall(r[1] or ""))
            want = [(*r, taken[r[0], size(r)] // size(r)) for r in held if size(r) and taken[r[0], size(r)]]
        assert sorted(map(tuple, docs.collect()), key=repr) == sorted(want, key=repr), name
        held = want if name != "mixing" else held
        sizes.append(len(held))
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) >= 4


def test_no_text_is_shuffled_by_source_or_language(spark, tmp_path):
    """Of the last plans of these stages, no exchange has the documents' rows below it."""
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (cp.quality_rules, cp.mixing_stage):
            plan = stage(spark, docs, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("\n")
            scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "text" in x)
            depth = lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)"))
            above = [x for i, x in enumerate(lines[:scan]) if depth(x) < depth(lines[scan]) and all(depth(y) > depth(x) for y in lines[i + 1 : scan + 1])]
            assert above and not any("Exchange" in x for x in above), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
