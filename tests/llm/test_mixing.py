from __future__ import annotations

import hashlib
import random
import re

import pytest

from archweave.llm.mixing import mix, mixed_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, share=1.5, most=2.0):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(z for z, r in zip(size, rows) if r[2] == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(size)
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if weight[n] * level > most * total[n]}
        for n in over or open_:
            target[n] = most * total[n] if over else weight[n] * level
        left -= sum(target[n] for n in over)
        open_ -= over or open_
    key = [int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16) for d, t, _ in rows]
    taken = {}
    for n in names:
        whole = int(target[n] // total[n]) if total[n] else 0
        need = target[n] - whole * total[n]
        groups: dict[int, int] = {}
        for k, z, r in zip(key, size, rows):
            if r[2] == n:
                groups[k] = groups.get(k, 0) + z
        extra, done = set(), 0
        for k in sorted(groups):
            if done + groups[k] <= need:
                extra.add(k)
                done += groups[k]
            else:
                if 2 * (need - done) >= groups[k]:
                    extra.add(k)
                break
        for i, r in enumerate(rows):
            if r[2] == n:
                taken[i] = size[i] * (whole + (key[i] in extra))
    return sorted(((r[0], size[i], total[r[2]], round(target[r[2]], 6), taken[i]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = ["b", "a", None, "", "É", "c"][: rnd.randint(2, 6)]
    rows = [(i, rnd.choice([" ", "\n", "  "]).join("w" * rnd.randint(0, 40)), rnd.choice(names + names[:1] * 6)) for i in range(200)]
    rows += [(900, None, names[0]), (901, " \t", names[0]), (5, rows[5][1], rows[5][2]), (None, "x y z", names[1]), (902, None, "empty source")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int")
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mix(df).collect()]
    assert sorted(got, key=repr) == brute(rows)
    out = mixed_documents(df)
    assert out.columns == [*df.columns, "copies"]
    assert sum(len(WORD.findall(r.text or "")) * r.copies for r in out.collect()) == sum(x[-1] for x in brute(rows))


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
