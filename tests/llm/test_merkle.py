from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from archweave.llm import merkle
from archweave.llm.queries import op13_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The root, and level by level what stands before and after each node in its run."""
    siblings, at, row = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(row) > 1:
        for k, i in enumerate(at):
            start = i - i % fanout
            siblings[k].append(("".join(row[start:i]), "".join(row[i + 1 : start + fanout])))
            at[k] = i // fanout
        row = [digest("".join(row[i : i + fanout])) for i in range(0, len(row), fanout)]
    return row[0], siblings


def brute(rows, fanout=8):
    """(doc_id, leaf, subroot, root, siblings)"""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], leaf_of(r)))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        by[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = climb([x[1] for x in by[g]], fanout)
    root, above = climb([trees[g][0] for g in groups], fanout) if groups else (None, [])
    return sorted(((d, lf, trees[g][0], root, s + up) for g, up in zip(groups, above) for (d, lf), s in zip(by[g], trees[g][1])), key=repr)


def got(df, fanout, levels):
    rows = merkle.manifest(df, FIELDS, "lang", "doc_id", fanout=fanout, levels=levels).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.siblings]) for r in rows), key=repr)


# The last group of a run is full, short by one block, of one block, at several rounds.
@pytest.mark.parametrize("fanout,levels,n", [(2, 1, 23), (3, 1, 32), (2, 2, 9), (8, 3, 40)])
def test_matches_brute_force(spark, fanout, levels, n):
    rows = [(i * 3 - 5, "s" if i % 4 else None, None if i % 5 == 4 else "é", i, None if i % 6 == 0 else f"Text é {i}") for i in range(n)]
    rows += [(1, "s", "en", 0, ""), (None, None, "é", None, None), (7, "s", "é", 1, "b"), (7, "s", "é", 1, "a"), (7, "s", "é", 1, "a"), (3, "x", "", 2, "y" * 100_000)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA + ", node string, group string, pos long").repartition(5)
    assert got(df, fanout, levels) == brute(rows, fanout)


def test_many_groups_and_one_leaf(spark):
    rows = [(i, "s", f"l{i}", 1, "t") for i in range(20)]
    assert got(spark.createDataFrame(rows, SCHEMA), 2, 1) == brute(rows, 2)
    alone = [(1, "s", "en", 1, "t")]
    assert got(spark.createDataFrame(alone, SCHEMA), 8, 3) == brute(alone) == [(1, leaf_of(alone[0]), leaf_of(alone[0]), leaf_of(alone[0]), [])]


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA), 8, 3) == []


def test_tampered_leaves_fail(spark, tmp_path):
    rows = [(i, "s", "en" if i % 3 else "de", 5, "ABC d" if i % 2 else "abc d") for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op13_merkle_manifest(spark, str(tmp_path)).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.doc_id % 2
        assert r.verified == (not changed) == (r.folded_root == r.root)


def test_proofs_fold_and_digest(spark):
    row = spark.range(1).select(F.array(F.struct(F.lit("a").alias("before"), F.lit("b").alias("after"))).alias("s"))
    kept = row.select(merkle.folded(F.lit("x"), F.col("s")).alias("root"), merkle.proof_digest(F.col("s")).alias("proof")).first()
    assert (kept.root, kept.proof) == (digest("axb"), digest("ab"))
