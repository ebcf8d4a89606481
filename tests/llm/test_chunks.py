from __future__ import annotations

import bisect
import random

import pytest
from pyspark.sql import functions as F

from archweave.llm import chunks as ch
from archweave.llm.lm_scores import stupid_backoff
from archweave.llm.substring_dedup import remove_repeated_windows
from archweave.llm.suffix_dedup import remove_repeated_strings

AIM = 1 << 16


def sizes(spark, rows):
    """Bytes of each chunk that layout and dealing make of (doc_id, text)."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plan = ch.layout(docs, 1 / 5, chunk_bytes=AIM)
    dealt = ch.dealt(docs, plan)
    assert dealt.count() == len(rows)
    return plan, [r.n for r in dealt.groupBy("chunk").agg(F.sum(F.octet_length("text")).alias("n")).collect()]


@pytest.mark.parametrize(
    "rows",
    [
        [(None if i < 280 else i, f"{i} " * 800) for i in range(320)],
        [(i, "long " * 2000 if i < 100 else "s") for i in range(2000)],
        [(i, "long " * 6000 if i % 100 == 99 else "s") for i in range(3000)],
        [(10**12 * i, f"{i} " * 300) for i in range(700)],
    ],
    ids=["no ids", "long texts at one end", "long texts apart", "ids far apart"],
)
def test_no_chunk_is_over_twice_its_aim(spark, rows):
    plan, found = sizes(spark, rows)
    most = max(AIM, sum(len(t) for _, t in rows) / max(1, len(rows)), *(len(t) for _, t in rows))
    assert len(found) > 5 and max(found) <= 2 * most and plan.bounds == tuple(sorted(set(plan.bounds)))


def test_partitions_smaller_than_a_chunk_are_joined(spark):
    rows = [(i, f"{i} " * 100) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, found = sizes(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(found) > 10 and max(found) <= 2 * max(AIM, sum(found) / len(found))


def test_chunks_grow_with_the_fourth_root():
    grown = ch.CHUNK_BYTES * ((10**14) / ch.GROWS_FROM) ** 0.25
    assert 40 << 20 < grown < 64 << 20


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_bounds_in_a_table_are_those_in_the_plan(spark, most):
    bounds = tuple(sorted(random.Random(1).sample(range(1000), 37)))
    rows = [(i, str(i)) for i in range(-5, 1010)] + [(None, "a"), (None, None)]
    got = {(r.doc_id, r.text): r.chunk for r in ch.with_chunk(spark.createDataFrame(rows, "doc_id long, text string"), bounds, 4, most).collect()}
    assert len(got) == len(rows)
    assert all(got[d, t] == bisect.bisect_right(bounds, d) for d, t in rows if d is not None)
    assert all(len(bounds) < got[d, t] <= len(bounds) + 4 for d, t in rows if d is None)


def test_many_chunks_from_layout_change_no_result(spark):
    rnd = random.Random(3)
    passages = [" ".join(f"p{rnd.randint(0, 999)}" for _ in range(60)) for _ in range(6)]
    rows = [(i // 2 if i % 5 else None, " ".join([f"w{rnd.randint(0, 9999)}" for _ in range(40)] + rnd.sample(passages, rnd.randint(0, 2)))) for i in range(400)]
    rows.append((7, " ".join(f"v{i % 30_000}" for i in range(60_000)) + " " + passages[0]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = ch.layout(docs, 1 / 5, chunk_bytes=1 << 13)
    assert len(plan.bounds) > 8
    for run in (remove_repeated_windows, remove_repeated_strings, stupid_backoff):
        show = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.drop("removed", "spans", "kept").collect()), key=repr)
        assert show(run(docs, plan=plan)) == show(run(docs, plan=ch.Layout((), 1)))
