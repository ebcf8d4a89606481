"""Components of few edges take few tasks; rounds in one partition and rounds dealt by node give the same."""

from __future__ import annotations

import random

import pytest

from archweave import components as stars


def edges():
    rnd = random.Random(3)
    found = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    found += [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    rnd.shuffle(found)
    return found


def brute_roots(pairs):
    root = {n: n for pair in pairs for n in pair}
    for u, v in pairs:
        p, q = root[u], root[v]
        root = {n: min(p, q) if r in (p, q) else r for n, r in root.items()}
    return root


@pytest.mark.parametrize("few", [0, 100, 1 << 16])
def test_rounds_in_one_partition_and_dealt(spark, monkeypatch, few):
    """100: the 130 edges are dealt at first."""
    monkeypatch.setattr(stars, "FEW", few)
    df = spark.createDataFrame(edges(), "u long, v long")
    assert {r.node: r.root for r in stars.components(df).collect()} == brute_roots(edges())


def test_few_edges_take_few_tasks(spark):
    """A round isn't dealt over all partitions; only the edges as they come are."""
    context, own = spark.sparkContext, {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    df = spark.createDataFrame(edges(), "u long, v long")
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        context.setJobGroup("components of few edges", "")
        assert len(stars.components(df).collect()) == len(brute_roots(edges()))
        seen = context.statusTracker()
        stages = {s for job in seen.getJobIdsForGroup("components of few edges") for s in seen.getJobInfo(job).stageIds}
        assert stages and sum(x.numCompletedTasks for s in stages if (x := seen.getStageInfo(s))) < 6 * 32
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
