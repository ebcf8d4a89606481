"""Small known cases of operators, and brute force for the helpers that SQL can't say."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from archweave.components import components
from archweave.contract import Contract, Layer, Rule
from archweave.functions.names import baseline_key, stable_hash
from archweave.functions.paths import glob_to_regex, normalize_path, slice_id
from archweave.operators import events, experiments, graph, layers, ratchet


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_finding_refs_are_the_known_ones(spark):
    row = ("r", "LAYER_IMPORT_VIOLATION", "src/domain/order.ts", "DomainModel", "PersistenceAdapters", "src/infra/db.ts")
    df = spark.createDataFrame([(*row, 4), (*row, 10)], "repo string, rule_id string, file string, from_layer string, to_layer string, target string, line long")
    got = ratchet.finding_refs(ratchet.occurrence_keys(df)).orderBy("line").collect()
    assert [r.ref for r in got] == ["fnv1a-aec4000a", "fnv1a-5ac9e33b"]
    assert got[1].key.endswith("#2")
    assert one(spark, stable_hash(F.col("x")), x="") == "fnv1a-811c9dc5"
    assert one(spark, baseline_key(F.lit("FORBIDDEN_GLOBAL"), F.lit("x.ts"), F.col("x"), F.col("x"), F.col("x")), x=None) == "FORBIDDEN_GLOBAL|x.ts|||"


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("src/domain/**", ["src/domain/a.ts", "src/domain/x/y"], ["src/domainx/a", "lib/src/domain/a"]),
        ("**/*.gen.ts", ["a.gen.ts", "x/y/a.gen.ts"], ["a.gen.tsx"]),
        ("src/{a,b}/?.ts", ["src/a/x.ts", "src/b/y.ts"], ["src/c/x.ts", "src/a/xx.ts", "src/a//.ts"]),
        ("src/{a/x", ["src/{a/x"], ["src/a/x"]),
        (r"a\*b", ["a*b"], ["axb"]),
        ("a.b+c", ["a.b+c"], ["aXb+c", "a.bbc"]),
    ],
)
def test_globs(glob, yes, no):
    regex = re.compile(glob_to_regex(glob))
    assert all(regex.match(p) for p in yes) and not any(regex.match(p) for p in no)


def test_braces_can_be_literals():
    assert re.match(glob_to_regex("a/{x,y}", braces=False), "a/{x,y}") and not re.match(glob_to_regex("a/{x,y}", braces=False), "a/x")


@pytest.mark.parametrize(("path", "want"), [("a/./b//c/../d", "a/b/d"), ("..\\x\\..\\y", "../y"), ("../../a", "../../a"), ("", ""), ("a/..", "")])
def test_normalize_path(spark, path, want):
    assert one(spark, normalize_path(F.col("x")), x=path) == want


def test_slices_and_peer_isolation(spark):
    assert one(spark, slice_id(F.col("x"), ("Features",)), x="src/features/Auth/api.ts") == "features/auth"
    assert one(spark, slice_id(F.col("x"), ("features",)), x="src/features") is None
    contract = Contract((Layer("F", ("src/features/**",)),), (Rule("F", "F"), Rule("F", "F", peer_isolation=True, slice_folders=("features",))))
    rows = [("src/features/a/x.ts", "src/features/a/y.ts"), ("src/features/a/x.ts", "src/features/b/y.ts"), ("src/features", "src/features/a/y.ts")]
    df = spark.createDataFrame([("r", a, b, "F", "F", 1, True) for a, b in rows], "repo string, from_path string, to_path string, from_layer string, to_layer string, line long, type_only boolean")
    got = {(r.file, r.target): r.blocking for r in layers.layer_violations(df, contract).collect()}
    assert got == {rows[1]: True, rows[2]: True}


def test_ties_go_to_the_layer_declared_first(spark):
    contract = Contract((Layer("B", ("src/x/**",)), Layer("A", ("src/x/**",)), Layer("Deep", ("src/**/core/**",))), ())
    df = spark.createDataFrame([("r", "src/x/a.ts"), ("r", "src/x/core/a.ts"), ("r", "lib/a.ts")], "repo string, path string")
    assert {r.path: r.layer for r in layers.classify_layers(df, contract).collect()} == {"src/x/a.ts": "B", "src/x/core/a.ts": "Deep", "lib/a.ts": None}


@pytest.mark.parametrize("seed", range(5))
def test_cycles_match_reachability(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    edges = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(18)} - {(n, n) for n in nodes})
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for k, i in itertools.product(nodes, nodes):
        if k in reach[i]:
            reach[i] |= reach[k]
    want = {tuple(sorted(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes if n in reach[n]}
    assert {tuple(c) for c in graph.strong_components(edges)} == want
    df = spark.createDataFrame([(r, *e) for r in ("one", "two") for e in edges] or [], "repo string, from_path string, to_path string")
    got = {(r.repo, r.members) for r in graph.find_cycles(df).collect()}
    assert got == {(r, ",".join(c)) for r in ("one", "two") for c in want}


def test_components_of_paths_and_hubs(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    rnd.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200}


def test_payload_issues(spark):
    contract = (events.EventContract("Domain.X", "1", {"id": ("string", True), "n": ("number", False)}),)
    rows = [(1, '{"id": "a"}'), (2, '{"n": 1}'), (3, '{"id": 4, "n": "x"}'), (4, "no json"), (5, None)]
    df = spark.createDataFrame([(i, "Domain.X", "1", p) for i, p in rows], "event_id long, intent string, event_version string, payload string")
    got = sorted((r.event_id, r.path, r.code) for r in events.validate_payload(df, contract).collect())
    assert got == [(2, "id", "missing-required"), (3, "id", "type"), (3, "n", "type"), (4, "id", "missing-required"), (5, "id", "missing-required")]


def test_workflow_of_a_failing_saga(spark):
    df = spark.createDataFrame([(1, 1, "step1", 1, "completed", True), (1, 2, "step2", 3, "failed", True), (1, 3, "step3", 1, "completed", True)], "workflow_id long, seq long, step string, attempts long, outcome string, has_compensation boolean")
    r = events.workflow_state(df).first()
    assert (r.status, r.completed_steps, r.failed_step, r.compensations, r.attempts) == ("failed", "step1", "step2", "step1", 4)


def test_percentiles_of_censored_times(spark):
    df = spark.createDataFrame([("c", "first_valid", 1000), ("c", "censored", 10000), ("c", "censored", 10000)], "arm string, outcome string, restricted_ms long")
    assert experiments.arm_summary(df).first().restricted_mean == 7000
    r = experiments.first_valid_percentile(df, 0.5).first()
    assert (r.value, r.status) == (None, "not_reached")


def test_bootstrap_agrees_with_itself(spark):
    rnd = random.Random(3)
    rows = [(i, i % 6, i % 24, rnd.randint(100, 200), rnd.randint(60, 120)) for i in range(300)]
    df = spark.createDataFrame(rows, "pair_id long, repository_id long, task_id long, control_ms long, treatment_ms long")
    a, b = experiments.paired_bootstrap(df, 300).first(), experiments.paired_bootstrap(df.repartition(7), 300).first()
    assert (a.lower, a.upper) == (b.lower, b.upper)
    assert a.lower < a.estimate < a.upper
