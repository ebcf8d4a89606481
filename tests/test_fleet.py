"""Contracts of several repositories in one job, snapshots as a key, and nothing cut off."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from archweave.contract import FLEET, Contract, Layer, Rule
from archweave.jobs.fleet import ONION, SLICED
from archweave.operators import coach, fleet, graph, layers, policy
from archweave.sources import contracts
from archweave.sources import facts as src

PATHS = [
    "src/domain/a.ts", "src/domain/x.gen.ts", "src/features/auth/ui/x.ts", "src/features/auth/api.ts", "src/features/bill/api.ts", "src/kernel/k.ts", "src/lib/f2.ts", "src/lib/f12.ts", "src/lib/f.ts",
    "src/ui/a.ts", "src/adapters/persistence/p.ts", "lib.ts", "src\\kernel\\w.ts", "src/features/x.ts", "", "src/presentation/é/p.ts", "src/Features/auth/x.ts",
]


def tables(spark, named):
    made = [contracts.contract_tables(c, spark.createDataFrame([(repo,)], "repo string")) for repo, c in named.items()]
    union = lambda name: made[0][name] if len(made) == 1 else made[0][name].union(union_of([m[name] for m in made[1:]]))
    union_of = lambda frames: frames[0] if len(frames) == 1 else frames[0].union(union_of(frames[1:]))
    return union("layers"), union("rules")


def facts(spark, repos):
    files = spark.createDataFrame([(r, p) for r in repos for p in PATHS], "repo string, path string")
    edges = [(r, a, b, i, (i + j) % 3 == 0) for r in repos for i, a in enumerate(PATHS) for j, b in enumerate(PATHS)]
    return files, spark.createDataFrame(edges, "repo string, from_path string, to_path string, line long, type_only boolean")


def test_contracts_together_are_as_each_alone(spark):
    named = {"a": FLEET, "b": ONION, "c": SLICED, "d": Contract((Layer("L", ("src/{a,b}/**", "src/**/f?.ts", "*")), Layer("None", ())), (Rule("L", "L", peer_isolation=True),))}
    files, edges = facts(spark, [*named, "none"])
    together = fleet.compiled(*tables(spark, named))
    classified = fleet.classify_fleet(files.withColumn("layer", F.lit("old")), together)
    violations = fleet.fleet_violations(layers.build_edges(edges, classified), together)
    members = fleet.fleet_memberships(files, together)
    for repo, contract in named.items():
        own, mine = files.where(F.col("repo") == repo).withColumn("path", F.replace("path", F.lit("\\"), F.lit("/"))), edges.where(F.col("repo") == repo)
        alone = layers.classify_layers(own, contract)
        got = lambda df: sorted(map(tuple, df.where(F.col("repo") == repo).withColumns({c: F.replace(c, F.lit("\\"), F.lit("/")) for c in df.columns if c == "path"}).collect()), key=repr)
        assert got(classified.select("repo", "path", "layer")) == sorted(map(tuple, alone.select("repo", "path", "layer").collect()), key=repr)
        assert got(members) == sorted(map(tuple, layers.layer_memberships(own, contract).collect()), key=repr)
        want = layers.layer_violations(layers.build_edges(mine, classified), contract)
        assert got(violations) == sorted(map(tuple, want.collect()), key=repr)
    assert {r.layer for r in classified.where("repo = 'none'").collect()} == {None} and violations.where("repo = 'none'").isEmpty()


def test_contracts_by_snapshot_and_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(fleet, "SMALL", 0)
    layers_, rules = tables(spark, {"a": FLEET})
    other, deny = tables(spark, {"a": ONION})
    at = lambda df, s: df.withColumn("snapshot", F.lit(s))
    made = fleet.compiled(at(layers_, "1").union(at(other, "2")), at(rules, "1").union(at(deny, "2")))
    files, edges = facts(spark, ["a"])
    both = lambda df: at(df, "1").unionByName(at(df, "2"))
    classified = fleet.classify_fleet(both(files), made)
    assert {(r.snapshot, r.layer) for r in classified.where("path = 'src/kernel/k.ts'").collect()} == {("1", "Kernel"), ("2", "Core")}
    found = fleet.fleet_violations(layers.build_edges(both(edges), classified), made)
    for snapshot, contract in (("1", FLEET), ("2", ONION)):
        alone = layers.layer_violations(layers.build_edges(edges, classified.where(F.col("snapshot") == snapshot).drop("snapshot")), contract)
        assert sorted(map(tuple, found.where(F.col("snapshot") == snapshot).drop("snapshot").collect()), key=repr) == sorted(map(tuple, alone.collect()), key=repr)
    with pytest.raises(ValueError, match="snapshot"):
        fleet.classify_fleet(files, made)


def test_a_read_contract_keeps_all_rules_in_order(spark, tmp_path):
    rule = lambda a, b, **more: {"from": a, "to": b, **more}
    doc = {
        "repo": "r",
        "layers": [{"name": "A", "patterns": ["a/**"]}, {"name": "B", "patterns": ["b/**"]}, {"name": "F", "patterns": ["src/features/*/**"]}],
        "rules": [rule("A", "B", allowed=True), rule("A", "B", allowed=False, message="denied below"), rule("B", "A", message="absent is no deny"), rule("F", "F", allowed=False, peerIsolation=True), rule("A", "B", allowed=False, message="later")],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc))
    read = contracts.read_contract(spark, str(tmp_path))
    made = fleet.compiled(read["layers"], read["rules"])
    files = spark.createDataFrame([("r", p) for p in ("a/x.ts", "b/x.ts", "src/features/p/x.ts", "src/features/q/x.ts")], "repo string, path string")
    pairs = [("a/x.ts", "b/x.ts"), ("b/x.ts", "a/x.ts"), ("src/features/p/x.ts", "src/features/q/x.ts"), ("src/features/p/x.ts", "src/features/p/x.ts")]
    edges = spark.createDataFrame([("r", a, b, 1, True) for a, b in pairs], "repo string, from_path string, to_path string, line long, type_only boolean")
    found = fleet.fleet_violations(layers.build_edges(edges, fleet.classify_fleet(files, made)), made)
    assert sorted((r.file, r.target, r.message, r.blocking) for r in found.collect()) == [("a/x.ts", "b/x.ts", "denied below", False), ("src/features/p/x.ts", "src/features/q/x.ts", "", True)]
    own = contracts.as_contract(read["layers"], read["rules"], "r")
    assert len(own.rules) == 5 and [r.allowed for r in own.rules] == [True, False, True, False, False]
    same = policy.rule_delta(read["rules"], read["rules"].where("ordinal <> 4"))
    assert same.collect() == []


def test_snapshots_are_apart(spark, tmp_path):
    doc = lambda s, back: {"repo": "a", "snapshot": s, "schemaVersion": "1.0", "files": [{"path": "src/domain/x.ts"}, {"path": "src/application/y.ts"}],
                           "dependencies": [{"from": "src/domain/x.ts", "target": "src/application/y.ts", "resolution": "resolved-project"}, *([{"from": "src/application/y.ts", "target": "src/domain/x.ts", "resolution": "resolved-project"}] if back else [])]}
    (tmp_path / "f.json").write_text("\n".join(json.dumps(doc(s, s == "2")) for s in ("1", "2", "3")))
    got = src.read_facts(spark, str(tmp_path))
    files = layers.classify_layers(got["files"], FLEET)
    edges = layers.build_edges(got["dependencies"], files)
    assert edges.count() == 4 and edges.where("from_layer is null or to_layer is null").isEmpty()
    cycles = graph.find_cycles(graph.value_graph(got["dependencies"], files))
    assert [(r.repo, r.snapshot, r.members) for r in cycles.collect()] == [("a", "2", "src/application/y.ts,src/domain/x.ts")]
    policies = spark.createDataFrame([("a", "strict")], "repo string, cycle_policy string")
    assert [(r.snapshot, r.blocking) for r in graph.apply_cycle_policy(cycles, policies).collect()] == [("2", True)]
    verdicts = layers.verdict(got["files"].select("repo", "snapshot").distinct(), layers.layer_violations(edges, FLEET))
    assert sorted((r.snapshot, r.n_blocking) for r in verdicts.collect()) == [("1", 1), ("2", 1), ("3", 1)]
    assert {(r.snapshot, r.total) for r in layers.coverage(files, FLEET).collect()} == {("1", 2), ("2", 2), ("3", 2)}


def test_no_weight_lens_or_layer_is_cut_off(spark):
    n = coach.SMALL + 1
    signals = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.lit("s"), "id").alias("signal"), F.lit(1).alias("value"))
    weights = spark.range(n).select(F.concat(F.lit("s"), "id").alias("signal"), F.lit("x").alias("archetype"), F.lit(1).alias("weight"))
    assert coach.archetype_scores(signals, weights).first().score == n
    lenses = spark.range(n).select(F.lit("src").alias("source"), F.concat(F.lit("i"), "id").alias("id"), F.lit("lens").alias("lens"), F.lit(1).cast("long").alias("priority"))
    found = lenses.select(F.lit("r").alias("repo"), "source", "id", F.col("id").alias("evidence"))
    assert coach.compass(found, lenses, signals.select("repo").distinct()).first().n == n
    many = spark.range(12).select(F.lit("r").alias("repo"), F.col("id").alias("ordinal"), F.concat(F.lit("L"), "id").alias("layer"), F.array().cast("array<string>").alias("patterns"), F.array().cast("array<string>").alias("exclude"), F.array().cast("array<string>").alias("prefixes"), F.lit(False).alias("optional"))
    rules = spark.createDataFrame([], "repo string, ordinal long, source string, target string, allowed boolean, peer_isolation boolean, slice_folders array<string>, message string")
    assert len(contracts.as_contract(many, rules, "r", most=12).layers) == 12
    with pytest.raises(ValueError, match="more than 11"):
        contracts.as_contract(many, rules, "r", most=11)
