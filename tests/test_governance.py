"""Small known cases of walls, scans, plans, cycles and ranks; brute force where SQL can't say it."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from archweave.contract import FLEET, WALLED, Contract, Layer, Rule
from archweave.functions.names import stable_hash
from archweave.functions.paths import is_canonical_path, scan_excluded
from archweave.operators import cohesion, events, experiments, graph, health, layers, plans, quantiles, scan, walls
from archweave.sources import contracts


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_module_and_ambient_capabilities(spark):
    names = ["fs", "fs/promises", "pg", "pg/lib/x", "pgn-parser", "@prisma/client", "@prisma/client/edge/x", "@prisma/other", "./fs", "/fs", "", "node:http", "child_process"]
    assert values(spark, walls.module_capability(F.col("x")), names) == ["filesystem", "filesystem", "persistence", "persistence", None, "persistence", "persistence", None, None, None, None, "network", "process"]
    assert values(spark, walls.ambient_capability(F.col("x")), ["Date", "Date.now", "process.env.A", "process.cwd", "Dated", "Math", "Math.random"]) == ["clock", "clock", "environment", "process", None, None, "randomness"]


def test_forbidden_entries_match_whole_segments_and_the_longest_wins(spark):
    entries = F.array(F.lit("process"), F.lit("process.env"), F.lit("Date"))
    assert values(spark, walls.forbidden_entry(F.col("x"), entries), ["process.env.A", "process.cwd", "Dated", "Date", "fetch"]) == ["process.env", "process", None, "Date", None]


def test_specifiers(spark):
    files = spark.createDataFrame([("r", p) for p in ("src/a.ts", "src/b/index.tsx", "src/b.mts", "c", "lib/d.ts")], "repo string, path string")
    asked = [("src/x.ts", "./a"), ("src/x.ts", "./b"), ("src/b/y.ts", "../../c"), ("src/x.ts", "../../../lib/d"), ("src/x.ts", "./none"), ("src/x.ts", "pg"), ("src/q/x.ts", "../b/")]
    df = spark.createDataFrame([("r", f, i, s) for i, (f, s) in enumerate(asked)], "repo string, file string, ordinal int, specifier string")
    got = [r.to_path for r in walls.resolve_specifiers(df, files).orderBy("ordinal").collect()]
    assert got == ["src/a.ts", "src/b.mts", "c", "lib/d.ts", None, None, "src/b.mts"]


def test_imports(spark):
    text = """import a from "x"; import type {T} from './t'; import { type A, type B as C } from 'tt'; import { type D, E } from 'mix';
// import no from 'no'
const s = "import z from 'q'"; const r = require('pg'); x.require('no'); y ?. require('no')
export * from './e'; export type { X } from './xt'; export const q = 1;
import('dyn'); import './side'; `require('no')`; import type, { Q } from 'deft'; import { type } from 'bind'; import { type as w } from 'as';
/* import no from 'no' */ import e = require("eq"); import("a\\'b")"""
    df = spark.createDataFrame([("r", "f.ts", text), ("r", "n.ts", None), ("r", "e.ts", "import x from 'open")], "repo string, path string, content string")
    got = [(r.specifier, r.type_only, r.require_call, r.line) for r in scan.extract_imports(df).orderBy("ordinal").collect()]
    want = [("x", 0, 0, 1), ("./t", 1, 0, 1), ("tt", 1, 0, 1), ("mix", 0, 0, 1), ("pg", 0, 1, 3), ("./e", 0, 0, 4), ("./xt", 1, 0, 4), ("dyn", 0, 0, 5), ("./side", 0, 0, 5), ("deft", 0, 0, 5), ("bind", 0, 0, 5), ("as", 0, 0, 5), ("eq", 0, 0, 6), ("a'b", 0, 0, 6)]
    assert got == [(s, bool(t), bool(c), n) for s, t, c, n in want]


def test_class_shapes():
    text = """export class Order extends Base { public readonly id: string; public count = 0; rename(n) { this.name = n; }
 pay(x) { this.x = x; publish(x) }
 constructor(a) {} }
export class Bag { a: string; b: number; }
class Hidden { public x = 1 }
export abstract class Sealed { private constructor() {}
 static of(x) { return 1 } }"""
    got = {s["class_name"]: s for s in scan.class_shapes_of(text)}
    assert set(got) == {"Order", "Bag", "Sealed"}
    assert got["Order"]["public_mutable"] and got["Order"]["public_constructor"] and [m["guarded"] for m in got["Order"]["mutating"]] == [True]
    assert got["Bag"]["data_only"] and not got["Bag"]["public_constructor"]
    assert got["Sealed"]["static_factory"] and not got["Sealed"]["public_constructor"] and not got["Sealed"]["public_mutable"]


def test_members_are_read_in_order_whatever_they_hold():
    text = """export class Order<T> extends Base<T> implements I {
  public status: string = 'new }';
  private total = 0; static MAX = 3; #secret = 1
  tags: string[] = [
    'a', 'b' ]
  constructor(private readonly id: string) {}
  get label(): string { return `x { ${this.id}`; }
  protected set state(v: string) { this.status = v; }
  cancel(): { ok: boolean } {
    this.status = "cancelled }"; // {
    return { ok: true };
  }
  abstract run(x: T): void;
  static async make<U>(x: U): Promise<U> { return x }
} export class Dto { id: string = ''
  name: string }"""
    members = list(scan.members_of(text, text.index("{") + 1))
    assert [(m.name, m.kind) for m in members] == [("status", "field"), ("total", "field"), ("MAX", "field"), ("#secret", "field"), ("tags", "field"), ("constructor", "constructor"), ("label", "get"), ("state", "set"), ("cancel", "method"), ("run", "method"), ("make", "method")]
    assert [m.name for m in members if m.mutable] == ["status", "tags"]
    order, dto = scan.class_shapes_of(text)
    assert (order["public_setters"], order["static_factory"], [m["name"] for m in order["mutating"]], order["data_only"]) == (False, True, ["cancel"], False)
    assert dto["data_only"] and dto["class_name"] == "Dto"
    assert list(scan.class_shapes_of("export class Open { a: string")) and list(scan.class_shapes_of("")) == []


def test_peer_rules_take_folders_from_globs(spark):
    contract = Contract((Layer("F", ("src/features/**", "src/{a,b}/**")),), (Rule("F", "F", peer_isolation=True),))
    assert layers.inferred_folders(contract, "F") == ("features",)
    rows = [("src/features/a/x.ts", "src/features/a/y.ts"), ("src/features/a/x.ts", "src/features/b/y.ts"), ("src/other.ts", "src/features/a/y.ts")]
    df = spark.createDataFrame([(*r, "F", "F") for r in rows], "from_path string, to_path string, from_layer string, to_layer string")
    assert [r.d for r in df.select(layers.denying_rule(contract).isNotNull().alias("d")).collect()] == [False, True, True]


def test_layers_at_event_time_go_by_their_longest_prefix(spark):
    prefixes = {"Short": ("Domain.Order.",), "Long": ("Domain.User.Registered.Fully.", "Domain.")}
    assert values(spark, events.event_layer(F.col("x"), prefixes), ["Domain.Order.Placed", "Domain.X", "Other.X"]) == ["Long", "Long", None]


def test_paths(spark):
    assert values(spark, is_canonical_path(F.col("x")), ["a/b.ts", "./a", "/a", "C:/a", "a//b", "../a", "a/../b", "", "a\0b"]) == [True, *[False] * 8]
    assert values(spark, scan_excluded(F.col("x"), ("dist/**",)), ["a.gen.ts", "x/y.generated.tsx", "dist/a.ts", "src/a.ts"]) == [True, True, True, False]


def test_hash_of_characters_beyond_the_basic_plane(spark):
    def reference(text):
        h = 2166136261
        for unit in memoryview(text.encode("utf-16-le")).cast("H"):
            h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
        return f"fnv1a-{h:08x}"

    texts = ["", "plain", "é日本", "a😀b", "𝔘𐐷"]
    assert values(spark, stable_hash(F.col("x")), texts) == [reference(t) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_cycles_by_joins_are_those_of_one_task(spark, seed):
    rnd = random.Random(seed)
    rows = {(f"r{rnd.randint(0, 2)}", f"n{rnd.randint(0, 40):02}", f"n{rnd.randint(0, 40):02}") for _ in range(110)}
    rows |= {("chain", f"c{i:02}", f"c{i + 1:02}") for i in range(12)} | {("ring", f"c{i}", f"c{(i + 1) % 9}") for i in range(9)}
    df = spark.createDataFrame([r for r in rows if r[1] != r[2]], "repo string, from_path string, to_path string")
    one = sorted(map(tuple, graph.find_cycles(df).collect()))
    assert sorted(map(tuple, graph.find_cycles(df, one_task=0).collect())) == one and any(r[0] == "ring" and r[2] == 9 for r in one)


def test_ranks_without_sorting_rows(spark):
    rnd = random.Random(4)
    rows = [(k, v) for k in "ab" for v in ([7] * 500 + [rnd.randint(-(10**9), 10**9) for _ in range(301)] + [None])] + [("c", 5)]
    df = spark.createDataFrame(rows, "k string, v long")
    own = {k: sorted(v for a, v in rows if a == k and v is not None) for k in "abc"}
    counts = quantiles.value_counts(df, ["k"], "v")
    for rank in (1, 2, 150, 400, 801):
        got = {r.k: r.x for r in counts.groupBy("k").agg(quantiles.at_rank("v", F.lit(rank)).alias("x")).collect()}
        assert got == {k: v[rank - 1] if rank <= len(v) else None for k, v in own.items()}
    assert {r.k: r.median for r in quantiles.medians(df, ["k"], "v").collect()} == {k: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for k, v in own.items()}


def test_bootstrap_covers_all_levels(spark):
    rnd = random.Random(1)
    rows = [(r * 100 + t * 10 + i, r, t, 1000 + rnd.randint(0, 400), 700 + rnd.randint(0, 400)) for r in range(4) for t in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "pair_id long, repository_id long, task_id long, control_ms long, treatment_ms long")
    a = experiments.paired_bootstrap(df, 200).first()
    assert a == experiments.paired_bootstrap(df.repartition(7), 200).first()
    assert a.lower < a.estimate < a.upper and 0.6 < a.lower and a.upper < 0.95
    lone = experiments.paired_bootstrap(df.where("pair_id = 0"), 20).first()
    assert lone.lower == lone.upper == lone.estimate
    # One task: only replicates are left to vary.
    inner = experiments.paired_bootstrap(df.where("repository_id = 0 and task_id = 0"), 200).first()
    assert inner.lower < inner.upper


def test_patches_fill_and_never_overwrite(spark):
    cases = [('{"a":1}', '{"b":{"c":[1]}}', {"a": 1, "b": {"c": [1]}}, None), ('{"a":{"x":1}}', '{"a":{"y":2}}', {"a": {"x": 1, "y": 2}}, None), ('{"a":[1]}', '{"a":[1]}', {"a": [1]}, "payload.a[0]"), ('{"a":[{"x":1}]}', '{"a":[{"y":2},3]}', {"a": [{"x": 1, "y": 2}, 3]}, None), (None, '{"a":1}', {"a": 1}, None), ("[1]", '{"a":1}', [1], "payload"), ("{}", None, {}, None)]
    df = spark.createDataFrame([(i, p, q) for i, (p, q, *_) in enumerate(cases)], "i int, payload string, patch string")
    got = events.apply_payload_patch(df, F.col("patch")).orderBy("i").collect()
    assert [(json.loads(r.payload), r.conflict) for r in got] == [(want, c) for *_, want, c in cases]


def test_decisions_and_dates(spark):
    acks = [("s", "a->b", "2020-01-01"), ("s", "a->b", None), ("s", "c->d", "2030-02-30"), ("s", "e->f", "2030-01-01"), ("contract-bidirectional-allow", "y <-> x", None), ("contract-bidirectional-allow", "a<->b<->c", None)]
    df = spark.createDataFrame([("r", *a) for a in acks], "repo string, smell string, edge string, review_by string")
    assert {r.edge: r.status for r in health.acknowledged(df, "2026-01-01").collect()} == {"a->b": "expired", "c->d": "malformed", "e->f": "current", "x<->y": "undated"}


@pytest.mark.parametrize(
    ("path", "want"),
    [("src/billing/InvoiceService.ts", ("invoice", "src/billing")), ("app/orders/page.tsx", ("orders", "app")), ("src/app/(shop)/[id]/route.ts", None), ("useX.ts", None), ("a/getUserProfile.ts", ("user", "a")), ("README.md", None), ("order.ts", ("order", "."))],
)
def test_concepts(spark, path, want):
    got = values(spark, cohesion.classify_physical(F.col("x")), [path])[0]
    assert (tuple(got) if got else None) == want


def test_contracts_of_several_repositories(spark, tmp_path):
    docs = [{"repo": "a", "layers": [{"name": "L", "patterns": ["x/**"], "forbiddenGlobals": ["Date"]}], "rules": [{"from": "L", "to": "L", "allowed": False, "peerIsolation": True}, {"from": "L", "to": "L", "allowed": True}]}, {"repo": "b", "layers": []}]
    (tmp_path / "c.json").write_text("\n".join([*map(json.dumps, docs), "{broken", '{"layers": []}']))
    got = contracts.read_contract(spark, str(tmp_path))
    rules = got["rules"].groupBy("repo").count().collect()
    assert {r.repo: r["count"] for r in rules} == {"a": 2, "b": 105} and len(contracts.default_rules()) == 105
    assert sorted(r.reason for r in got["rejects"].collect()) == ["no-repo", "not-json"]
    own = contracts.as_contract(got["layers"], got["rules"], "a")
    assert own.rules == (Rule("L", "L", peer_isolation=True), Rule("L", "L", allowed=True)) and own.layers[0].patterns == ("x/**",)


def test_moved_findings_are_not_new(spark):
    schema = "repo string, path string, smell string, symbol string, kind string, magnitude int"
    base = spark.createDataFrame([("r", "a.ts", "s", "f", "k", 3), ("r", "b.ts", "s", "g", "k", 1)], schema)
    now = spark.createDataFrame([("r", "moved.ts", "s", "f", "k", 3), ("r", "b.ts", "s", "g", "k", 2), ("r", "c.ts", "s", "h", "k", 1)], schema)
    assert sorted((r.path, r.change) for r in plans.design_delta(base, now, now.select("repo", "path")).collect()) == [("b.ts", "worsened"), ("c.ts", "new")]


def test_a_pure_layer_denies_every_capability():
    pure = next(x for x in WALLED.layers if x.pure)
    assert len(walls.denied_capabilities(pure)) == 7 and walls.denied_capabilities(FLEET.layers[0]) == []


def test_acknowledgement_files_and_audit_trails(spark, tmp_path):
    (tmp_path / "acks").mkdir()
    for name, acks in {"good": [{"id": "s", "edge": "a->b"}], "bad": [{"id": "s", "edge": " "}, {"id": "s", "edge": "c->d"}], "none": None}.items():
        (tmp_path / "acks" / f"{name}.json").write_text(json.dumps({"repo": name, "acks": acks}))
    (tmp_path / "acks" / "broken.json").write_text("{")
    assert [(r.repo, r.edge) for r in contracts.read_acks(spark, str(tmp_path / "acks")).collect()] == [("good", "a->b")]
    rows = spark.sql("SELECT timestamp '2026-01-01 10:00:00' AS occurred_at, 1 AS event_id, 'x' AS kind UNION ALL SELECT timestamp '2026-01-02 10:00:00', 2, 'y'")
    for _ in range(2):
        contracts.append_audit(rows, str(tmp_path / "audit"))
    back = spark.read.parquet(str(tmp_path / "audit"))
    assert back.count() == 4 and "day" in back.columns
    assert [r.event_id for r in events.audit_query(back, since=F.lit("2026-01-02"), limit=1, kind="y").collect()] == [2]


def test_ledgers_and_snapshots(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(json.dumps({"ledger": "l", "sequence": i, "previousHash": "p", "entryHash": "e", "cellId": f"c{i}"}) for i in (1, 2)))
    assert [(r.sequence, r.cell_id) for r in contracts.read_ledger(spark, str(tmp_path / "l.json")).orderBy("sequence").collect()] == [(1, "c1"), (2, "c2")]
    shots = spark.createDataFrame([("r", t) for t in range(9)], "repo string, ts long")
    contracts.append_snapshot(shots, str(tmp_path / "s"))
    assert sorted(r.ts for r in contracts.retained_snapshots(spark.read.parquet(str(tmp_path / "s")), 3).collect()) == [0, 6, 7, 8]
