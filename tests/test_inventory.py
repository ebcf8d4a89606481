"""Rules in scripts: what is a candidate, where, and what is none; functions of the user interface; deltas of rule files."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from archweave.operators import inventory, policy, ui_rules

HANDLER = """
@Controller('orders')
export class OrderHandler {
  create(dto: any) {
    if (dto.amount < 0) throw new BadRequest('bad');
  }
}
"""
SOURCES = "repo string, path string, content string, layer string"


def candidates(spark, files, contexts=None):
    """files: path -> content, or (content, layer)."""
    rows = [("r", p, *(c if isinstance(c, tuple) else (c, None))) for p, c in files.items()]
    table = None if contexts is None else spark.createDataFrame([("r", i, *x) for i, x in enumerate(contexts)], "repo string, ordinal int, layer string, prefixes array<string>")
    return inventory.rule_candidates(spark.createDataFrame(rows, SOURCES), table).orderBy("file", "line").collect()


def test_controllers_and_entities(spark):
    got = candidates(spark, {
        "src/controllers/order.controller.ts": HANDLER.replace("'bad');", "'bad');\n    const MIN_ORDER_TOTAL = 100;"),
        "src/domain/customer.ts": "export class Customer {\n public id: string;\n public name: string;\n}\n",
    })
    assert [(x.kind, x.line, x.name, x.confidence, x.rule_id) for x in got] == [
        ("validation-in-controller", 5, None, "direct-evidence", "INV-EXTRACT-1"),
        ("validation-in-controller", 5, None, "direct-evidence", "INV-EXTRACT-2"),
        ("magic-business-constant", 6, "MIN_ORDER_TOTAL", "heuristic", "INV-MIN_ORDER_TOTAL"),
        ("anemic-entity", 1, "Customer", "heuristic", "no-anemic-model"),
    ]
    assert [x.id for x in got] == ["inv-val-1", "inv-val-2", "inv-magic-3", "inv-anemic-4"]


def test_healthy_domain(spark):
    text = "export class Order {\n private total = 0;\n private constructor() {}\n static create() { return new Order(); }\n add(n: number) { this.total += n; this.ensureInvariants(); }\n ensureInvariants() { if (this.total < 0) throw new Error(); }\n}\n"
    assert candidates(spark, {"src/domain/order.ts": text}) == []


def test_layers_before_names(spark):
    got = candidates(spark, {"src/domain/order-handler.ts": (HANDLER, "DomainModel"), "src/http/order-handler.ts": (HANDLER, "FrameworkAdapters")})
    checks = [x for x in got if x.kind == "validation-in-controller"]
    assert {(x.file, x.layer) for x in checks} == {("src/http/order-handler.ts", "FrameworkAdapters")} and len(checks) == 2


def test_layers_by_their_intents(spark):
    files = {
        "src/core/order.ts": ("export const MAX_CART_SIZE = 50;\nexport class Order {\n public id: string;\n public status: string;\n}\n", "core"),
        "src/entry/order-handler.ts": ("export function handle(input: { amount: number }) {\n if (input.amount < 0) throw new Error('x');\n}\n", "entry"),
    }
    got = candidates(spark, files, [("core", ["Domain."]), ("entry", [" Application. "])])
    assert [(x.kind, x.layer, x.suggested_layer) for x in got] == [("magic-business-constant", "core", "core"), ("anemic-entity", "core", "core"), ("validation-in-controller", "entry", "core"), ("validation-in-controller", "entry", "core")]
    assert candidates(spark, files, [("core", ["Kernel."]), ("entry", [])]) == []


def test_constants_that_are_none(spark):
    text = """export const DEV_USER_ID = 'developer-user-0001';
export const POSTGRES_NUMERIC_OID = 1700;
export const TIMESTAMPTZOID = 1184;
const GREETING = 'please try again';
const RETRY_COPY = 'again_and_again';
const DONE = 'finished.';
const ORDER_STATE = 'open or paid';
export const MAX_CART_SIZE = 50;
"""
    assert [x.name for x in candidates(spark, {"src/domain/pricing.ts": (text, "DomainModel")})] == ["ORDER_STATE", "MAX_CART_SIZE"]
    assert candidates(spark, {"bin/run.mjs": (text, "Tooling")}) == []
    assert candidates(spark, {"src/clients/pricing.ts": text, "src/ui/pricing.ts": text}) == []
    assert [x.name for x in candidates(spark, {"lib/pricing.ts": text})] == ["ORDER_STATE", "MAX_CART_SIZE"]


def test_files_that_are_no_pilots(spark):
    paths = ("src/exclusions/a.controller.ts", "src/fixtures/a.controller.ts", "src/db/seed.ts", "src/a.controller.spec.ts", "tests/handler.ts")
    assert candidates(spark, {p: (HANDLER, "FrameworkAdapters") for p in paths}) == []
    mirror = "/** GENERATED FILE — do not edit by hand. */\nexport const MAX_CART_SIZE = 50;\n"
    assert candidates(spark, {"src/domain/mirror.ts": mirror}) == []
    assert len(candidates(spark, {"src/domain/mirror.ts": " " * 400 + mirror})) == 1


def test_mutations(spark):
    error = "export class ConfigError extends Error {\n constructor(s) {\n super(s);\n this.name = 'ConfigError';\n }\n}\n"
    plain = "export class Cart {\n set(n) {\n this.total = n;\n this.more = n;\n }\n}\n"
    far = plain + " " * 200 + "validate()"
    got = candidates(spark, {f"src/domain/{k}.ts": v for k, v in {"error": error, "plain": plain, "both": error + plain, "near": plain + "validate()", "far": far, "errors/a": plain}.items()})
    assert [(x.file, x.line) for x in got] == [("src/domain/both.ts", 9), ("src/domain/far.ts", 3), ("src/domain/plain.ts", 3)]
    assert {x.kind for x in got} == {"mutation-without-guard"}


def test_odd_rows(spark):
    rows = [("r", "src/domain/a.ts", None, None), ("r", "src/domain/b.ts", "", None), ("r", None, HANDLER, None), ("r", ".\\src\\domain\\c.ts", "const MAX_A = 10;", None), ("s", "src/domain/c.ts", "\nconst MAX_A = 10;", None), ("s", "src/domain/c.ts", "\nconst MAX_A = 10;", None)]
    got = inventory.rule_candidates(spark.createDataFrame(rows, SOURCES))
    assert sorted((x.repo, x.file, x.line, x.id) for x in got.collect()) == [("r", ".\\src\\domain\\c.ts", 1, "inv-magic-1"), ("s", "src/domain/c.ts", 2, "inv-magic-1"), ("s", "src/domain/c.ts", 2, "inv-magic-2")]
    assert inventory.rule_candidates(spark.createDataFrame([], SOURCES)).count() == 0
    known = spark.createDataFrame([("r", "INV-MAX_A"), ("r", "INV-MAX_A"), ("t", "INV-MAX_A")], "repo string, rule_id string")
    assert sorted(map(tuple, inventory.rules_inventory(got, known).collect())) == [("r", 1, 1), ("s", 2, 0)]


def test_snapshots_are_numbered_apart(spark):
    rows = [("r", s, "src/domain/a.ts", "const MAX_A = 10;", None) for s in ("s1", "s2")]
    got = inventory.rule_candidates(spark.createDataFrame(rows, "repo string, snapshot string, path string, content string, layer string"))
    assert sorted((x.snapshot, x.id) for x in got.collect()) == [("s1", "inv-magic-1"), ("s2", "inv-magic-1")]


def rules(text):
    return [(name, kind, n, detail) for _, name, kind, n, detail in ui_rules.rules_of(text)]


def test_rules_in_functions():
    assert rules("function canPay(o) { return o.total > 3 && !o.paid }") == [("canPay", "authorization-policy-rule", 2, "comparisons:1;logical:1;predicates:0;arithmetic:0")]
    assert rules("const shouldShip = async (o: Order): Promise<boolean> => o.items.some((x) => x.n >= 2);\nconst n = 1 < 2") == [("shouldShip", "authorization-policy-rule", 2, "comparisons:1;logical:0;predicates:1;arithmetic:0")]
    assert rules("const canGo = o => o.a\n  && o.b\nconst x = a || b") == [("canGo", "authorization-policy-rule", 1, "comparisons:0;logical:1;predicates:0;arithmetic:0")]
    assert rules("class A { private calculateTax(a: number): number { /* a + b */ return -a * 2 + '1 + 1' + `${a - 1}` } }") == [("calculateTax", "calculation-rule", 3, "comparisons:0;logical:0;predicates:0;arithmetic:3")]
    assert rules("const refundPolicy = function named(o) { return new Set<string>(o).has('a') || 'k' in o }") == [("refundPolicy", "authorization-policy-rule", 3, "comparisons:1;logical:1;predicates:1;arithmetic:0")]


def test_functions_that_hold_no_rule():
    for text in (
        "if (canPay(o)) { a > b }",
        "const x = ok ? canPay(o) : { a: 1 > 2 };",
        "new CanPolicy(a) ; { a > b }",
        "const canPay = build(a > b);",
        "function canRenderTab(o) { return o > 1 }",
        "function canPay(o) { return <b>{o > 1}</b> }",
        "function canPay(o) { navigate('/'); return o > 1 }",
        "function canPay(o) { return useOrder(o) > 1 }",
        "function canPay(o) { for (const k in o) { go(k) } }",
        "function canPay(o) { const i = 1; i++; i += 2; return (x) => x }",
        "function computeTotal(o) { return o > 1 }",
        "// function canPay(o) { return o > 1 }",
        "x.canPay(a) ; type canPay = (a) => b",
        "function canPay(o",
    ):
        assert rules(text) == [], text


def test_ui_findings(spark):
    text = "\nexport function canPay(o) { return o > 1 }\n"
    rows = [("r", "src/components/a.tsx", text, None), ("r", "src/a.ts", text, "PresentationAdapters"), ("r", "src/b.ts", text, "DomainModel"), ("r", "app/api/a.ts", text, None), ("r", "app/x/a.mjs", text, None), ("r", "ui/a.d.ts", text, None), ("r", "ui/a.css", text, None), ("r", "ui/n.ts", None, None), (None, "./ui\\t.js", text, None)]
    got = ui_rules.ui_rule_findings(spark.createDataFrame(rows, SOURCES))
    assert sorted((x.path, x.line, x.symbol, x.magnitude) for x in got.collect()) == [(p, 2, "canPay", 1) for p in ("app/x/a.mjs", "src/a.ts", "src/components/a.tsx", "ui/t.js")]
    mark = got.where("path = 'src/a.ts'").first().fingerprint
    assert mark == "sha256:" + hashlib.sha256(b"domain-logic-in-ui|src/a.ts|canPay|authorization-policy-rule").hexdigest()
    assert ui_rules.ui_rule_findings(spark.createDataFrame([], SOURCES)).count() == 0


def test_ui_design_delta(spark):
    """A function that moves is no change, one that grows on a touched path is worse, another's path isn't looked at."""
    make = lambda **files: spark.createDataFrame([("r", f"ui/{k}.ts", v, None) for k, v in files.items()], SOURCES)
    base = make(a="function canPay(o) { return o > 1 }", b="function shouldGo(o) { return o > 1 }", c="function canWait(o) { return o > 1 }")
    now = make(z="function canPay(o) { return o > 1 }", b="function shouldGo(o) { return o > 1 && o < 9 }", c="function canWait(o) { return o > 1 && o }", d="function canStay(o) { return !o || o > 2 }")
    touched = spark.createDataFrame([("r", f"ui/{k}.ts") for k in "zbd"], "repo string, path string")
    got = ui_rules.ui_design_delta(base, now, touched)
    assert sorted((x.path, x.symbol, x.change) for x in got.collect()) == [("ui/b.ts", "shouldGo", "worsened"), ("ui/d.ts", "canStay", "new")]


def test_rule_files(spark):
    def side(files, structure, invariants):
        make = lambda rows, schema: spark.createDataFrame([("r", *x) for x in rows], "repo string, layer string, " + schema)
        return {"rule_files": make(files, "file string"), "structure": make(structure, "rule string, sensor string, mode string"), "invariants": make(invariants, "rule string, mode string")}

    before = side([("A", "a.json"), ("B", "b.json")], [("A", "s1", "x", "advisory"), ("A", "s2", "x", "enforced"), ("A", "s3", "x", "advisory")], [("A", "i1", "advisory"), ("A", "i2", "advisory"), ("A", "i3", "enforced"), ("A", "i4", "advisory"), ("A", "same", "advisory")])
    after = side([("A", "c.json"), ("C", "c.json")], [("A", "s1", "y", "enforced"), ("A", "s2", "x", "advisory"), ("B", "s3", "x", "advisory")], [("A", "i1", "enforced"), ("A", "i2", "enforced"), ("A", "i3", "advisory"), ("A", "i5", "enforced"), ("A", "same", "advisory")])
    coverage = spark.createDataFrame([("r", "i1", True, False), ("r", "i2", True, True), ("q", "i2", True, False)], "repo string, invariant string, covered boolean, partial boolean")
    want = {
        ("$.ruleFiles[A]", "judgment-required", "rule-file-moved"), ("$.ruleFiles[B]", "weakening", "rule-file-removed"), ("$.ruleFiles[C]", "strengthening", "rule-file-added"),
        ("$.rules.structure[A::s1].mode", "strengthening", "structure-promoted"), ("$.rules.structure[A::s1].sensor", "judgment-required", "sensor-changed"), ("$.rules.structure[A::s2].mode", "weakening", "structure-demoted"),
        ("$.rules.structure[A::s3]", "weakening", "structure-removed"), ("$.rules.structure[B::s3]", "strengthening", "structure-added"),
        ("$.rules.invariants[A::i1].mode", "strengthening", "invariant-promoted"), ("$.rules.invariants[A::i2].mode", "judgment-required", "invariant-promotion-refused"), ("$.rules.invariants[A::i3].mode", "weakening", "invariant-demoted"),
        ("$.rules.invariants[A::i4]", "weakening", "invariant-removed"), ("$.rules.invariants[A::i5]", "strengthening", "invariant-added"),
    }
    assert {tuple(x)[1:] for x in policy.rule_file_delta(before, after, coverage).collect()} == want
    refused = policy.rule_file_delta(before, after).where(F.col("kind") == "invariant-promotion-refused")
    assert sorted(x.path for x in refused.collect()) == ["$.rules.invariants[A::i1].mode", "$.rules.invariants[A::i2].mode"]
    assert policy.rule_file_delta(after, after).count() == 0
