"""Registered queries over the contents of scripts: rules without a contract, rules in the user interface; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave.contract import FLEET, WALLED
from archweave.derive import facts, with_views
from archweave.jobs.oracle_governance import _base
from archweave.operators import inventory, layers, policy, structure, ui_rules
from archweave.sources.contracts import contract_tables

Query = Callable[[SparkSession, str], DataFrame]

#: Code in front of a script's own, by ordinal.
_HELD = """concat(CASE ordinal % 6 WHEN 0 THEN concat('@Controller(1)', chr(10), 'if (dto.amount < 0) throw new Error(1);', chr(10))
 WHEN 1 THEN concat('export const MAX_CART_SIZE = 50;', chr(10), 'const API_TIMEOUT = 5000;', chr(10), 'const GREETING = "hello dear reader";', chr(10), 'const ORDER_STATUS_OPEN = "open orders";', chr(10))
 WHEN 2 THEN concat('// data', chr(10), 'export class Order {', chr(10), ' public id: string;', chr(10), ' public state: string;', chr(10), '}', chr(10))
 WHEN 3 THEN concat('class Cart {', chr(10), ' add(n) {', chr(10), '  this.total = n; } }', chr(10))
 WHEN 4 THEN concat('class CartError extends Error {', chr(10), ' constructor() { this.name = 1; } }', chr(10))
 ELSE concat('class Bag { add(n) { this.n = n; validate(n) } }', chr(10)) END, content)"""
_SHOWN = """concat(CASE ordinal % 4 WHEN 0 THEN concat('export const canEdit = (u) => u.roles.includes(1) && u.age >= 18;', chr(10))
 WHEN 1 THEN concat('function computeTotal(a, b) {', chr(10), '  // a < b', chr(10), '  return a.price * b.n + 1;', chr(10), '}', chr(10))
 WHEN 2 THEN concat('class A {', chr(10), ' shouldRefund(o): boolean { return o.n > 3 || !o.open } }', chr(10))
 ELSE concat('const shouldGo = (x) => { navigate(x); return x > 1 };', chr(10)) END, content)"""
#: The candidate of a change: functions of some files are gone, have moved, or hold more.
_CHANGED = "CASE ordinal % 5 WHEN 0 THEN replace(content, '&& u.age >= 18', '') WHEN 1 THEN replace(content, 'return a.price * b.n + 1', 'return a.price * b.n * 2 + 1') WHEN 2 THEN replace(content, 'shouldRefund', 'shouldPayBack') ELSE content END"


def _sources(spark: SparkSession, sf: str, content: str) -> DataFrame:
    return layers.classify_layers(facts(spark, sf, "sources"), FLEET).withColumn("content", F.expr(content))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    sources = _sources(spark, sf, _HELD)
    contexts = contract_tables(FLEET, facts(spark, sf, "code_files").select("repo").distinct())["layers"]
    return inventory.rule_candidates(sources, contexts)


def rule_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf)


def rules_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Against a contract that has the tenth validation of each repository, one constant, and no anemic models."""
    repos = facts(spark, sf, "code_files").select("repo").distinct()
    contracted = repos.select("repo", F.explode(F.array(*map(F.lit, ("INV-EXTRACT-10", "INV-MAX_CART_SIZE", "no-anemic-model", "INV-1")))).alias("rule_id"))
    return inventory.rules_inventory(_candidates(spark, sf), contracted)


def ui_rule_findings(spark: SparkSession, sf: str) -> DataFrame:
    return ui_rules.ui_rule_findings(_sources(spark, sf, _SHOWN))


def ui_design_delta(spark: SparkSession, sf: str) -> DataFrame:
    base = _sources(spark, sf, _SHOWN)
    return ui_rules.ui_design_delta(base, base.withColumn("content", F.expr(_CHANGED)), base.select("repo", "path"))


def _rule_files(spark: SparkSession, sf: str, candidate: bool) -> dict[str, DataFrame]:
    """A rule for each file of domain, kernel and lib; which rules a side has, and how, goes by ordinal."""
    rows = facts(spark, sf, "code_files").select("repo", F.split("path", "/")[1].alias("layer"), F.concat(F.lit("R"), "ordinal").alias("rule"), F.col("ordinal").alias("o"))
    own = rows.where("layer in ('domain', 'kernel', 'lib')").where("o % 11 <> 0" if candidate else "o % 7 <> 0")
    mode = F.when(F.col("o") % (3 if candidate else 5) == 0, "enforced").otherwise("advisory")
    sensor = F.when((F.col("o") % 13 == 0) & F.lit(candidate), "thin-adapter").otherwise("no-anemic-model")
    file = F.concat(F.lit("rules/"), "layer", F.when((F.col("layer") == "lib") & F.lit(candidate), ".v2.json").otherwise(".json"))
    files = own.select("repo", "layer", file.alias("file")).distinct().where("layer <> 'kernel'" if candidate else "layer <> 'domain' or repo <> 'src1'")
    return {
        "rule_files": files,
        "structure": own.where("o % 2 = 0").select("repo", "layer", "rule", sensor.alias("sensor"), mode.alias("mode")),
        "invariants": own.where("o % 2 = 1").select("repo", "layer", "rule", mode.alias("mode")),
    }


def rule_file_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence is there for two thirds of the rules, and partial for a quarter of those."""
    files = facts(spark, sf, "code_files").where("ordinal % 9 <> 3")
    coverage = files.select("repo", F.concat(F.lit("R"), "ordinal").alias("invariant"), (F.col("ordinal") % 3 == 0).alias("covered"), (F.col("ordinal") % 4 == 1).alias("partial"))
    return policy.rule_file_delta(_rule_files(spark, sf, False), _rule_files(spark, sf, True), coverage)


def promoted_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """The fleet's invariants, advisory before and enforced now, against the evidence that the repositories' scripts hold."""
    repos = facts(spark, sf, "code_files").select("repo").distinct()
    side = lambda mode: repos.select("repo", F.explode(F.array(*[F.struct(F.lit(i.layer).alias("layer"), F.lit(i.id).alias("rule")) for i in WALLED.invariants])).alias("x")).select("repo", "x.*", F.lit(mode).alias("mode"))
    none = {"rule_files": repos.select("repo", F.lit("L").alias("layer"), F.lit("rules.json").alias("file")), "structure": side("enforced").withColumn("sensor", F.lit("no-anemic-model")).where("false")}
    coverage = structure.invariant_coverage(facts(spark, sf, "sources"), WALLED)
    return policy.rule_file_delta(none | {"invariants": side("advisory")}, none | {"invariants": side("enforced")}, coverage)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (rule_candidates, rules_inventory, ui_rule_findings, ui_design_delta, rule_file_delta, promoted_invariants)}


_CONTROLLER = "(regexp_matches(content, '@(Controller|Get|Post|Put|Delete|Patch)\\b') OR regexp_matches(content, '\\bexport\\s+(async\\s+)?function\\s+(GET|POST|PUT|DELETE|PATCH)\\b'))"
_CHECK = "\\b(if\\s*\\([^)]{0,80}(amount|total|price|qty|quantity|balance)[^)]{0,40}\\)|throw new (Error|BadRequest|ValidationError)|z\\.object\\(|yup\\.|class-validator|@Is[A-Z])"
_CONSTANT = """\\b(const|let)\\s+([A-Z][A-Z0-9_]{2,})\\s*=\\s*(\\d{2,}|["''][^"'']{8,}["''])"""
_LINE = "1 + len(regexp_extract_all(array_to_string(p[:n], '') || array_to_string(m[:n - 1], ''), '\\n'))"
_FOUND = f"""{_base('sources')}, t AS (SELECT s.repo, s.path, s.ordinal, {_HELD.replace('content)', 's.content)').replace('ordinal', 's.ordinal')} AS content, c.layer FROM sources s JOIN classified c ON c.repo = s.repo AND c.path = s.path),
 role AS (SELECT *, regexp_matches(path, '/ui/') AS ui, {_CONTROLLER} AND (layer IS NULL OR layer IN ('ApplicationOrchestration', 'PersistenceAdapters', 'PresentationAdapters')) AS controller,
  CASE WHEN layer IS NULL THEN regexp_matches(path, '(?i)domain|entity|aggregate|model') ELSE layer = 'DomainModel' END AS domain FROM t),
 hits AS (SELECT *, 1 AS o, regexp_extract_all(content, '{_CHECK}') AS m, string_split_regex(content, '{_CHECK}') AS p FROM role WHERE controller AND NOT ui
  UNION ALL SELECT *, 2, regexp_extract_all(content, '{_CONSTANT}'), string_split_regex(content, '{_CONSTANT}') FROM role WHERE domain OR ((layer IS NULL OR controller) AND NOT ui AND NOT regexp_matches(path, '/adapters/'))),
 placed AS (SELECT repo, path, layer, o, n, {_LINE} AS line, regexp_extract(m[n], '(const|let)\\s+([A-Z0-9_]+)', 2) AS name FROM (SELECT *, unnest(range(1, len(m) + 1)) AS n FROM hits)),
 every AS (SELECT repo, path, layer, o, n, line, CASE WHEN o = 2 THEN name END AS name FROM placed WHERE o = 1 OR name IN ('MAX_CART_SIZE', 'ORDER_STATUS_OPEN')
  UNION ALL SELECT repo, path, layer, 3, 1, 2, 'Order' FROM role WHERE domain AND ordinal % 6 = 2 UNION ALL SELECT repo, path, layer, 4, 1, 3, NULL FROM role WHERE domain AND ordinal % 6 = 3),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, o, n) AS seq FROM every),
 found AS (SELECT repo, 'inv-' || (['val', 'magic', 'anemic', 'mut'])[o] || '-' || seq AS id, (['validation-in-controller', 'magic-business-constant', 'anemic-entity', 'mutation-without-guard'])[o] AS kind, path AS file, line,
  CASE WHEN o = 1 THEN 'direct-evidence' ELSE 'heuristic' END AS confidence, layer, 'DomainModel' AS suggested_layer, CASE o WHEN 1 THEN 'INV-EXTRACT-' || seq WHEN 2 THEN 'INV-' || name WHEN 3 THEN 'no-anemic-model' ELSE 'events-on-mutation' END AS rule_id, name FROM numbered)"""


def _shown(name: str, content: str) -> str:
    """Findings of the user interface's files: which functions a text has is known by their heads, their lines are counted."""
    return f"""{name} AS (SELECT repo, path, 1 + len(regexp_extract_all(string_split(content, f.head)[1], '\\n')) AS line, f.symbol, f.kind, f.magnitude, f.detail
 FROM (SELECT repo, path, {content} AS content FROM (SELECT s.repo, s.path, s.ordinal, {_SHOWN.replace('content)', 's.content)').replace('ordinal', 's.ordinal')} AS content FROM sources s WHERE regexp_matches(s.path, '/ui/|^src/presentation/'))),
 (VALUES ('canEdit = (u) => u.roles.includes(1) && u.age', 'canEdit', 'authorization-policy-rule', 3, 'comparisons:1;logical:1;predicates:1;arithmetic:0'), ('canEdit = (u) => u.roles.includes(1) ;', 'canEdit', 'authorization-policy-rule', 1, 'comparisons:0;logical:0;predicates:1;arithmetic:0'),
  ('computeTotal(a, b) {{{{' || chr(10) || '  // a < b' || chr(10) || '  return a.price * b.n + 1', 'computeTotal', 'calculation-rule', 2, 'comparisons:0;logical:0;predicates:0;arithmetic:2'),
  ('computeTotal(a, b) {{{{' || chr(10) || '  // a < b' || chr(10) || '  return a.price * b.n * 2', 'computeTotal', 'calculation-rule', 3, 'comparisons:0;logical:0;predicates:0;arithmetic:3'),
  ('shouldRefund(o)', 'shouldRefund', 'authorization-policy-rule', 2, 'comparisons:1;logical:1;predicates:0;arithmetic:0'), ('shouldPayBack(o)', 'shouldPayBack', 'authorization-policy-rule', 2, 'comparisons:1;logical:1;predicates:0;arithmetic:0'),
  ('canShip(order)', 'canShip', 'authorization-policy-rule', 1, 'comparisons:1;logical:0;predicates:0;arithmetic:0'), ('shouldOpen = ', 'shouldOpen', 'authorization-policy-rule', 1, 'comparisons:1;logical:0;predicates:0;arithmetic:0')) f(head, symbol, kind, magnitude, detail)
 WHERE contains(content, f.head))""".replace("{{", "{").replace("}}", "}")


_RULE_FILES = f"""{with_views('code_files')}, r AS (SELECT repo, string_split(path, '/')[2] AS layer, ordinal AS o FROM code_files WHERE regexp_matches(path, '^src/(domain|kernel|lib)/')),
 b AS (SELECT *, CASE WHEN o % 5 = 0 THEN 'enforced' ELSE 'advisory' END AS mode FROM r WHERE o % 7 <> 0), a AS (SELECT *, CASE WHEN o % 3 = 0 THEN 'enforced' ELSE 'advisory' END AS mode FROM r WHERE o % 11 <> 0),
 fb AS (SELECT DISTINCT repo, layer FROM b WHERE layer <> 'domain' OR repo <> 'src1'), fa AS (SELECT DISTINCT repo, layer FROM a WHERE layer <> 'kernel'),
 j AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.layer, b.layer) || '::R' || coalesce(a.o, b.o) AS key, coalesce(a.o, b.o) AS o, b.mode AS bm, a.mode AS am FROM b FULL JOIN a ON a.repo = b.repo AND a.layer = b.layer AND a.o = b.o),
 x AS (SELECT *, CASE WHEN o % 2 = 0 THEN '$.rules.structure[' ELSE '$.rules.invariants[' END || key || ']' AS path, CASE WHEN o % 2 = 0 THEN 'structure' ELSE 'invariant' END AS t FROM j)
 SELECT repo, path, CASE WHEN bm IS NULL THEN 'strengthening' ELSE 'weakening' END AS classification, t || CASE WHEN bm IS NULL THEN '-added' ELSE '-removed' END AS kind FROM x WHERE bm IS NULL OR am IS NULL
 UNION ALL SELECT repo, path || '.mode', 'weakening', t || '-demoted' FROM x WHERE bm = 'enforced' AND am = 'advisory'
 UNION ALL SELECT repo, path || '.mode', CASE WHEN t = 'structure' OR ok THEN 'strengthening' ELSE 'judgment-required' END, t || CASE WHEN t = 'structure' OR ok THEN '-promoted' ELSE '-promotion-refused' END
  FROM (SELECT *, o % 9 <> 3 AND o % 3 = 0 AND o % 4 <> 1 AS ok FROM x) WHERE bm = 'advisory' AND am = 'enforced'
 UNION ALL SELECT repo, path || '.sensor', 'judgment-required', 'sensor-changed' FROM x WHERE bm IS NOT NULL AND am IS NOT NULL AND o % 26 = 0
 UNION ALL SELECT coalesce(fa.repo, fb.repo), '$.ruleFiles[' || coalesce(fa.layer, fb.layer) || ']', CASE WHEN fb.repo IS NULL THEN 'strengthening' WHEN fa.repo IS NULL THEN 'weakening' ELSE 'judgment-required' END,
  CASE WHEN fb.repo IS NULL THEN 'rule-file-added' WHEN fa.repo IS NULL THEN 'rule-file-removed' ELSE 'rule-file-moved' END FROM fb FULL JOIN fa ON fa.repo = fb.repo AND fa.layer = fb.layer WHERE fa.repo IS NULL OR fb.repo IS NULL OR fa.layer = 'lib'"""


def oracle_sql() -> dict[str, str]:
    ui = f"{with_views('code_files', 'sources')}, {_shown('b', 'content')}"
    return {
        "rule_candidates": f"{_FOUND} SELECT * FROM found",
        "rules_inventory": f"{_FOUND} SELECT repo, count(*) AS inventoried, count(*) FILTER (rule_id IN ('INV-EXTRACT-10', 'INV-MAX_CART_SIZE', 'no-anemic-model')) AS under_contract FROM found GROUP BY repo",
        "ui_rule_findings": f"{ui} SELECT repo, path, line, 'domain-logic-in-ui' AS smell, symbol, kind, CAST(magnitude AS BIGINT) AS magnitude, detail, 'sha256:' || sha256('domain-logic-in-ui|' || path || '|' || symbol || '|' || kind) AS fingerprint FROM b",
        "rule_file_delta": _RULE_FILES,
        "promoted_invariants": f"""{with_views('code_files', 'sources')}, c AS (SELECT repo, bool_or(is_test) AS tests, bool_or(is_test AND contains(content, 'INV-1')) AS one, bool_or(is_test AND contains(content, 'INV-2')) OR bool_or(contains(content, 'class Order {{ place()')) AS two,
  bool_or(is_test AND contains(content, 'INV-4')) AS four FROM sources GROUP BY repo), e AS (SELECT repo, unnest([{{'l': 'DomainModel', 'i': 'INV-1', 'ok': one AND tests}}, {{'l': 'DomainModel', 'i': 'INV-2', 'ok': two}}, {{'l': 'DomainModel', 'i': 'INV-3', 'ok': true}}, {{'l': 'Kernel', 'i': 'INV-4', 'ok': four}}]) AS x FROM c)
 SELECT repo, '$.rules.invariants[' || x.l || '::' || x.i || '].mode' AS path, CASE WHEN x.ok THEN 'strengthening' ELSE 'judgment-required' END AS classification, CASE WHEN x.ok THEN 'invariant-promoted' ELSE 'invariant-promotion-refused' END AS kind FROM e""",
        "ui_design_delta": f"""{ui}, {_shown('c', _CHANGED)}, free AS (SELECT repo, symbol, kind, max(magnitude) AS moved FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo = b.repo AND c.path = b.path AND c.symbol = b.symbol) GROUP BY ALL HAVING count(*) = 1),
 j AS (SELECT c.*, coalesce(b.magnitude, f.moved) AS known FROM c LEFT JOIN b ON b.repo = c.repo AND b.path = c.path AND b.symbol = c.symbol LEFT JOIN free f ON f.repo = c.repo AND f.symbol = c.symbol)
 SELECT repo, path, 'domain-logic-in-ui' AS smell, symbol, kind, CASE WHEN known IS NULL THEN 'new' ELSE 'worsened' END AS change FROM j WHERE known IS NULL OR magnitude > known""",
    }
