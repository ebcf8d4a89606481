"""Registered queries of walls, structure rules, design health, contracts and plans over derived facts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.contract import FLEET, WALLED, Contract, Layer, Rule
from archweave.derive import facts
from archweave.functions.names import stable_hash
from archweave.functions.paths import is_canonical_path, scan_excluded
from archweave.lineage import cut
from archweave.operators import changes, coach, cohesion, events, experiments, graph, health, layers, plans, policy, reports, scan, structure, walls
from archweave.sources import contracts
from archweave.sources import facts as src

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def _files(spark: SparkSession, sf: str, contract: Contract = WALLED) -> DataFrame:
    return layers.classify_layers(facts(spark, sf, "code_files"), contract).select("repo", "path", "ordinal", "layer")


def _repos(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "code_files").select("repo").distinct()


def _coverage(spark: SparkSession, sf: str, contract: Contract = WALLED) -> DataFrame:
    return layers.coverage(_files(spark, sf, contract), contract)


def _imports(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "module_imports")


def _violations(spark: SparkSession, sf: str) -> DataFrame:
    return layers.layer_violations(layers.build_edges(facts(spark, sf, "dependencies"), _files(spark, sf)), FLEET)


@_query
def module_capability(spark: SparkSession, sf: str) -> DataFrame:
    return _imports(spark, sf).select("repo", "file", "ordinal", "specifier", walls.module_capability(F.col("specifier")).alias("capability"))


@_query
def ambient_capability(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "ambient_uses").select("repo", "file", "line", "symbol", walls.ambient_capability(F.col("symbol")).alias("capability"))


@_query
def forbidden_global_violations(spark: SparkSession, sf: str) -> DataFrame:
    found = walls.forbidden_global_violations(facts(spark, sf, "ambient_uses"), _files(spark, sf), WALLED)
    return found.select("repo", "rule_id", "file", "line", "from_layer", "target")


@_query
def capability_violations(spark: SparkSession, sf: str) -> DataFrame:
    uses = walls.capability_uses(_imports(spark, sf), facts(spark, sf, "ambient_uses"))
    return walls.capability_violations(uses, _imports(spark, sf), _files(spark, sf), WALLED)


@_query
def publish_violations(spark: SparkSession, sf: str) -> DataFrame:
    return walls.publish_violations(facts(spark, sf, "publish_calls"), _files(spark, sf))


@_query
def intent_reference_violations(spark: SparkSession, sf: str) -> DataFrame:
    return walls.intent_reference_violations(facts(spark, sf, "intent_references"), _files(spark, sf), WALLED)


@_query
def coverage_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return walls.coverage_atoms(WALLED, _repos(spark, sf))


@_query
def resolve_specifiers(spark: SparkSession, sf: str) -> DataFrame:
    return walls.resolve_specifiers(_imports(spark, sf), facts(spark, sf, "code_files")).select("repo", "file", "ordinal", "specifier", "to_path")


def _odd_paths(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.expr("CASE ordinal % 6 WHEN 0 THEN concat('/', path) WHEN 1 THEN concat('./', path) WHEN 2 THEN concat('C:/', path) WHEN 3 THEN concat('../', path) ELSE path END")
    return facts(spark, sf, "code_files").withColumn("odd", odd)


@_query
def canonical_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _odd_paths(spark, sf).select("repo", "odd", is_canonical_path(F.col("odd")).alias("canonical"))


@_query
def scanned_files(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "code_files").where(~scan_excluded(F.col("path"), ("src/lib/**",))).select("repo", "path")


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    mutating = F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda k: k <= F.col("n_mutating")), lambda k: F.struct(F.concat(F.lit("m"), k).alias("name"), F.col("guarded").alias("guarded")))
    return facts(spark, sf, "class_shapes").withColumn("mutating", mutating)


def _structure(spark: SparkSession, sf: str) -> DataFrame:
    return structure.structure_violations(_shapes(spark, sf), structure.derive_file_hints(facts(spark, sf, "sources")), _files(spark, sf), WALLED)


@_query
def structure_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _structure(spark, sf)


@_query
def empty_scope(spark: SparkSession, sf: str) -> DataFrame:
    return structure.empty_scope(facts(spark, sf, "code_files"), WALLED)


@_query
def file_hints(spark: SparkSession, sf: str) -> DataFrame:
    return structure.derive_file_hints(facts(spark, sf, "sources"))


@_query
def lines_exports(spark: SparkSession, sf: str) -> DataFrame:
    return structure.count_lines_exports(facts(spark, sf, "sources"))


@_query
def invariant_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return structure.invariant_coverage(facts(spark, sf, "sources"), WALLED)


@_query
def safety_report(spark: SparkSession, sf: str) -> DataFrame:
    most = {"ts-suppression": 20, "any-cast": 1_000_000_000}
    return structure.safety_report(facts(spark, sf, "safety_uses"), _repos(spark, sf), FLEET, most, allowed=("src/lib/**",))


@_query
def completeness_verdict(spark: SparkSession, sf: str) -> DataFrame:
    repos = _repos(spark, sf)
    enforced = F.col("invariant").isin([i.id for i in WALLED.invariants if i.enforced])
    tested = facts(spark, sf, "sources").withColumn("is_test", F.col("is_test") & (F.length("repo") > 4))
    invariants = structure.invariant_coverage(tested, WALLED)
    violations = _violations(spark, sf).select("repo", F.col("blocking").alias("fails_strict")).union(invariants.where("fails_strict").select("repo", "fails_strict"))
    warnings = structure.empty_scope(facts(spark, sf, "code_files"), WALLED).select("repo", "fails_strict")
    snapshots = repos.select("repo", F.lit("complete").alias("completeness"), (F.col("repo") != "src3").alias("requirements_match"))
    return structure.completeness_verdict(repos, violations, warnings, invariants.select("repo", "partial", enforced.alias("enforced")), snapshots)


ODD_CONTRACT = Contract(
    (*FLEET.layers, Layer("Ghost", ("src/ghost/**", "src/domain/**")), Layer("Bare"), Layer("Kernel", ("src/kernel/**",))),
    (*FLEET.rules, Rule("Nobody", "Kernel"), Rule("Kernel", "Nothing")),
)


@_query
def contract_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return structure.contract_warnings(_files(spark, sf, ODD_CONTRACT), ODD_CONTRACT)


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    sources = layers.classify_layers(facts(spark, sf, "sources"), FLEET)
    return health.smell_evidence(sources, FLEET)


@_query
def smell_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf)


#: Rules that leave features and kernel out.
SOFT = Contract(FLEET.layers, tuple(r for r in FLEET.rules if r.source != r.target))


def _smelling(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence of files, files, layers without rules: what smells are made of."""
    populated = _coverage(spark, sf, SOFT).where("n_files > 0").select("repo", "layer")
    lone = layers.layers_without_rules(SOFT, _repos(spark, sf)).join(populated, ["repo", "layer"], "left_semi")
    return _evidence(spark, sf), facts(spark, sf, "code_files"), lone


def _smells(spark: SparkSession, sf: str) -> DataFrame:
    return health.design_smells(*_smelling(spark, sf))


@_query
def design_smells(spark: SparkSession, sf: str) -> DataFrame:
    return _smells(spark, sf)


@_query
def design_fitness(spark: SparkSession, sf: str) -> DataFrame:
    blocking = layers.verdict(_repos(spark, sf), _violations(spark, sf).where(F.length("repo") > 4))
    return health.design_fitness(_smells(spark, sf), _coverage(spark, sf), blocking)


#: An application layer that covers the folder of persistence, whose own layer is empty.
FALSE_GREEN = Contract((Layer("DomainModel", ("src/domain/**",)), Layer("ApplicationOrchestration", ("src/application/**", "src/adapters/**")), Layer("PersistenceAdapters", ("src/db/**",))))


@_query
def false_green_risk(spark: SparkSession, sf: str) -> DataFrame:
    return health.false_green_risk(_coverage(spark, sf, FALSE_GREEN), facts(spark, sf, "code_files"), FALSE_GREEN)


@_query
def baseline_honesty(spark: SparkSession, sf: str) -> DataFrame:
    n = _violations(spark, sf).groupBy("repo").agg(F.count("*").alias("total"), F.count_if(F.col("line") <= 6).alias("frozen"))
    rows = _repos(spark, sf).join(n, "repo", "left").fillna(0, ["total", "frozen"])
    even = F.length("repo") > 4
    return health.baseline_honesty(rows.select("repo", (F.col("repo") != "src3").alias("has_baseline"), "frozen", F.when(even, 0).otherwise(F.col("total") - F.col("frozen")).alias("active"), F.col("frozen").alias("suppressed"), "total"))


@_query
def fitness_score(spark: SparkSession, sf: str) -> DataFrame:
    gates = facts(spark, sf, "code_files").where("repo <> 'src5'").select("repo", (F.col("ordinal") % 3 == 0).alias("on"))
    return health.fitness_score(_coverage(spark, sf), _violations(spark, sf).where("line = 3"), gates, FLEET)


#: The fleet's contract with two optional cores.
RELAXED = Contract(tuple(replace(x, optional=x.name in ("DomainModel", "ReportingReadModels")) for x in FLEET.layers), FLEET.rules)


@_query
def core_ratchet(spark: SparkSession, sf: str) -> DataFrame:
    return health.core_ratchet(_coverage(spark, sf, RELAXED), _violations(spark, sf).where(F.length("repo") > 4), RELAXED)


@_query
def rules_under_contract(spark: SparkSession, sf: str) -> DataFrame:
    return health.rules_under_contract(structure.invariant_coverage(facts(spark, sf, "sources"), WALLED), _coverage(spark, sf), WALLED)


@_query
def next_pilot(spark: SparkSession, sf: str) -> DataFrame:
    return health.next_pilot(_smells(spark, sf))


@_query
def pilot_residual(spark: SparkSession, sf: str) -> DataFrame:
    # Few rows, read three times: scripts are searched once.
    before = cut(_evidence(spark, sf))
    left = before.where(~((F.col("smell") == "god-module") & (F.length("repo") > 4)) & ~F.col("path").rlike("[02468][.]"))
    pilots = before.where(F.col("smell").isin("god-module", "domain-logic-in-ui")).select("repo", "smell", "path").distinct()
    return health.pilot_residual(before, left, pilots)


def _contract_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each repository has rules of its own; some leave out the second half."""
    pairs = [
        ("DomainModel", "Kernel", True),
        ("Kernel", "DomainModel", True),
        ("AuditTrail", "ApplicationOrchestration", True),
        ("IntegrationAdapters", "PersistenceAdapters", True),
        ("OrdersPersistenceAdapters", "PersistenceInfrastructure", True),
        ("Kernel", "Kernel", False),
        ("DomainModel", "ReportingReadModels", False),
        ("DomainModel", "GhostLayer", False),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit(c).alias("allowed")) for i, (a, b, c) in enumerate(pairs)])).alias("x")
    rules = _repos(spark, sf).select("repo", each).where((F.length("repo") > 4) | (F.col("x.i") < 6)).select("repo", "x.source", "x.target", "x.allowed")
    known = [("DomainModel", False), ("Kernel", False), ("ApplicationOrchestration", False), ("PersistenceAdapters", False), ("IntegrationAdapters", True), ("AuditTrail", True), ("OrdersPersistenceAdapters", True), ("PersistenceInfrastructure", True), ("ReportingReadModels", False)]
    names = F.explode(F.array(*[F.struct(F.lit(a).alias("layer"), F.lit(b).alias("optional")) for a, b in known])).alias("x")
    own = _repos(spark, sf).select("repo", names).select("repo", "x.layer", "x.optional")
    return health.contract_smell_edges(rules, own, _coverage(spark, sf))


@_query
def contract_smells(spark: SparkSession, sf: str) -> DataFrame:
    acks = [
        ("contract-bidirectional-allow", "Kernel<->DomainModel", None),
        ("contract-dead-rule", "Kernel->Kernel", "2020-01-01"),
        ("contract-peripheral-depends-core", "AuditTrail->ApplicationOrchestration", "2999-12-31"),
        ("contract-lateral-adapter-allow", "IntegrationAdapters->PersistenceAdapters", "2026-02-30"),
        ("contract-dead-rule", "Gone->Gone", None),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("smell"), F.lit(b).alias("edge"), F.lit(c).cast("string").alias("review_by")) for a, b, c in acks])).alias("x")
    rows = _repos(spark, sf).where("repo <> 'src7'").select("repo", each).select("repo", "x.*")
    return health.contract_smells(_contract_edges(spark, sf), rows, "2026-01-01")


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of all kinds, with the flags that a plan reads."""
    edges = layers.build_edges(facts(spark, sf, "dependencies"), _files(spark, sf)).withColumn("rule", layers.denying_rule(FLEET)).where("rule is not null")
    rows = edges.select(
        "repo",
        F.lit("LAYER_IMPORT_VIOLATION").alias("rule_id"),
        F.col("from_path").alias("file"),
        "line",
        "from_layer",
        "to_layer",
        F.col("to_path").alias("target"),
        F.when(F.col("kind") == "export", "import").otherwise(F.col("kind")).alias("edge_kind"),
        "type_only",
        F.col("rule.peer").alias("peer_isolation"),
        (F.col("from_ordinal") % 5 == 0).alias("source_pure_types"),
        (F.col("to_ordinal") % 7 == 0).alias("target_types_only"),
        (F.col("to_ordinal") % 3 == 0).alias("named_types_only"),
        (F.col("from_ordinal") % 2 == 0).alias("port_proof"),
        (~F.col("type_only") | F.col("rule.peer")).alias("blocking"),
    )
    no = F.lit(False)
    other = facts(spark, sf, "safety_uses").select("repo", F.expr("CASE kind WHEN 'any-cast' THEN 'FORBIDDEN_GLOBAL' WHEN 'dynamic-import' THEN 'CIRCULAR_DEPENDENCY' WHEN 'dynamic-require' THEN 'ARKRULE_STRUCTURE' WHEN 'in-memory-store' THEN '' ELSE 'RAW_EVENT_PUBLISH' END").alias("rule_id"), "file", "line", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), no, no, no, no, no, no, F.lit(True))
    return rows.union(other)


@_query
def classify_remediation(spark: SparkSession, sf: str) -> DataFrame:
    found = health.classify_remediation(_flagged(spark, sf))
    return found.select("repo", "rule_id", "file", "line", "target", "class", F.col("confidence").cast("double").alias("confidence"), "remediation")


@_query
def fix_class(spark: SparkSession, sf: str) -> DataFrame:
    return health.fix_class(_flagged(spark, sf)).select("repo", "rule_id", "file", "line", "target", "fix_class", "effort")


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return health.remediation_plan(health.classify_remediation(_flagged(spark, sf)), ["rule_id", "file", "line", "target"])


@_query
def remediation_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).select("repo", "step", "class", "type_only")


@_query
def plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return health.plan_summary(_plan(spark, sf), _coverage(spark, sf))


@_query
def freeze_guard(spark: SparkSession, sf: str) -> DataFrame:
    lone = _violations(spark, sf).where("from_layer = 'DomainModel' or repo <> 'src2'")
    return health.freeze_guard(layers.violation_breakdown(lone))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """Files with names of several words, some owned by a framework."""
    name = "CASE ordinal % 7 WHEN 0 THEN 'OrderService.ts' WHEN 1 THEN 'getUser.ts' WHEN 2 THEN 'page.tsx' WHEN 3 THEN 'HTTPClient.ts' WHEN 4 THEN 'orderLine.test.ts' WHEN 5 THEN 'README.md' ELSE 'useNew.ts' END"
    folder = "CASE CAST(floor(ordinal / 20) AS BIGINT) % 4 WHEN 0 THEN 'src/app/orders/' WHEN 1 THEN 'src/features/order/' WHEN 2 THEN 'src/(shop)/billing/lines/' ELSE '' END"
    return facts(spark, sf, "code_files").select("repo", "ordinal", F.expr(f"concat({folder}, {name})").alias("path"))


@_query
def classify_physical(spark: SparkSession, sf: str) -> DataFrame:
    found = _named(spark, sf).withColumn("x", cohesion.classify_physical(F.col("path")))
    return found.select("repo", "ordinal", "path", "x.concept", "x.anchor")


def _cohesion(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counted = cohesion.anchors(_named(spark, sf))
    return cohesion.physical_cohesion(counted, cluster=4, mirror=2), counted


@_query
def physical_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    return _cohesion(spark, sf)[0]


@_query
def reshape_pilot(spark: SparkSession, sf: str) -> DataFrame:
    return cohesion.reshape_pilot(*_cohesion(spark, sf))


@_query
def suggest_layer(spark: SparkSession, sf: str) -> DataFrame:
    folder = "CASE ordinal % 9 WHEN 0 THEN 'src/app/(x)/api/y' WHEN 1 THEN 'api/z' WHEN 2 THEN 'src/domain/order' WHEN 3 THEN 'src/lib/prisma' WHEN 4 THEN 'src/lib/components' WHEN 5 THEN 'src/components/deep' WHEN 6 THEN 'src/services/repositories/x' WHEN 7 THEN 'src/nothing' ELSE 'packages/usecases' END"
    return facts(spark, sf, "code_files").select("repo", "ordinal", F.expr(folder).alias("folder")).select("*", cohesion.suggest_layer(F.col("folder")).alias("layer"))


def _change_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = F.expr("CASE WHEN ordinal % 17 = 0 THEN concat('../', path) WHEN ordinal % 19 = 0 THEN concat('./', path) ELSE path END")
    rows = facts(spark, sf, "code_files").where("repo <> 'src4'").select("repo", "ordinal", path.alias("path"), (F.col("ordinal") % 4 == 0).alias("is_delete"), (F.col("n_chars") + 1).alias("content_version"))
    return rows.union(rows.where("ordinal % 23 = 0").withColumn("ordinal", F.col("ordinal") + 1_000_000))


@_query
def preflight_changes(spark: SparkSession, sf: str) -> DataFrame:
    return plans.preflight_changes(facts(spark, sf, "tree_base"), _change_rows(spark, sf), _repos(spark, sf))


@_query
def prepared_changes(spark: SparkSession, sf: str) -> DataFrame:
    return plans.prepared_changes(facts(spark, sf, "tree_base"), _change_rows(spark, sf).where("path not like '../%'"))


@_query
def validate_change_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = _odd_paths(spark, sf).join(_files(spark, sf).select("repo", "path", "layer"), ["repo", "path"])
    files = rows.select("repo", "ordinal", F.expr("CASE WHEN ordinal % 6 = 0 THEN odd ELSE path END").alias("path"), F.expr("CASE ordinal % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'rename' ELSE 'update' END").alias("operation"), F.expr("CASE ordinal % 7 WHEN 0 THEN 'Nobody' WHEN 1 THEN 'Kernel' ELSE coalesce(layer, 'DomainModel') END").alias("layer"))
    files = files.where("ordinal % 10 <> 3")
    files = files.union(files.where("ordinal % 13 = 0").withColumn("ordinal", F.col("ordinal") + 1_000_000))
    wanted = facts(spark, sf, "dependencies").select("repo", (3 * F.col("from_ordinal") + F.col("ordinal")).alias("ordinal"), "from_path", "to_path")
    return plans.validate_change_map(files, wanted, WALLED)


def _convergence(spark: SparkSession, sf: str) -> DataFrame:
    operation = F.expr("CASE change WHEN 'created' THEN 'create' WHEN 'deleted' THEN 'delete' ELSE 'update' END")
    actual = changes.tree_diff(facts(spark, sf, "tree_base"), facts(spark, sf, "tree_candidate")).select("repo", "path", operation.alias("operation"))
    planned = facts(spark, sf, "code_files").where("ordinal % 10 in (0, 1) or ordinal % 26 = 0").select("repo", "path", F.expr("CASE WHEN ordinal % 10 = 0 THEN 'create' WHEN ordinal % 10 = 1 THEN 'delete' ELSE 'update' END").alias("operation"))
    edges = facts(spark, sf, "dependencies")
    wanted = edges.where("from_ordinal % 3 = 0 and ordinal = 1").select("repo", F.when(F.col("from_ordinal") % 2 == 0, F.col("from_path")).otherwise(F.col("to_path")).alias("from_path"), F.when(F.col("from_ordinal") % 2 == 0, F.col("to_path")).otherwise(F.col("from_path")).alias("to_path"))
    return plans.convergence_findings(planned, actual, wanted, edges.where("ordinal <= 2"), edges.where("ordinal <> 2"))


@_query
def convergence_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _convergence(spark, sf)


@_query
def convergence_summary(spark: SparkSession, sf: str) -> DataFrame:
    return plans.convergence_summary(_convergence(spark, sf))


@_query
def design_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, "safety_uses").select("repo", F.col("file").alias("path"), F.col("kind").alias("smell"), F.concat(F.lit("s"), F.col("ordinal") % 40).alias("symbol"), F.lit("rule").alias("kind"), "ordinal")
    base = rows.where("ordinal % 5 <> 0").select("repo", "path", "smell", "symbol", "kind", (F.col("ordinal") % 9).alias("magnitude"))
    moved = F.when(F.col("ordinal") % 11 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path"))
    candidate = rows.select("repo", moved.alias("path"), "smell", "symbol", "kind", (F.col("ordinal") % 7).alias("magnitude"))
    return plans.design_delta(base, candidate, candidate.where("symbol <> 's7'").select("repo", "path"))


@_query
def decision_memory(spark: SparkSession, sf: str) -> DataFrame:
    counted = cohesion.anchors(_named(spark, sf))
    decided = counted.where("concept in ('order', 'user', 'httpclient', 'client', 'http')").groupBy("repo", "concept").agg(F.array_sort(F.collect_set("anchor")).alias("all"))
    late = F.length("repo") > 4
    rows = decided.select("repo", "concept", F.when((F.col("concept") == "user") & late, F.array(F.lit("elsewhere"))).otherwise(F.col("all")).alias("anchors"), F.when(late, "rejected").otherwise("accepted").alias("verdict"), F.when(F.col("concept") == "order", F.lit("2999-01-01")).when(F.col("concept") == "user", F.lit("2020-01-01")).otherwise(F.lit(None).cast("string")).alias("review_by"))
    return plans.decision_memory(rows, counted, "2026-01-01")


def _contract_of(spark: SparkSession, sf: str, candidate: bool) -> dict[str, DataFrame]:
    """The fleet's contract for each repository; the candidate's differ by repository."""
    repos = _repos(spark, sf)
    long = F.length("repo") > 4
    strings = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    atoms = walls.coverage_atoms(WALLED, repos)
    own = atoms.groupBy("repo", "layer").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "atom", F.col("atom")))).alias("atoms"), F.array_sort(F.collect_list(F.when(F.col("kind") == "raw", F.col("atom")))).alias("raw_globals"))
    tables = contracts.contract_tables(WALLED, repos)
    rows = tables["layers"].join(own, ["repo", "layer"], "left").select("repo", "layer", "optional", "patterns", "exclude", "prefixes", F.coalesce("raw_globals", strings()).alias("raw_globals"), F.coalesce("atoms", strings()).alias("atoms"))
    rules = tables["rules"].select("repo", "ordinal", "source", "target", "allowed", "peer_isolation", "slice_folders")
    settings = repos.select("repo", strings("src").alias("include"), strings("dist").alias("exclude"), strings().alias("allowlist"), F.lit("soft").alias("cycle_policy"), F.lit(True).alias("exclude_generated"), F.lit(3).alias("max_suppressions"), F.lit(0).alias("max_any"), F.lit(False).alias("in_memory"), F.lit(False).alias("disabled_peers"))
    if not candidate:
        return {"layers": rows, "rules": rules, "settings": settings}
    rows = rows.where(~((F.col("layer") == "Kernel") & long)).withColumn("patterns", F.when((F.col("layer") == "Features") & long, strings("src/features/*", "src/more/**")).otherwise(F.col("patterns")))
    rows = rows.withColumn("atoms", F.when((F.col("layer") == "PresentationAdapters") & ~long, strings()).otherwise(F.col("atoms"))).withColumn("optional", F.col("optional") | (F.col("layer") == "DomainModel") & (F.col("repo") == "src3"))
    rules = rules.where(~((F.col("source") == "DomainModel") & (F.col("target") == "PresentationAdapters") & (F.col("repo") == "src1")))
    rules = rules.withColumn("allowed", (F.col("source") == "PresentationAdapters") & long).withColumn("peer_isolation", F.col("peer_isolation") & ~((F.col("source") == "Features") & (F.col("repo") == "src2")))
    settings = settings.withColumns({"cycle_policy": F.when(long, "strict").when(F.col("repo") == "src2", "framework-soft").otherwise("soft"), "max_any": F.when(F.col("repo") == "src6", 5).otherwise(0), "max_suppressions": F.when(long, 1).otherwise(3), "exclude": F.when(F.col("repo") == "src8", strings("dist", "legacy")).otherwise(strings("dist"))})
    return {"layers": rows, "rules": rules, "settings": settings}


def _delta(spark: SparkSession, sf: str) -> DataFrame:
    return policy.policy_delta(_contract_of(spark, sf, False), _contract_of(spark, sf, True))


@_query
def policy_delta(spark: SparkSession, sf: str) -> DataFrame:
    return _delta(spark, sf)


@_query
def policy_class(spark: SparkSession, sf: str) -> DataFrame:
    return policy.policy_class(_delta(spark, sf).where("repo <> 'src9'"), _repos(spark, sf))


@_query
def policy_ack(spark: SparkSession, sf: str) -> DataFrame:
    hashes = _repos(spark, sf).select("repo", F.lit("h1").alias("base_hash"), F.lit("h2").alias("candidate_hash"))
    ids = F.when(F.length("repo") > 4, F.array(*map(F.lit, ("weakening:$.layers[Features].patterns:removed", "weakening:$.layers[Kernel]:layer-removed", "weakening:$.rules[PresentationAdapters->PersistenceAdapters].allowed:deny-disabled")))).otherwise(F.array(F.lit("weakening:$.layers[PresentationAdapters].capabilities:removed")))
    acks = hashes.where("repo <> 'src5'").select("repo", "base_hash", F.when(F.col("repo") == "src7", "h3").otherwise(F.lit("h2")).alias("candidate_hash"), ids.alias("finding_ids"), F.when(F.col("repo") == "src10", " ").otherwise("agreed").alias("reason"))
    return policy.policy_ack(acks, _delta(spark, sf), hashes)


@_query
def contract_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Which repositories have one contract, by their hashes."""
    of = lambda candidate: policy.contract_hashes(*(lambda c: (c["layers"], c["rules"]))(_contract_of(spark, sf, candidate)), stable_hash)
    both = of(False).withColumnRenamed("policy_hash", "a").join(of(True).withColumnRenamed("policy_hash", "b"), "repo")
    return both.select("repo", (F.col("a") == F.col("b")).alias("unchanged"))


@_query
def team_gate(spark: SparkSession, sf: str) -> DataFrame:
    counted = changes.change_set_gate(facts(spark, sf, "commit_paths").withColumnRenamed("commit_id", "change_id"), r"^src/p[0-4]\.ts$", r"^src/p\d\d\.ts$")
    i = F.col("change_id")
    return changes.team_gate(counted.select("change_id", "n_law", "n_product", (i % 2 == 0).alias("session"), F.when(i % 3 == 0, "loosen").when(i % 3 == 1, "tighten").alias("policy"), (i % 5).alias("n_grow"), (i % 7 != 0).alias("has_stewards"), (i % 4 == 0).alias("is_steward")))


@_query
def hot_paths(spark: SparkSession, sf: str) -> DataFrame:
    return changes.hot_paths(facts(spark, sf, "commit_paths"), 1000, 3)


@_query
def event_layers(spark: SparkSession, sf: str) -> DataFrame:
    short = {"Short": ("Domain.Order.",), "Long": ("Domain.User.Registered.Fully.", "Domain.")}
    return facts(spark, sf, "domain_events").select("event_id", events.event_layer(F.col("intent"), short).alias("layer"))


@_query
def declared_layer_policy(spark: SparkSession, sf: str) -> DataFrame:
    wide = Contract(FLEET.layers, (*FLEET.rules, Rule("ApplicationOrchestration", "DomainModel"), Rule("ApplicationOrchestration", "DomainModel", allowed=True)))
    return events.declared_layer_policy(facts(spark, sf, "intent_flows"), wide)


@_query
def history_query(spark: SparkSession, sf: str) -> DataFrame:
    return events.history_query(facts(spark, sf, "domain_events"), ["source"], 50, intent="Domain.Order.Placed").select("source", "event_id")


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    entity, field = F.concat(F.lit("e"), F.col("ordinal") % 50), F.concat(F.lit("f"), F.col("ordinal"))
    relation = F.expr("CASE ordinal % 4 WHEN 0 THEN concat('e', ordinal % 60) END")
    return facts(spark, sf, "code_files").select(F.when(F.col("ordinal") % 50 == 49, F.lit(" ")).otherwise(entity).alias("entity"), F.when(F.col("ordinal") % 31 == 0, " ").otherwise(field).alias("field"), F.when(F.col("ordinal") % 29 == 0, "").otherwise("string").alias("type"), relation.alias("relation"))


@_query
def validate_entities(spark: SparkSession, sf: str) -> DataFrame:
    return events.validate_entities(_entities(spark, sf))


@_query
def entities_by_intent(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, "code_files").select(F.concat(F.lit("e"), "ordinal").alias("entity"), F.array(F.concat(F.lit("i"), F.col("ordinal") % 13), F.concat(F.lit("i"), F.col("ordinal") % 7)).alias("emits"), F.when(F.col("ordinal") % 3 == 0, F.array(F.concat(F.lit("i"), F.col("ordinal") % 13))).otherwise(F.array().cast("array<string>")).alias("consumes"))
    return events.entities_by_intent(rows)


@_query
def intercept_events(spark: SparkSession, sf: str) -> DataFrame:
    chain = (
        events.Interceptor("fill", "Domain.Order.Placed", '{"extra": {"a": 1}}'),
        events.Interceptor("again", "Domain.Order.Placed", '{"extra": {"b": [2]}}', F.col("event_id") % 2 == 0),
        events.Interceptor("clash", "Domain.Order.Placed", '{"extra": {"a": 3}}', F.col("event_id") % 3 == 0),
    )
    rows = facts(spark, sf, "domain_events").where("intent = 'Domain.Order.Placed'").withColumns({"payload": F.lit('{"k":1}'), "event_version": F.lit("2")})
    found = events.intercept_events(rows, chain)
    return found.select("event_id", "payload", F.array_join("interceptions", ",").alias("interceptions"), F.array_join("failures", ",").alias("failures"))


@_query
def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("pair_id")
    cells = facts(spark, sf, "experiment_cells").select("arm", F.when((i % 10 != 0) | (F.col("arm") == "control"), i % 1000).alias("input_tokens"), (i % 77).alias("output_tokens"), (i % 5).alias("cost_micros"))
    return experiments.usage_summary(cells)


def _adopted(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("pair_id")
    return facts(spark, sf, "experiment_cells").select(F.concat(F.lit("size"), i % 3).alias("size"), F.concat(F.lit("style"), i % 4).alias("style"), F.col("restricted_ms").alias("apply_ms"), (i % 101).alias("percent"), F.when(i % 3 == 0, "adapt").otherwise("green").alias("state"))


_DIMENSIONS = {"size": ["size0", "size1", "size2", "size3"], "style": ["style0", "style1", "style2", "style3"]}


@_query
def adoption_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.adoption_matrix(_adopted(spark, sf), _DIMENSIONS)


@_query
def adoption_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _adopted(spark, sf)
    issues = facts(spark, sf, "experiment_cells").select(F.concat(F.lit("P"), F.col("pair_id") % 4).alias("severity"))
    return experiments.adoption_summary(rows, experiments.adoption_matrix(rows, _DIMENSIONS), issues)


@_query
def arm_comparison(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("pair_id")
    return experiments.arm_comparison(facts(spark, sf, "experiment_cells").select("arm", F.col("task_id").alias("prompt"), (i % 3).alias("n_violations"), F.concat(F.lit("f"), i % 20).alias("file"), F.when(i % 2 == 0, i % 24 + 70).alias("governed")))


@_query
def loop_cost(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("pair_id")
    return experiments.loop_cost(facts(spark, sf, "experiment_cells").select("arm", F.when(i % 2 == 0, "type-only").otherwise("value").alias("kind"), F.when(i % 9 != 0, i % 11 + F.length("arm")).alias("turns"), (i % 17 == 0).alias("cheated")))


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, "code_files").select(F.floor(F.col("ordinal") / 10).alias("scenario"), F.when(F.col("ordinal") % 2 == 0, "weak").otherwise("golden").alias("arm"), F.floor(F.col("ordinal") % 10 / 2).alias("turn"), F.expr("CASE WHEN ordinal % 7 IN (2, 3) THEN concat('src/domain/f', ordinal, '.ts') ELSE path END").alias("path"), F.lit("DomainModel").alias("wanted"))
    return experiments.placement_turns(rows.withColumn("turn", F.col("turn") + 1), lambda p: layers.layer_of(p, FLEET))


@_query
def placement_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(spark, sf)


@_query
def placement_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.placement_comparison(_placed(spark, sf), "weak", "golden")


@_query
def parse_health(spark: SparkSession, sf: str) -> DataFrame:
    files = facts(spark, sf, "code_files").select("repo", "path", F.when(F.col("ordinal") % 3 == 0, F.col("ordinal") % 5).otherwise(0).alias("diagnostics"))
    return src.parse_health(files, 4).withColumn("paths", F.array_join("paths", ","))


@_query
def dynamic_blind_spots(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, "dependencies").select("repo", "from_path", "line", F.when(F.col("kind") == "dynamic-import", "dynamic").otherwise("resolved-project").alias("resolution"), F.when(F.col("ordinal") == 2, "template-interpolation").otherwise("non-literal").alias("reason"))
    return src.dynamic_blind_spots(rows, 3)


@_query
def tree_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Which repositories have the same tree before and after."""
    of = lambda name: src.tree_hashes(facts(spark, sf, name).select("repo", "path", F.col("content_version").cast("string").alias("content_hash")))
    same = facts(spark, sf, "tree_base").where("repo <> 'src2'").union(facts(spark, sf, "tree_candidate").where("repo = 'src2'"))
    other = src.tree_hashes(same.select("repo", "path", F.col("content_version").cast("string").alias("content_hash")))
    return of("tree_base").withColumnRenamed("tree_hash", "a").join(other, "repo").select("repo", (F.col("a") == F.col("tree_hash")).alias("same"))


@_query
def retained_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    shots = facts(spark, sf, "domain_events").select(F.col("intent").alias("repo"), F.col("event_id").alias("ts"))
    return contracts.retained_snapshots(shots, 5)


@_query
def validate_fact_keys(spark: SparkSession, sf: str) -> DataFrame:
    files = facts(spark, sf, "code_files")
    twice = files.select("repo", "path").union(files.where("ordinal % 40 = 0").select("repo", "path"))
    return src.validate_fact_keys(twice, facts(spark, sf, "module_imports").withColumn("file", F.when(F.col("line") == 10, F.col("file")).otherwise(F.concat("file", F.lit("x")))), "file")


@_query
def read_structure_rules(spark: SparkSession, sf: str) -> DataFrame:
    files = facts(spark, sf, "code_files")
    asked = files.where("ordinal % 3 = 0").select("repo", F.lit("L").alias("layer"), F.expr("CASE WHEN ordinal % 2 = 0 THEN path ELSE concat(path, 'x') END").alias("path"))
    return contracts.read_structure_rules(asked, files.where("ordinal % 2 = 0"))


@_query
def valid_acks(spark: SparkSession, sf: str) -> DataFrame:
    entries = facts(spark, sf, "code_files").select("repo", F.concat(F.lit("a"), F.floor(F.col("ordinal") / 100)).alias("file"), F.lit("s").alias("smell"), F.when(F.col("ordinal") % 97 == 0, " ").otherwise(F.col("path")).alias("edge"))
    return contracts.valid_acks(entries).select("repo", "file", "edge")


@_query
def intent_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Intents that produce each other: suppliers of one nation hand to the next of it, by number."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey")
    w = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    onward = F.coalesce(F.lead("s_suppkey").over(w), F.when(F.col("s_nationkey") % 2 == 0, F.first("s_suppkey").over(w)))
    edges = rows.select(F.concat(F.lit("Domain.S"), "s_suppkey").alias("from_intent"), F.concat(F.lit("Domain.S"), onward).alias("to_intent")).where("to_intent is not null and from_intent <> to_intent")
    return graph.intent_cycles(edges)


@_query
def extract_imports(spark: SparkSession, sf: str) -> DataFrame:
    return scan.extract_imports(facts(spark, sf, "sources"))


@_query
def extract_class_shapes(spark: SparkSession, sf: str) -> DataFrame:
    body = F.expr("CASE ordinal % 4 WHEN 0 THEN 'public count = 0; constructor(a) {}' WHEN 1 THEN 'a: string; b: number;' WHEN 2 THEN concat('private constructor() {}', chr(10), ' static create(x) { return 1 }', chr(10), ' add(x) { this.n = x }') ELSE 'run() { return 1 }' END")
    rows = facts(spark, sf, "sources").withColumn("content", F.concat(F.lit("export class C"), F.col("ordinal"), F.lit(" {\n"), body, F.lit("\n}\n"), F.col("content")))
    return scan.extract_class_shapes(rows).select("repo", "file", "class_name", "public_setters", "public_mutable", "public_constructor", "static_factory", "data_only", F.size("mutating").cast("long").alias("n_mutating"))


@_query
def extract_module_state(spark: SparkSession, sf: str) -> DataFrame:
    pure = F.coalesce(F.col("layer") == "DomainModel", F.lit(False))
    rows = layers.classify_layers(facts(spark, sf, "sources"), WALLED).withColumn("content", F.concat(F.lit("let counter = 0;\nfunction f() { let inner = 1 }\nvar "), F.concat(F.lit("v"), F.col("ordinal")), F.lit(" = {};\n")))
    known = rows.where("ordinal % 2 = 0").select("repo", "path", F.lit("counter").alias("name"))
    return scan.extract_module_state(rows.withColumn("pure", pure), known)


_NESTED = events.EventContract(
    "Domain.Order.Placed",
    "3",
    {
        "id": events.EventField("number", True),
        "state": events.EventField("string", values=('"new"', '"paid"')),
        "buyer": events.EventField("object", True, fields={"name": events.EventField("string", True), "age": events.EventField("number")}),
        "lines": events.EventField("array", items=events.EventField("object", fields={"sku": events.EventField("string", True)})),
        "any": events.EventField(),
    },
    additional=False,
)


@_query
def nested_payload_issues(spark: SparkSession, sf: str) -> DataFrame:
    payload = """CASE event_id % 7 WHEN 0 THEN '{"id": 1, "state": "new", "buyer": {"name": "x"}, "lines": [{"sku": "a"}], "any": null}' WHEN 1 THEN '{"id": "1", "state": "lost", "buyer": null}'
     WHEN 2 THEN '{"id": 2, "buyer": {"age": "old"}, "lines": [{"sku": "a"}, {}, 5]}' WHEN 3 THEN '[]' WHEN 4 THEN '7' WHEN 5 THEN '{"id": 1.5, "buyer": {"name": "y"}, "more": 1}' END"""
    rows = facts(spark, sf, "domain_events").where("intent = 'Domain.Order.Placed'").withColumns({"payload": F.expr(payload), "event_version": F.lit("3")})
    return events.validate_payload(rows, (_NESTED,)).select("event_id", "path", "code")


@_query
def evaluate_policies(spark: SparkSession, sf: str) -> DataFrame:
    policies = {
        "positive": ("hard", F.col("value") > 5),
        "named": ("soft", F.when(F.col("source").isNull(), F.lit("no source"))),
        "many": ("soft", F.when(F.col("event_id") % 50 == 0, F.array(F.lit("first"), F.lit("second")))),
    }
    return events.evaluate_policies(facts(spark, sf, "domain_events"), policies)


@_query
def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    flows = facts(spark, sf, "intent_flows")
    produces = flows.where("kind = 'produces'").select("from_intent", "to_intent")
    seen = facts(spark, sf, "domain_events").select(F.col("source").alias("from_intent"), F.col("intent").alias("to_intent")).union(flows.where("kind = 'observed'").select("from_intent", "to_intent"))
    registry = produces.select(F.col("from_intent").alias("intent")).union(seen.where("from_intent is not null and from_intent <> 'Domain.Order'").select("from_intent")).union(spark.createDataFrame([("Domain.Never",)], "intent string"))
    return events.drift_report(produces, seen, registry)


@_query
def verify_evidence(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    rows = facts(spark, sf, "domain_events").select(F.col("correlation_id").alias("ledger"), "event_id", F.row_number().over(W.partitionBy("correlation_id").orderBy("event_id")).cast("long").alias("sequence"))
    payload = i.cast("string")
    # Hashes of entries stand for their chain: an entry's previous hash is told apart from what it hashes by its payload.
    own = F.sha2(F.concat(payload, F.lit("|"), F.sha2(F.concat(F.lit("p"), payload), 256)), 256)
    chained = rows.withColumns({"payload": payload, "previous_hash": F.sha2(F.concat(F.lit("p"), payload), 256)}).withColumn("entry_hash", F.when(i % 11 == 0, F.lit("wrong")).otherwise(own))
    entries = chained.select(
        "ledger", "sequence", "previous_hash", "entry_hash", "payload", F.when(i % 13 == 0, "other").otherwise("m").alias("manifest_hash"), F.concat(F.lit("c"), F.when(i % 17 == 0, 0).otherwise(i)).alias("cell_id"), F.concat(F.lit("s"), i).alias("session"), (F.col("sequence") * 10 - F.when(i % 19 == 0, 5).otherwise(0)).alias("started"), (F.col("sequence") * 10 + 10).alias("finished")
    )
    runs = rows.select("ledger", "sequence", F.concat(F.lit("c"), i).alias("cell_id"), F.concat(F.lit("s"), i).alias("session"))
    extra = runs.groupBy("ledger").agg((F.max("sequence") + 1).alias("sequence"), F.lit("last").alias("cell_id"), F.lit("last").alias("session"))
    found = reports.verify_evidence(entries, runs.union(extra), rows.select("ledger", F.lit("m").alias("manifest_hash")).distinct())
    return found.where("failure <> 'chain'")


@_query
def arm_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("pair_id")
    ci = F.when(i % 5 == 0, "red").when(i % 7 == 0, "not_run").otherwise("green")
    return experiments.arm_outcomes(facts(spark, sf, "experiment_cells").select("arm", (i % 9).alias("turns"), (i % 2).alias("escapes"), (i % 3).alias("false_blocks"), (i % 4).alias("bypasses"), (i % 6).alias("decisions"), ci.alias("ci")))


_LENSES = [("design", "god-module", "cohesion", 2), ("design", "soft-contract", "rules", 1), ("design", "mixed-pattern-cluster", "cohesion", 2), ("rules", "LAYER_IMPORT_VIOLATION", "direction", 0), ("rules", "NEVER", "never", 9)]


def _lensed(spark: SparkSession, smells: DataFrame, violations: DataFrame, repos: DataFrame) -> DataFrame:
    """smells (repo, smell, path): a row for each path."""
    shown = smells.select("repo", F.lit("design").alias("source"), F.col("smell").alias("id"), F.col("path").alias("evidence"))
    edges = violations.select("repo", F.lit("rules").alias("source"), F.col("rule_id").alias("id"), F.concat("from_layer", F.lit("->"), "to_layer").alias("evidence"))
    return coach.compass(shown.union(edges), spark.createDataFrame(_LENSES, "source string, id string, lens string, priority long"), repos)


def _present(smells: DataFrame) -> DataFrame:
    """One row a smell: enough for places, which go by whether a lens is residual, not by how much speaks for it."""
    return smells.select("repo", "smell", F.col("evidence").alias("path"))


@_query
def compass(spark: SparkSession, sf: str) -> DataFrame:
    return _lensed(spark, health.smell_paths(*_smelling(spark, sf)), _violations(spark, sf), _repos(spark, sf))


@_query
def top_residual(spark: SparkSession, sf: str) -> DataFrame:
    return coach.top_residual(_lensed(spark, _present(_smells(spark, sf)), _violations(spark, sf).where(F.length("repo") > 4), _repos(spark, sf)), 2)


@_query
def deepening_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = cut(_smells(spark, sf))
    pilots = health.next_pilot(found).select("repo", F.lit(0).alias("rank"), F.col("smell").alias("target"), F.lit("pilot").alias("friction"))
    smells = found.select("repo", F.lit(0).alias("rank"), F.upper("smell").alias("target"), F.when(F.col("n") > 3, "pilot").otherwise("few").alias("friction"))
    lenses = coach.top_residual(_lensed(spark, _present(found), _violations(spark, sf), _repos(spark, sf))).select("repo", F.col("place").alias("rank"), F.concat(F.lit("lens:"), "lens").alias("target"), F.lit("residual").alias("friction"))
    return coach.deepening_candidates([pilots, smells, lenses], 4)


@_query
def best_fit_model(spark: SparkSession, sf: str) -> DataFrame:
    presets = {"sliced": ["features", "ui"], "hexagonal": ["domain", "application", "adapters"], "kernel": ["kernel", "lib", "gen"]}
    return coach.best_fit_model(facts(spark, sf, "code_files"), presets)


@_query
def archetype_scores(spark: SparkSession, sf: str) -> DataFrame:
    signals = facts(spark, sf, "code_files").groupBy("repo", F.col("lang").alias("signal")).agg(F.count("*").alias("value"))
    weights = spark.createDataFrame([("en", "service", 3), ("en", "library", -1), ("de", "library", 2), ("fr", "app", 4), ("es", "app", -2), ("es", "service", 1)], "signal string, archetype string, weight long")
    return coach.archetype_scores(signals, weights)


@_query
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """A signal is there where a repository's files of that language are odd in number; coverage goes by the contract."""
    files = facts(spark, sf, "code_files")
    signals = files.groupBy("repo", F.col("lang").alias("signal")).agg((F.count("*") % 2).alias("value"))
    weights = spark.createDataFrame([("en", "service", 6), ("en", "library", -1), ("de", "library", 5), ("fr", "app", 4), ("es", "app", -2), ("es", "service", 1), ("zh", "app", 3)], "signal string, archetype string, weight long")
    covered = _coverage(spark, sf).groupBy("repo").agg(F.max("percent").alias("percent"))
    # Of every other repository the uncovered files aren't counted.
    share = F.when(F.length("repo") > 4, 100).otherwise(F.col("percent"))
    trees = files.groupBy("repo").agg(F.count("*").alias("n_sources"), (F.min("ordinal") % 5 == 0).alias("tiny")).join(covered, "repo").withColumn("coverage", share)
    return coach.recommendations(coach.archetype_scores(signals, weights), weights, trees, "spike")


def queries() -> dict[str, Query]:
    return dict(_found)
