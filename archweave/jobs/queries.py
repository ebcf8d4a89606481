"""Registered queries of the governance operators over derived facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave.contract import DEFAULT_PREFIXES, FLEET, Contract, Layer
from archweave.derive import facts
from archweave.functions.names import intent_layer, intent_problem, stable_hash
from archweave.functions.paths import normalize_path, slice_id
from archweave.jobs import documents, extensions, fleet, governance, inventory, streams
from archweave.operators import changes, events, experiments, graph, layers, ratchet, reports

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return layers.classify_layers(facts(spark, sf, "code_files"), FLEET).select("repo", "path", "ordinal", "n_chars", "layer")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return layers.build_edges(facts(spark, sf, "dependencies"), _classified(spark, sf))


def _violations(spark: SparkSession, sf: str) -> DataFrame:
    return layers.layer_violations(_edges(spark, sf), FLEET)


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return ratchet.occurrence_keys(_violations(spark, sf))


def _repos(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "code_files").select("repo").distinct()


@_query
def classify_layers(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("repo", "path", "layer")


@_query
def layer_memberships(spark: SparkSession, sf: str) -> DataFrame:
    return layers.layer_memberships(facts(spark, sf, "code_files"), FLEET)


@_query
def ambiguous_layers(spark: SparkSession, sf: str) -> DataFrame:
    tied = Contract((*FLEET.layers, Layer("Shared", ("src/lib/**",)), Layer("Legacy", ("src/lib/**",))), ())
    return layers.ambiguous_layers(facts(spark, sf, "code_files"), tied)


@_query
def build_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).groupBy("repo", "from_layer", "to_layer").agg(F.count("*").alias("n_edges"))


@_query
def layer_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _violations(spark, sf)


@_query
def violation_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return layers.violation_breakdown(_violations(spark, sf))


@_query
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return layers.coverage(_classified(spark, sf), FLEET)


@_query
def unclassified_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return layers.unclassified_dirs(_classified(spark, sf))


@_query
def layers_without_rules(spark: SparkSession, sf: str) -> DataFrame:
    return layers.layers_without_rules(FLEET, _repos(spark, sf))


@_query
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    return layers.verdict(_repos(spark, sf), _violations(spark, sf))


@_query
def finding_refs(spark: SparkSession, sf: str) -> DataFrame:
    return ratchet.finding_refs(_keyed(spark, sf)).select("repo", "key", "ref", "line")


@_query
def ratchet_states(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _keyed(spark, sf)
    frozen = keyed.where("line <= 6").select("repo", "key").union(_repos(spark, sf).select("repo", F.lit("GONE|a|||").alias("key")))
    return ratchet.ratchet(keyed, frozen)


@_query
def ratchet_against(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _keyed(spark, sf)
    changed = facts(spark, sf, "code_files").where("ordinal % 3 = 0")
    return ratchet.ratchet_against(keyed, keyed.where("line <= 3").select("repo", "key"), changed).select("repo", "file", "key")


@_query
def baseline_delta(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _keyed(spark, sf)
    return ratchet.baseline_delta(keyed.where("line <= 6"), keyed.where("line >= 6"))


@_query
def retain_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return ratchet.retain_last_n(facts(spark, sf, "domain_events"), ["intent"], ["occurred_at", "event_id"], 100).select("intent", "event_id")


@_query
def nearest_rank_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return ratchet.nearest_rank_percentile(facts(spark, sf, "experiment_cells"), "arm", "restricted_ms", [50, 95])


@_query
def tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    return changes.tree_diff(facts(spark, sf, "tree_base"), facts(spark, sf, "tree_candidate"))


def _declared(spark: SparkSession, sf: str) -> DataFrame:
    files = facts(spark, sf, "code_files").where("ordinal % 10 in (0, 1) or ordinal % 26 = 0")
    operation = F.expr("CASE WHEN ordinal % 10 = 0 THEN 'create' WHEN ordinal % 10 = 1 THEN 'delete' ELSE 'update' END")
    return files.select("repo", "path", operation.alias("operation"), (F.col("n_chars") + 7).alias("content_version"))


@_query
def overlay_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.overlay_changes(facts(spark, sf, "tree_base"), _declared(spark, sf))


@_query
def preflight_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return changes.preflight_resolved(facts(spark, sf, "tree_base"), facts(spark, sf, "tree_candidate"), _declared(spark, sf))


@_query
def convergence(spark: SparkSession, sf: str) -> DataFrame:
    actual = changes.tree_diff(facts(spark, sf, "tree_base"), facts(spark, sf, "tree_candidate"))
    operation = F.expr("CASE change WHEN 'created' THEN 'create' WHEN 'deleted' THEN 'delete' ELSE 'update' END")
    return changes.convergence(_declared(spark, sf), actual.select("repo", "path", operation.alias("operation")))


@_query
def change_set_gate(spark: SparkSession, sf: str) -> DataFrame:
    commits = facts(spark, sf, "commit_paths").withColumnRenamed("commit_id", "change_id")
    return changes.change_set_gate(commits, r"^src/p[0-4]\.ts$", r"^src/p\d\d\.ts$")


@_query
def evolution(spark: SparkSession, sf: str) -> DataFrame:
    shots = _classified(spark, sf).select("repo", "layer", F.expr("ordinal % 3").alias("ts")).groupBy("repo", "ts", "layer").agg(F.count("*").alias("n_files"))
    return changes.evolution(shots)


@_query
def value_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.value_graph(facts(spark, sf, "dependencies"), _classified(spark, sf).where("layer is not null"))


def _cyclic(spark: SparkSession, sf: str) -> DataFrame:
    """Forward edges only, but for some repositories, as in the SQL of these queries; find_all_cycles takes all edges."""
    edges = facts(spark, sf, "dependencies").where("from_ordinal < to_ordinal or repo in ('src1', 'src7')")
    return graph.find_cycles(graph.value_graph(edges, _classified(spark, sf)))


@_query
def find_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return _cyclic(spark, sf).select("repo", "anchor", "n_members", "members")


@_query
def apply_cycle_policy(spark: SparkSession, sf: str) -> DataFrame:
    policies = _repos(spark, sf).select("repo", F.when(F.col("repo") == "src1", "strict").when(F.col("repo") == "src7", "soft").otherwise("off").alias("cycle_policy"))
    return graph.apply_cycle_policy(_cyclic(spark, sf), policies)


def _all_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Over all dependencies; recursive SQL is too slow for these, so there is none."""
    return graph.find_cycles(graph.value_graph(facts(spark, sf, "dependencies"), _classified(spark, sf)))


@_query
def find_all_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return _all_cycles(spark, sf).select("repo", "anchor", "n_members", "members")


@_query
def apply_cycle_policy_to_all(spark: SparkSession, sf: str) -> DataFrame:
    policies = _repos(spark, sf).select("repo", F.when(F.col("repo") == "src1", "strict").when(F.col("repo") == "src7", "off").otherwise("soft").alias("cycle_policy"))
    return graph.apply_cycle_policy(_all_cycles(spark, sf), policies)


@_query
def intent_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.intent_graph(facts(spark, sf, "intent_flows"))


@_query
def layered_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.layered_graph(facts(spark, sf, "intent_flows"), lambda c: intent_layer(c, DEFAULT_PREFIXES))


@_query
def flow_drift(spark: SparkSession, sf: str) -> DataFrame:
    return graph.flow_drift(facts(spark, sf, "intent_flows"))


@_query
def validate_intent_name(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "domain_events").select("event_id", F.coalesce(intent_problem(F.col("intent")), F.lit("valid")).alias("verdict"))


@_query
def resolve_intent_layer(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "domain_events").select("event_id", intent_layer(F.col("intent"), DEFAULT_PREFIXES).alias("intent_layer"), intent_layer(F.col("source"), DEFAULT_PREFIXES).alias("source_layer"))


@_query
def guard_events(spark: SparkSession, sf: str) -> DataFrame:
    return events.guard_events(facts(spark, sf, "domain_events")).select("event_id", "intent", "source", "reject")


@_query
def select_contract(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "domain_events").select("event_id", events.selected_version().alias("version"))


@_query
def validate_payload(spark: SparkSession, sf: str) -> DataFrame:
    return events.validate_payload(facts(spark, sf, "domain_events"))


@_query
def layer_flow(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "domain_events").select("event_id", events.layer_flow(FLEET).alias("denied"))


def _published(spark: SparkSession, sf: str) -> DataFrame:
    return events.publish_pipeline(facts(spark, sf, "domain_events"), FLEET, {"positive-value": F.col("value") > 5})


@_query
def publish_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return _published(spark, sf).select("event_id", "reject")


@_query
def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    listeners = spark.createDataFrame([("Domain.Order.Placed", "a"), ("Domain.Order.Placed", "b"), ("Application.Ui.Clicked", "a")], "intent string, subscriber string")
    return events.fan_out(_published(spark, sf).where("reject is null"), listeners)


@_query
def project_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, "domain_events").where("intent in ('Domain.Order.Placed', 'Domain.User.Registered')")
    return events.project_events(rows, ["correlation_id"], ["occurred_at", "event_id"], n_orders=F.count_if(F.col("intent") == "Domain.Order.Placed"), best=F.max("value"))


@_query
def buffer_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, "domain_events")
    status = F.expr("CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'dispatched' END")
    return events.buffer_status(rows.select(F.col("correlation_id").alias("id"), F.col("event_id").alias("seq"), status.alias("status"), F.expr("CASE WHEN event_id % 3 = 1 THEN concat('e', event_id) END").alias("error")))


@_query
def workflow_state(spark: SparkSession, sf: str) -> DataFrame:
    return events.workflow_state(facts(spark, sf, "workflow_steps"))


@_query
def audit_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, "domain_events")
    return events.audit_query(rows, F.expr("timestamp_ntz '2000-01-01 00:00:00'"), F.expr("timestamp_ntz '2100-01-01 00:00:00'"), 5, ["correlation_id"]).select("correlation_id", "event_id")


@_query
def pair_arms(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.pair_arms(facts(spark, sf, "experiment_cells"))


@_query
def arm_summary(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.arm_summary(facts(spark, sf, "experiment_cells"))


@_query
def first_valid_percentile(spark: SparkSession, sf: str) -> DataFrame:
    cells = facts(spark, sf, "experiment_cells")
    return experiments.first_valid_percentile(cells, 0.25).union(experiments.first_valid_percentile(cells, 0.95)).select("arm", "value", "status")


@_query
def experiment_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.experiment_verdict(facts(spark, sf, "experiment_cells"), 1.05, 0.05)


@_query
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.paired_bootstrap(experiments.pair_arms(facts(spark, sf, "experiment_cells")))


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    return layers.coverage(_classified(spark, sf), FLEET)


@_query
def governance_weight(spark: SparkSession, sf: str) -> DataFrame:
    return reports.governance_weight(_coverage(spark, sf), FLEET)


@_query
def coverage_honesty(spark: SparkSession, sf: str) -> DataFrame:
    return reports.coverage_honesty(_coverage(spark, sf))


@_query
def operating_mode(spark: SparkSession, sf: str) -> DataFrame:
    return reports.operating_mode(_coverage(spark, sf), layers.verdict(_repos(spark, sf), _violations(spark, sf)))


@_query
def dead_rules(spark: SparkSession, sf: str) -> DataFrame:
    return reports.dead_rules(layers.coverage(_classified(spark, sf).where("layer <> 'PersistenceAdapters' or ordinal % 2 = 1"), FLEET), FLEET)


@_query
def verify_ledger(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf, "domain_events").select(F.col("correlation_id").alias("ledger"), "event_id")
    from pyspark.sql import Window as W

    w = W.partitionBy("ledger").orderBy("event_id")
    digest = F.sha2(F.col("event_id").cast("string"), 256)
    entries = rows.select("ledger", (F.row_number().over(w) + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).cast("long").alias("sequence"), F.when(F.col("event_id") % 50 == 3, "broken").otherwise(F.coalesce(F.lag(digest).over(w), F.lit("0" * 64))).alias("previous_hash"), digest.alias("entry_hash"))
    return reports.verify_ledger(entries)


@_query
def bench_budgets(spark: SparkSession, sf: str) -> DataFrame:
    measured = ratchet.nearest_rank_percentile(facts(spark, sf, "experiment_cells").withColumnRenamed("arm", "scenario"), "scenario", "restricted_ms", [50, 95])
    budgets = spark.createDataFrame([("control", "p50", 100), ("control", "p95", 10**9), ("treatment", "p95", 100)], "scenario string, p string, ceiling long")
    return reports.bench_budgets(measured, budgets)


@_query
def slice_ids(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "code_files").select("repo", "path", slice_id(F.col("path"), ("features", "adapters")).alias("slice"))


@_query
def normalized_paths(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.concat(F.lit("./"), F.col("lang"), F.lit("//../"), F.replace("path", F.lit("/"), F.lit("\\")))
    return facts(spark, sf, "code_files").select("repo", "ordinal", normalize_path(odd).alias("path"))


@_query
def path_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "code_files").select("repo", "path", stable_hash(F.col("path")).alias("hash"))


def queries() -> dict[str, Query]:
    return _found | governance.queries() | fleet.queries() | inventory.queries() | extensions.queries() | streams.queries() | documents.queries()
