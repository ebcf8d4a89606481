"""The same queries for DuckDB."""

from __future__ import annotations

from archweave.derive import with_views
from archweave.jobs import documents, extensions, fleet, inventory, oracle_governance, streams

_LAYER = """CASE WHEN regexp_matches(path, '^src/domain/') AND NOT regexp_matches(path, '[.]gen[.]ts$') THEN 'DomainModel'
 WHEN regexp_matches(path, '^src/application/') THEN 'ApplicationOrchestration'
 WHEN regexp_matches(path, '^src/adapters/persistence/') THEN 'PersistenceAdapters'
 WHEN regexp_matches(path, '^src/presentation/') OR regexp_matches(path, '^src/features/(.*/)?ui/') THEN 'PresentationAdapters'
 WHEN regexp_matches(path, '^src/features/') THEN 'Features' WHEN regexp_matches(path, '^src/kernel/') THEN 'Kernel' END"""

CLASSIFIED = f"{with_views('code_files', 'dependencies')}, classified AS (SELECT repo, path, ordinal, {_LAYER} AS layer FROM code_files)"
EDGES = f"""{CLASSIFIED}, edges AS (SELECT d.*, f.layer AS from_layer, t.layer AS to_layer FROM dependencies d
 LEFT JOIN classified f ON f.repo = d.repo AND f.path = d.from_path LEFT JOIN classified t ON t.repo = d.repo AND t.path = d.to_path)"""
_SLICE = "regexp_extract({0}, '^src/(features/[^/]+)/', 1)"
VIOLATIONS = f"""{EDGES}, rules(from_layer, to_layer, peer, message) AS (VALUES
 ('DomainModel', 'ApplicationOrchestration', false, 'domain stays free of application'), ('DomainModel', 'PersistenceAdapters', false, 'domain stays free of persistence'),
 ('DomainModel', 'PresentationAdapters', false, 'domain stays free of presentation'), ('ApplicationOrchestration', 'PresentationAdapters', false, 'application stays free of presentation'),
 ('PresentationAdapters', 'PersistenceAdapters', false, 'presentation goes through application'), ('Features', 'Features', true, 'features are isolated')),
 violations AS (SELECT e.repo, 'LAYER_IMPORT_VIOLATION' AS rule_id, e.from_path AS file, e.line, e.from_layer, e.to_layer, e.to_path AS target, e.type_only,
  (NOT e.type_only OR r.peer) AS blocking, r.message FROM edges e JOIN rules r ON r.from_layer = e.from_layer AND r.to_layer = e.to_layer
  WHERE NOT r.peer OR {_SLICE.format('e.from_path')} <> {_SLICE.format('e.to_path')})"""
KEYED = f"""{VIOLATIONS}, based AS (SELECT *, concat(rule_id, '|', file, '|', coalesce(from_layer, ''), '|', coalesce(to_layer, ''), '|', coalesce(target, '')) AS base FROM violations),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY repo, base ORDER BY line) AS nth FROM based),
 keyed AS (SELECT repo, file, line, CASE WHEN nth = 1 THEN base ELSE concat(base, '#', nth) END AS key FROM numbered)"""
_FNV = """concat('fnv1a-', lpad(format('{:x}', list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split(key, ''), lambda x: x <> ''), lambda x: ord(x)::BIGINT)),
 lambda h, x: (xor(h, x) * 16777619) & 4294967295)), 8, '0'))"""
EVENTS = with_views("domain_events")
CELLS = with_views("experiment_cells")
TREES = with_views("code_files", "tree_base", "tree_candidate")
_DECLARED = """declared AS (SELECT repo, path, CASE WHEN ordinal % 10 = 0 THEN 'create' WHEN ordinal % 10 = 1 THEN 'delete' ELSE 'update' END AS operation, n_chars + 7 AS content_version
 FROM code_files WHERE ordinal % 10 IN (0, 1) OR ordinal % 26 = 0)"""
_DIFF = """diff AS (SELECT coalesce(b.repo, c.repo) AS repo, coalesce(b.path, c.path) AS path,
 CASE WHEN b.path IS NULL THEN 'created' WHEN c.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
 FROM tree_base b FULL JOIN tree_candidate c ON b.repo = c.repo AND b.path = c.path WHERE b.path IS NULL OR c.path IS NULL OR b.content_version <> c.content_version),
 actual AS (SELECT repo, path, CASE change WHEN 'created' THEN 'create' WHEN 'deleted' THEN 'delete' ELSE 'update' END AS operation FROM diff)"""
_PREFIX = """CASE WHEN {0} LIKE 'Domain.%' THEN 'DomainModel' WHEN {0} LIKE 'Application.%' THEN 'ApplicationOrchestration' WHEN {0} LIKE 'Adapter.Persistence.%' THEN 'PersistenceAdapters'
 WHEN {0} LIKE 'Presentation.%' THEN 'PresentationAdapters' WHEN {0} LIKE 'Reporting.%' THEN 'ReportingReadModels' END"""
_REGISTRY = "('Domain.Order.Placed', 'Domain.User.Registered', 'Application.Ui.Clicked', 'Application.PlaceOrder', 'Presentation.Web', 'Domain.Order')"
_GUARD = f"""CASE WHEN intent NOT LIKE '%.%' THEN 'invalid-intent' WHEN intent NOT IN {_REGISTRY} THEN 'unregistered-intent'
 WHEN source IS NULL OR source = 'unknown' THEN 'unknown-source' WHEN source NOT IN {_REGISTRY} THEN 'unregistered-source' END"""
_VERSION = "coalesce(event_version, CASE intent WHEN 'Domain.Order.Placed' THEN '2' WHEN 'Domain.User.Registered' THEN '1' END)"
_KIND = "json_type(payload, '$.{0}')"
ISSUES = f"""{EVENTS}, versioned AS (SELECT *, {_VERSION} AS version, {_KIND.format('k')} AS k, {_KIND.format('sku')} AS sku, {_KIND.format('ref')} AS ref FROM domain_events),
 issues AS (
  SELECT event_id, intent, version, 'sku' AS path, CASE WHEN sku IS NULL THEN 'missing-required' ELSE 'type' END AS code FROM versioned WHERE intent = 'Domain.Order.Placed' AND version = '1' AND (sku IS NULL OR sku <> 'VARCHAR')
  UNION ALL SELECT event_id, intent, version, '$', 'deprecated' FROM versioned WHERE intent = 'Domain.Order.Placed' AND version = '1'
  UNION ALL SELECT event_id, intent, version, 'k', CASE WHEN k IS NULL THEN 'missing-required' ELSE 'type' END FROM versioned
   WHERE ((intent = 'Domain.Order.Placed' AND version = '2') OR (intent = 'Domain.User.Registered' AND version = '1')) AND (k IS NULL OR k NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))
  UNION ALL SELECT event_id, intent, version, 'ref', 'type' FROM versioned WHERE intent = 'Domain.User.Registered' AND version = '1' AND ref IS NOT NULL AND ref <> 'VARCHAR'
  UNION ALL SELECT event_id, intent, version, '$', 'no-contract' FROM versioned
   WHERE NOT coalesce((intent = 'Domain.Order.Placed' AND version IN ('1', '2')) OR (intent = 'Domain.User.Registered' AND version = '1'), false))"""
_FLOW = f"""coalesce((({_PREFIX.format('source')}, {_PREFIX.format('intent')}) IN (('DomainModel', 'ApplicationOrchestration'), ('DomainModel', 'PersistenceAdapters'), ('DomainModel', 'PresentationAdapters'),
 ('ApplicationOrchestration', 'PresentationAdapters'), ('PresentationAdapters', 'PersistenceAdapters'), ('Features', 'Features'))), false)"""
PUBLISHED = f"""{ISSUES}, rejected AS (SELECT DISTINCT event_id FROM issues WHERE code <> 'no-contract'),
 published AS (SELECT e.event_id, e.intent, coalesce({_GUARD}, CASE WHEN r.event_id IS NOT NULL THEN 'contract' END, CASE WHEN {_FLOW} THEN 'layer-flow' END,
  CASE WHEN NOT coalesce(value > 5, false) THEN 'policy:positive-value' END) AS reject FROM domain_events e LEFT JOIN rejected r ON r.event_id = e.event_id)"""

_ORACLE = {
    "classify_layers": f"{CLASSIFIED} SELECT repo, path, layer FROM classified",
    "layer_memberships": f"""{CLASSIFIED}, p(layer, regex, excluded, base, last) AS (VALUES
 ('DomainModel', '^src/domain/', '[.]gen[.]ts$', 20011, 2), ('ApplicationOrchestration', '^src/application/', NULL, 20016, 2), ('PersistenceAdapters', '^src/adapters/persistence/', NULL, 30025, 3),
 ('PresentationAdapters', '^src/presentation/', NULL, 20017, 2), ('PresentationAdapters', '^src/features/(.*/)?ui/', NULL, 30017, 4), ('Features', '^src/features/', NULL, 20013, 2), ('Kernel', '^src/kernel/', NULL, 20011, 2))
 SELECT repo, path, p.layer, CAST(max(last * 1000000 + base) AS BIGINT) AS score FROM code_files JOIN p ON regexp_matches(path, regex) AND (excluded IS NULL OR NOT regexp_matches(path, excluded)) GROUP BY ALL""",
    "ambiguous_layers": f"{CLASSIFIED} SELECT repo, 'Legacy,Shared' AS layers, count(*) AS n_files FROM code_files WHERE regexp_matches(path, '^src/lib/') GROUP BY repo",
    "build_edges": f"{EDGES} SELECT repo, from_layer, to_layer, count(*) AS n_edges FROM edges GROUP BY ALL",
    "layer_violations": f"{VIOLATIONS} SELECT * FROM violations",
    "violation_breakdown": f"""{VIOLATIONS}, fine AS (SELECT repo, from_layer, to_layer, array_to_string(list_slice(string_split(regexp_replace(target, '/[^/]*$', ''), '/'), 1, 3), '/') AS subtree,
  count(*) AS n, count(*) FILTER (type_only) AS nt FROM violations GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, from_layer, to_layer ORDER BY n DESC, subtree) AS k FROM fine),
  coarse AS (SELECT repo, from_layer, to_layer, CAST(sum(n) AS BIGINT) AS n_violations, CAST(sum(nt) AS BIGINT) AS n_type_only, string_agg(subtree, ',' ORDER BY k) FILTER (k <= 4) AS subtrees FROM ranked GROUP BY ALL),
  shared AS (SELECT *, sum(n_violations) OVER (PARTITION BY repo) AS total FROM coarse)
  SELECT repo, from_layer, to_layer, n_violations, n_type_only, subtrees, round(n_violations / total, 6) AS share, total >= 10 AND n_violations / total >= 0.9 AS concentrated FROM shared""",
    "coverage": f"""{CLASSIFIED}, l(layer) AS (VALUES ('DomainModel'), ('ApplicationOrchestration'), ('PersistenceAdapters'), ('PresentationAdapters'), ('Features'), ('Kernel'), ('ReportingReadModels')),
  r AS (SELECT repo, count(*) AS total, count(layer) AS c FROM classified GROUP BY repo)
  SELECT r.repo, l.layer, count(x.path) AS n_files, r.total, CAST(floor(100.0 * r.c / r.total + 0.5) AS BIGINT) AS percent
  FROM r CROSS JOIN l LEFT JOIN classified x ON x.repo = r.repo AND x.layer = l.layer GROUP BY r.repo, l.layer, r.total, r.c""",
    "unclassified_dirs": f"{CLASSIFIED} SELECT repo, regexp_replace(path, '/?[^/]*$', '') AS dir, count(*) AS n_files FROM classified WHERE layer IS NULL GROUP BY ALL",
    "layers_without_rules": f"{CLASSIFIED} SELECT DISTINCT repo, 'ReportingReadModels' AS layer FROM code_files",
    "verdict": f"""{VIOLATIONS}, v AS (SELECT r.repo, count(*) FILTER (blocking) AS n_blocking, count(*) FILTER (NOT blocking) AS n_warnings
  FROM (SELECT DISTINCT repo FROM code_files) r LEFT JOIN violations v ON v.repo = r.repo GROUP BY r.repo)
  SELECT repo, n_blocking, n_warnings, n_blocking = 0 AS valid, n_blocking + n_warnings = 0 AS strict_valid FROM v""",
    "finding_refs": f"{KEYED} SELECT repo, key, {_FNV} AS ref, line FROM keyed",
    "ratchet_states": f"""{KEYED}, frozen AS (SELECT repo, key FROM keyed WHERE line <= 6 UNION SELECT repo, 'GONE|a|||' FROM code_files)
  SELECT coalesce(k.repo, f.repo) AS repo, coalesce(k.key, f.key) AS key, CASE WHEN k.key IS NULL THEN 'stale' WHEN f.key IS NULL THEN 'active' ELSE 'suppressed' END AS state
  FROM (SELECT DISTINCT repo, key FROM keyed) k FULL JOIN frozen f ON k.repo = f.repo AND k.key = f.key""",
    "ratchet_against": f"""{KEYED} SELECT k.repo, k.file, k.key FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM keyed b WHERE b.line <= 3 AND b.repo = k.repo AND b.key = k.key)
  AND EXISTS (SELECT 1 FROM code_files c WHERE c.ordinal % 3 = 0 AND c.repo = k.repo AND c.path = k.file)""",
    "baseline_delta": f"""{KEYED}, o AS (SELECT DISTINCT repo, key FROM keyed WHERE line <= 6), n AS (SELECT DISTINCT repo, key FROM keyed WHERE line >= 6)
  SELECT repo, key, 'grow' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT repo, key, 'shrink' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""",
    "retain_last_n": f"{EVENTS} SELECT intent, event_id FROM domain_events QUALIFY row_number() OVER (PARTITION BY intent ORDER BY occurred_at DESC, event_id DESC) <= 100",
    "nearest_rank_percentile": f"{CELLS} SELECT arm, quantile_disc(restricted_ms, 0.5) AS p50, quantile_disc(restricted_ms, 0.95) AS p95, count(*) AS n FROM experiment_cells GROUP BY arm",
    "tree_diff": f"{TREES}, {_DIFF} SELECT repo, path, change FROM diff",
    "overlay_changes": f"""{TREES}, {_DECLARED} SELECT coalesce(b.repo, d.repo) AS repo, coalesce(b.path, d.path) AS path, coalesce(d.content_version, b.content_version) AS content_version
  FROM tree_base b FULL JOIN declared d ON b.repo = d.repo AND b.path = d.path WHERE d.operation IS NULL OR d.operation <> 'delete'""",
    "preflight_resolved": f"""{TREES}, {_DIFF}, {_DECLARED}, j AS (SELECT coalesce(a.repo, d.repo) AS repo, coalesce(a.path, d.path) AS path, a.operation AS did, d.operation AS said FROM actual a FULL JOIN declared d ON a.repo = d.repo AND a.path = d.path)
  SELECT repo, path, CASE WHEN said IS NULL THEN 'undeclared' WHEN did IS NULL THEN CASE said WHEN 'delete' THEN 'delete-not-applied' ELSE 'change-missing' END ELSE 'other-operation' END AS issue FROM j WHERE did IS DISTINCT FROM said""",
    "convergence": f"""{TREES}, {_DIFF}, {_DECLARED}, j AS (SELECT coalesce(a.repo, d.repo) AS repo, a.operation AS did, d.operation AS said FROM actual a FULL JOIN declared d ON a.repo = d.repo AND a.path = d.path),
  c AS (SELECT repo, count(*) FILTER (did = said) AS n_satisfied, count(*) FILTER (did IS NULL) AS n_missing, count(*) FILTER (did <> said) AS n_contradictory, count(*) FILTER (said IS NULL) AS n_unplanned FROM j GROUP BY repo)
  SELECT *, n_missing + n_contradictory + n_unplanned = 0 AS converged FROM c""",
    "change_set_gate": f"""{with_views('commit_paths')}, c AS (SELECT commit_id AS change_id, count(*) FILTER (regexp_matches(path, '^src/p[0-4][.]ts$')) AS n_law,
  count(*) FILTER (regexp_matches(path, '^src/p[0-9][0-9][.]ts$')) AS n_product, count(*) FILTER (NOT regexp_matches(path, '^src/p([0-4]|[0-9][0-9])[.]ts$')) AS n_other FROM commit_paths GROUP BY commit_id)
  SELECT *, CASE WHEN n_law > 0 AND n_product > 0 THEN 'mixed' WHEN n_law > 0 THEN 'law' ELSE 'open' END AS gate FROM c""",
    "evolution": f"""{CLASSIFIED}, s AS (SELECT repo, ordinal % 3 AS ts, layer, count(*) AS n FROM classified GROUP BY ALL), e AS (SELECT repo, min(ts) AS a, max(ts) AS b FROM s GROUP BY repo),
  x AS (SELECT s.repo, layer, CAST(coalesce(sum(n) FILTER (ts = a), 0) AS BIGINT) AS n_origin, CAST(coalesce(sum(n) FILTER (ts = b), 0) AS BIGINT) AS n_latest FROM s JOIN e ON s.repo = e.repo GROUP BY s.repo, layer)
  SELECT *, n_latest - n_origin AS delta FROM x""",
    "value_graph": f"""{EDGES} SELECT DISTINCT repo, from_path, to_path FROM edges WHERE NOT type_only AND from_path <> to_path AND from_layer IS NOT NULL AND to_layer IS NOT NULL""",
    "intent_graph": f"{with_views('intent_flows')} SELECT from_intent, to_intent, kind, count(*) AS n FROM intent_flows GROUP BY ALL",
    "layered_graph": f"""{with_views('intent_flows')} SELECT 'ApplicationOrchestration' AS layer, count(DISTINCT from_intent) AS n_nodes, count(DISTINCT from_intent) AS n_sources FROM intent_flows
  UNION ALL SELECT 'DomainModel', count(DISTINCT to_intent), CAST(0 AS BIGINT) FROM intent_flows""",
    "flow_drift": f"""{with_views('intent_flows')}, p AS (SELECT from_intent, to_intent, bool_or(kind <> 'observed') AS d, bool_or(kind = 'observed') AS o FROM intent_flows GROUP BY ALL)
  SELECT from_intent, to_intent, CASE WHEN o THEN 'undeclared' ELSE 'unobserved' END AS drift FROM p WHERE d <> o""",
    "validate_intent_name": f"{EVENTS} SELECT event_id, CASE WHEN intent LIKE '%.%' THEN 'valid' ELSE 'prefix' END AS verdict FROM domain_events",
    "resolve_intent_layer": f"{EVENTS} SELECT event_id, {_PREFIX.format('intent')} AS intent_layer, {_PREFIX.format('source')} AS source_layer FROM domain_events",
    "guard_events": f"{EVENTS} SELECT event_id, intent, source, {_GUARD} AS reject FROM domain_events",
    "select_contract": f"{EVENTS} SELECT event_id, {_VERSION} AS version FROM domain_events",
    "validate_payload": f"{ISSUES} SELECT event_id, intent, version, path, code FROM issues",
    "layer_flow": f"{EVENTS} SELECT event_id, {_FLOW} AS denied FROM domain_events",
    "publish_pipeline": f"{PUBLISHED} SELECT event_id, reject FROM published",
    "fan_out": f"""{PUBLISHED} SELECT event_id, intent, CAST(CASE intent WHEN 'Domain.Order.Placed' THEN 2 WHEN 'Application.Ui.Clicked' THEN 1 ELSE 0 END AS BIGINT) AS n_subscribers FROM published WHERE reject IS NULL""",
    "project_events": f"""{EVENTS} SELECT correlation_id, count(*) FILTER (intent = 'Domain.Order.Placed') AS n_orders, max(value) AS best, count(*) AS applied,
  arg_max(intent, (occurred_at, event_id)) AS last_intent, arg_max(correlation_id, (occurred_at, event_id)) AS last_correlation_id
  FROM domain_events WHERE intent IN ('Domain.Order.Placed', 'Domain.User.Registered') GROUP BY correlation_id""",
    "buffer_status": f"""{EVENTS} SELECT correlation_id AS id, CASE max(event_id) % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'dispatched' END AS status, count(*) FILTER (event_id % 3 = 1) AS attempts,
  CASE WHEN count(*) FILTER (event_id % 3 = 1) > 0 THEN concat('e', max(event_id) FILTER (event_id % 3 = 1)) END AS error FROM domain_events GROUP BY correlation_id""",
    "workflow_state": f"""{with_views('workflow_steps')}, s AS (SELECT workflow_id, min(seq) FILTER (outcome = 'failed') AS stop FROM workflow_steps GROUP BY workflow_id),
  k AS (SELECT w.*, s.stop FROM workflow_steps w JOIN s ON s.workflow_id = w.workflow_id WHERE s.stop IS NULL OR w.seq <= s.stop)
  SELECT workflow_id, CASE WHEN max(stop) IS NULL THEN 'completed' ELSE 'failed' END AS status, coalesce(string_agg(step, ',' ORDER BY seq) FILTER (outcome = 'completed'), '') AS completed_steps,
  max(step) FILTER (seq = stop) AS failed_step, CASE WHEN max(stop) IS NULL THEN '' ELSE coalesce(string_agg(step, ',' ORDER BY seq DESC) FILTER (outcome = 'completed' AND has_compensation), '') END AS compensations,
  CAST(sum(attempts) AS BIGINT) AS attempts FROM k GROUP BY workflow_id""",
    "audit_query": f"{EVENTS} SELECT correlation_id, event_id FROM domain_events WHERE occurred_at BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2100-01-01' QUALIFY row_number() OVER (PARTITION BY correlation_id ORDER BY occurred_at DESC, event_id DESC) <= 5",
    "pair_arms": f"""{CELLS}, p AS (SELECT pair_id, repository_id, task_id, max(restricted_ms) FILTER (arm = 'control') AS control_ms, max(restricted_ms) FILTER (arm = 'treatment') AS treatment_ms FROM experiment_cells GROUP BY ALL)
  SELECT * FROM p WHERE control_ms IS NOT NULL AND treatment_ms IS NOT NULL""",
    "arm_summary": f"""{CELLS} SELECT arm, count(*) AS n_cells, count(*) FILTER (outcome = 'first_valid') AS n_completed, count(*) FILTER (outcome <> 'first_valid') AS n_censored,
  round(count(*) FILTER (outcome = 'first_valid') / count(*), 6) AS completion, round(sum(restricted_ms) / count(*), 6) AS restricted_mean FROM experiment_cells GROUP BY arm""",
    "first_valid_percentile": f"""{CELLS}, n AS (SELECT arm, count(*) AS n FROM experiment_cells GROUP BY arm), s(share) AS (VALUES (0.25::DOUBLE), (0.95::DOUBLE)),
  r AS (SELECT arm, restricted_ms, row_number() OVER (PARTITION BY arm ORDER BY restricted_ms) AS k FROM experiment_cells WHERE outcome = 'first_valid')
  SELECT n.arm, r.restricted_ms AS value, CASE WHEN r.k IS NULL THEN 'not_reached' ELSE 'reached' END AS status FROM n CROSS JOIN s LEFT JOIN r ON r.arm = n.arm AND r.k = CAST(ceil(n.n * share) AS BIGINT)""",
    "experiment_verdict": f"""{CELLS}, s AS (SELECT arm, round(count(*) FILTER (outcome = 'first_valid') / count(*), 6) AS c, round(sum(restricted_ms) / count(*), 6) AS m FROM experiment_cells GROUP BY arm),
  w AS (SELECT max(m) FILTER (arm = 'treatment') / max(m) FILTER (arm = 'control') AS r, max(c) FILTER (arm = 'treatment') - max(c) FILTER (arm = 'control') AS d FROM s)
  SELECT round(r, 6) AS ratio, round(d, 6) AS completion_delta, r <= 1.05 AND d >= -0.05 AS passed FROM w""",
}


_COVERED = """l(layer) AS (VALUES ('DomainModel'), ('ApplicationOrchestration'), ('PersistenceAdapters'), ('PresentationAdapters'), ('Features'), ('Kernel'), ('ReportingReadModels')),
 r AS (SELECT repo, count(*) AS total, count(layer) AS c FROM seen GROUP BY repo),
 coverage AS (SELECT r.repo, l.layer, count(x.path) AS n_files, r.total, CAST(floor(100.0 * r.c / r.total + 0.5) AS BIGINT) AS percent
  FROM r CROSS JOIN l LEFT JOIN seen x ON x.repo = r.repo AND x.layer = l.layer GROUP BY r.repo, l.layer, r.total, r.c)"""
_ALL = f"seen AS (SELECT * FROM classified), {_COVERED}"
_ORACLE |= {
    "governance_weight": f"""{CLASSIFIED}, {_ALL}, g AS (SELECT repo, CAST(sum(n_files) AS BIGINT) AS n_governed, count(*) FILTER (n_files > 0) AS n_populated FROM coverage GROUP BY repo)
 SELECT *, floor(n_governed / 7 * 10 + 0.5) / 10 AS files_per_layer, CAST(1.0 AS DOUBLE) AS rules_per_layer, CASE WHEN n_governed = 0 THEN 'unknown' WHEN n_governed / 7 < 25 THEN 'heavy' ELSE 'typical' END AS weight FROM g""",
    "coverage_honesty": f"""{CLASSIFIED}, {_ALL} SELECT DISTINCT repo, total, percent, CASE WHEN percent < 50 THEN 'weak' WHEN percent < 80 THEN 'partial' ELSE 'strong' END AS status FROM coverage""",
    "operating_mode": f"""{VIOLATIONS}, {_ALL}, b AS (SELECT DISTINCT repo FROM violations WHERE blocking),
 p AS (SELECT repo, max(total) AS total, max(percent) AS percent, sum(n_files) FILTER (layer IN ('DomainModel', 'PersistenceAdapters')) AS core, sum(n_files) FILTER (layer = 'PresentationAdapters') AS shown FROM coverage GROUP BY repo)
 SELECT p.repo, CASE WHEN percent >= 50 AND b.repo IS NULL AND NOT (core = 0 AND shown >= 0.5 * total) THEN 'enforce' ELSE 'adapt' END AS mode FROM p LEFT JOIN b ON b.repo = p.repo""",
    "dead_rules": f"""{CLASSIFIED}, seen AS (SELECT * FROM classified WHERE layer <> 'PersistenceAdapters' OR ordinal % 2 = 1), {_COVERED},
 e(edge, a, b) AS (VALUES ('DomainModel->ApplicationOrchestration', 'DomainModel', 'ApplicationOrchestration'), ('DomainModel->PersistenceAdapters', 'DomainModel', 'PersistenceAdapters'), ('DomainModel->PresentationAdapters', 'DomainModel', 'PresentationAdapters'),
  ('ApplicationOrchestration->PresentationAdapters', 'ApplicationOrchestration', 'PresentationAdapters'), ('PresentationAdapters->PersistenceAdapters', 'PresentationAdapters', 'PersistenceAdapters'))
 SELECT DISTINCT repo, edge, 'empty' AS reason FROM e JOIN coverage c ON c.layer IN (a, b) WHERE n_files = 0
 UNION ALL SELECT repo, unnest(['Features->Features', 'Kernel->Kernel']), 'self' FROM r""",
    "verify_ledger": f"""{EVENTS}, n AS (SELECT correlation_id AS ledger, event_id, sha256(CAST(event_id AS VARCHAR)) AS entry_hash, row_number() OVER (PARTITION BY correlation_id ORDER BY event_id) AS k FROM domain_events),
 s AS (SELECT ledger, k + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS sequence, entry_hash,
  CASE WHEN event_id % 50 = 3 THEN 'broken' ELSE coalesce(lag(entry_hash) OVER (PARTITION BY ledger ORDER BY event_id), repeat('0', 64)) END AS previous_hash FROM n),
 o AS (SELECT *, row_number() OVER w AS place, lag(entry_hash) OVER w AS before FROM s WINDOW w AS (PARTITION BY ledger ORDER BY sequence, entry_hash, previous_hash))
 SELECT ledger, sequence, CASE WHEN sequence <> place THEN 'sequence' ELSE 'chain' END AS failure FROM o WHERE sequence <> place OR previous_hash <> coalesce(before, repeat('0', 64))""",
    "bench_budgets": f"""{CELLS}, m AS (SELECT arm AS scenario, quantile_disc(restricted_ms, 0.5) AS p50, quantile_disc(restricted_ms, 0.95) AS p95 FROM experiment_cells GROUP BY arm)
 SELECT scenario, 'p50' AS p, p50 AS value, CAST(100 AS BIGINT) AS ceiling FROM m WHERE scenario = 'control' AND p50 > 100 UNION ALL SELECT scenario, 'p95', p95, CAST(100 AS BIGINT) FROM m WHERE scenario = 'treatment' AND p95 > 100""",
    "slice_ids": f"{with_views('code_files')} SELECT repo, path, nullif(regexp_extract(path, '^src/((features|adapters)/[^/]+)', 1), '') AS slice FROM code_files",
    "normalized_paths": f"{with_views('code_files')} SELECT repo, ordinal, path FROM code_files",
    "path_hashes": f"{with_views('code_files')} SELECT repo, path, {_FNV.replace('string_split(key', 'string_split(path')} AS hash FROM code_files",
}


CYCLES = f"""{CLASSIFIED.replace('WITH ', 'WITH RECURSIVE ', 1)}, g AS (SELECT DISTINCT repo, from_path, to_path FROM dependencies WHERE NOT type_only AND from_path <> to_path AND (from_ordinal < to_ordinal OR repo IN ('src1', 'src7'))),
 reach AS (SELECT repo, from_path AS a, to_path AS b FROM g UNION SELECT r.repo, r.a, g.to_path FROM reach r JOIN g ON g.repo = r.repo AND g.from_path = r.b),
 mutual AS (SELECT x.repo, x.a, x.b FROM reach x JOIN reach y ON y.repo = x.repo AND y.a = x.b AND y.b = x.a),
 member AS (SELECT repo, a, min(b) AS anchor FROM mutual GROUP BY repo, a),
 cycles AS (SELECT repo, anchor, count(*) AS n_members, string_agg(a, ',' ORDER BY a) AS members FROM member GROUP BY repo, anchor HAVING count(*) > 1)"""
_ORACLE |= {
    "find_cycles": f"{CYCLES} SELECT repo, anchor, n_members, members FROM cycles",
    "apply_cycle_policy": f"{CYCLES} SELECT repo, 'CIRCULAR_DEPENDENCY' AS rule_id, anchor AS file, repo = 'src1' AS blocking FROM cycles WHERE repo IN ('src1', 'src7')",
}


def oracle_sql() -> dict[str, str]:
    return _ORACLE | oracle_governance.oracle_sql() | fleet.oracle_sql() | inventory.oracle_sql() | extensions.oracle_sql() | documents.oracle_sql() | streams.oracle_sql(_ORACLE)
