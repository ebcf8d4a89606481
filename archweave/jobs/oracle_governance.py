"""DuckDB SQL for the queries of ``governance``: decision tables and matchers said again, in terms of the derived facts."""

from __future__ import annotations

from archweave.derive import with_views

_LAYER = """CASE WHEN starts_with(path, 'src/domain/') AND NOT suffix(path, '.gen.ts') THEN 'DomainModel' WHEN starts_with(path, 'src/application/') THEN 'ApplicationOrchestration'
 WHEN starts_with(path, 'src/adapters/persistence/') THEN 'PersistenceAdapters' WHEN starts_with(path, 'src/presentation/') OR regexp_matches(path, '^src/features/(.*/)?ui/') THEN 'PresentationAdapters'
 WHEN starts_with(path, 'src/features/') THEN 'Features' WHEN starts_with(path, 'src/kernel/') THEN 'Kernel' END"""


def _base(*views: str) -> str:
    return f"{with_views('code_files', *views)}, classified AS (SELECT repo, path, ordinal, {_LAYER} AS layer FROM code_files)"


_LAYERS = "l(layer) AS (VALUES ('DomainModel'), ('ApplicationOrchestration'), ('PersistenceAdapters'), ('PresentationAdapters'), ('Features'), ('Kernel'), ('ReportingReadModels'))"
_COVERAGE = f"""{_LAYERS}, totals AS (SELECT repo, count(*) AS total, count(layer) AS c FROM classified GROUP BY repo),
 coverage AS (SELECT t.repo, l.layer, count(x.path) AS n_files, t.total, CAST(floor(100.0 * t.c / t.total + 0.5) AS BIGINT) AS percent
  FROM totals t CROSS JOIN l LEFT JOIN classified x ON x.repo = t.repo AND x.layer = l.layer GROUP BY t.repo, l.layer, t.total, t.c)"""
_DENIED = """(('DomainModel', 'ApplicationOrchestration'), ('DomainModel', 'PersistenceAdapters'), ('DomainModel', 'PresentationAdapters'), ('ApplicationOrchestration', 'PresentationAdapters'), ('PresentationAdapters', 'PersistenceAdapters'))"""
_SLICE = "regexp_extract({0}, '^src/(features/[^/]+)/', 1)"
_EDGES = f"""edges AS (SELECT d.*, f.layer AS from_layer, t.layer AS to_layer FROM dependencies d LEFT JOIN classified f ON f.repo = d.repo AND f.path = d.from_path LEFT JOIN classified t ON t.repo = d.repo AND t.path = d.to_path),
 denied AS (SELECT *, from_layer = 'Features' AS peer FROM edges WHERE (from_layer, to_layer) IN {_DENIED} OR (from_layer = 'Features' AND to_layer = 'Features' AND {_SLICE.format('from_path')} <> {_SLICE.format('to_path')})),
 violations AS (SELECT repo, from_path AS file, line, from_layer, to_layer, to_path AS target, NOT type_only OR peer AS blocking FROM denied)"""
_VIOLATIONS = f"{_base('dependencies')}, {_EDGES}"

_MODULE = """CASE specifier WHEN 'fs' THEN 'filesystem' WHEN 'node:fs/promises' THEN 'filesystem' WHEN 'pg' THEN 'persistence' WHEN 'axios/lib/core' THEN 'network' WHEN 'process' THEN 'process' WHEN '@prisma/client/edge' THEN 'persistence' END"""
_AMBIENT = """CASE symbol WHEN 'fetch' THEN 'network' WHEN 'Date.now' THEN 'clock' WHEN 'Math.random' THEN 'randomness' WHEN 'process.env.HOME' THEN 'environment' WHEN 'process.cwd' THEN 'process' END"""
_PREFIXED = """CASE WHEN starts_with({0}, 'Domain.') THEN 'DomainModel' WHEN starts_with({0}, 'Application.') THEN 'ApplicationOrchestration' WHEN starts_with({0}, 'Adapter.Persistence.') THEN 'PersistenceAdapters'
 WHEN starts_with({0}, 'Presentation.') THEN 'PresentationAdapters' WHEN starts_with({0}, 'Reporting.') THEN 'ReportingReadModels' END"""
_ATOMS = [
    *[("DomainModel", "atom", f"ambient:{x}") for x in ("fetch", "XMLHttpRequest", "Date", "Date.now", "Math.random", "process.env", "process")],
    *[("DomainModel", "atom", f"import:{x}") for x in ("network", "filesystem", "clock", "randomness", "environment", "process", "persistence")],
    *[("DomainModel", "atom", f"import-exact:{x}") for x in ("process", "node:process")],
    *[("ApplicationOrchestration", "atom", x) for x in ("ambient:process", "ambient:process.env", "import-exact:process", "import-exact:node:process", "import:filesystem", "import:network", "ambient:fetch", "ambient:XMLHttpRequest")],
    ("PresentationAdapters", "atom", "import:persistence"),
]
_REPOS = f"{with_views('code_files')}, repos AS (SELECT DISTINCT repo FROM code_files)"


def _values(rows) -> str:
    show = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


# The code that derived sources begin with, by ordinal; their prose has none of it.
_P = "CAST(s.ordinal % 7 IN (0, 3) AS INT)"
_HINTS = """hints AS (SELECT repo, path, ordinal, CASE WHEN ordinal % 7 = 0 THEN 1 ELSE 0 END AS p, (CASE WHEN ordinal % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN ordinal % 6 = 0 THEN 3 ELSE 0 END) AS b,
  (CASE WHEN ordinal % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN ordinal % 6 = 0 THEN 3 ELSE 0 END) AS i, CASE WHEN ordinal % 6 = 0 THEN 3 ELSE 0 END AS s, ordinal % 5 = 0 AS io, ordinal % 7 = 1 AS handler, ordinal % 7 = 4 AS mapping, length(content) >= 40 AS enough FROM sources),
 shoulds AS (SELECT repo, path, ordinal, p + CASE WHEN ordinal % 7 IN (2, 3) THEN 1 ELSE 0 END AS p, b, i, s, io, handler, mapping, enough FROM hints),
 hinted AS (SELECT repo, path, ordinal, enough AND (p >= 2 OR (p >= 1 AND b >= 2) OR (b >= 3 AND i + s >= 6)) AS orchestration_heavy,
  enough AND (((io OR handler) AND (p >= 1 OR b >= 2)) OR (io AND mapping AND (i >= 4 OR p >= 1)) OR (handler AND io)) AS adapter_thick FROM shoulds)"""

_EVIDENCE = """evidence AS (SELECT repo, smell, path FROM (SELECT c.repo, c.path, unnest([
  CASE WHEN c.ordinal % 11 = 0 AND NOT suffix(c.path, '.gen.ts') THEN 'god-module' END,
  CASE WHEN (layer = 'PresentationAdapters' OR regexp_matches(c.path, '/ui/')) AND c.ordinal % 7 IN (0, 3) THEN 'domain-logic-in-ui' END,
  CASE WHEN layer = 'ApplicationOrchestration' AND c.ordinal % 5 = 0 THEN 'io-under-application' END,
  CASE WHEN layer = 'PersistenceAdapters' AND c.ordinal % 7 = 1 THEN 'handler-in-persistence' END]) AS smell FROM classified c) WHERE smell IS NOT NULL)"""
_SMELLS = f"""{_EVIDENCE}, every AS (SELECT * FROM evidence
  UNION ALL SELECT t.repo, 'soft-contract', 'layer:' || l FROM (SELECT DISTINCT repo, layer AS l FROM classified WHERE layer IN ('Features', 'Kernel')) t
  UNION ALL SELECT repo, 'mixed-pattern-cluster', unnest(hits) FROM (SELECT repo, list_filter([CASE WHEN bool_or(regexp_matches(path, '/features/[^/]+/')) THEN 'layout:features/*' END,
    CASE WHEN bool_or(regexp_matches(path, '/(domain|application|infrastructure|adapters)/')) THEN 'layout:hex-domain-application-infra' END], lambda x: x IS NOT NULL) AS hits, count(*) AS n FROM code_files GROUP BY repo) WHERE len(hits) >= 2 AND n >= 8),
 smells AS (SELECT repo, smell, count(*) AS n, array_to_string(list_slice(list(path ORDER BY path), 1, 12), ',') AS evidence FROM every GROUP BY ALL)"""

_EDGE_ROWS = [
    ("contract-bidirectional-allow", "DomainModel<->Kernel", "edge:DomainModel<->Kernel", False),
    ("contract-peripheral-depends-core", "AuditTrail->ApplicationOrchestration", "edge:AuditTrail->ApplicationOrchestration", False),
    ("contract-lateral-adapter-allow", "IntegrationAdapters->PersistenceAdapters", "edge:IntegrationAdapters->PersistenceAdapters", False),
    ("contract-dead-rule", "Kernel->Kernel", "rule:Kernel->Kernel (self edge has no effect)", False),
    ("contract-dead-rule", "DomainModel->ReportingReadModels", "rule:DomainModel->ReportingReadModels (empty layer: ReportingReadModels)", True),
    ("contract-dead-rule", "DomainModel->GhostLayer", "rule:DomainModel->GhostLayer (unknown layer: GhostLayer)", True),
]

_FLAGGED = f"""{_base('dependencies', 'safety_uses')}, {_EDGES}, flagged AS (
 SELECT repo, 'LAYER_IMPORT_VIOLATION' AS rule_id, from_path AS file, line, from_layer, to_layer, to_path AS target, CASE kind WHEN 'export' THEN 'import' ELSE kind END AS edge_kind, type_only, peer, from_ordinal % 5 = 0 AS pure,
  to_ordinal % 7 = 0 AS only_types, to_ordinal % 3 = 0 AS named, from_ordinal % 2 = 0 AS port, NOT type_only OR peer AS blocking FROM denied
 UNION ALL SELECT repo, CASE kind WHEN 'any-cast' THEN 'FORBIDDEN_GLOBAL' WHEN 'dynamic-import' THEN 'CIRCULAR_DEPENDENCY' WHEN 'dynamic-require' THEN 'ARKRULE_STRUCTURE' WHEN 'in-memory-store' THEN '' ELSE 'RAW_EVENT_PUBLISH' END, file, line,
  NULL, NULL, NULL, NULL, false, false, false, false, false, false, true FROM safety_uses),
 judged AS (SELECT *, CASE WHEN rule_id = 'LAYER_IMPORT_VIOLATION' THEN CASE WHEN peer THEN ['judgment', '0.9', NULL] WHEN edge_kind IN ('require', 'dynamic-import') THEN ['judgment', '0.75', NULL]
   WHEN type_only AND pure THEN ['mechanical-safe', '0.88', 'pure-type-file-relocate'] WHEN only_types THEN ['mechanical-safe', '0.85', 'import-type-from-pure-type-module']
   WHEN named AND NOT type_only THEN ['mechanical-safe', '0.86', 'import-type-of-type-exports'] WHEN type_only THEN ['mechanical-safe', '0.9', 'type-only-import-move'] WHEN port THEN ['judgment', '0.82', 'port-proof-inject-binding'] ELSE ['judgment', '0.7', NULL] END
  WHEN rule_id = 'FORBIDDEN_GLOBAL' THEN ['judgment', '0.8', NULL] WHEN rule_id = 'CIRCULAR_DEPENDENCY' THEN ['judgment', '0.7', NULL] WHEN rule_id = 'ARKRULE_STRUCTURE' THEN ['judgment', '0.85', NULL]
  WHEN rule_id = '' THEN ['deferred', '0.3', NULL] ELSE ['judgment', '0.6', NULL] END AS x FROM flagged)"""

_NAMED = """named AS (SELECT repo, ordinal, CASE (ordinal // 20) % 4 WHEN 0 THEN 'src/app/orders' WHEN 1 THEN 'src/features/order' WHEN 2 THEN 'src/(shop)/billing/lines' ELSE '' END AS dir, ordinal % 7 AS k FROM code_files),
 physical AS (SELECT repo, ordinal, dir || CASE WHEN dir = '' THEN '' ELSE '/' END || CASE k WHEN 0 THEN 'OrderService.ts' WHEN 1 THEN 'getUser.ts' WHEN 2 THEN 'page.tsx' WHEN 3 THEN 'HTTPClient.ts' WHEN 4 THEN 'orderLine.test.ts' WHEN 5 THEN 'README.md' ELSE 'useNew.ts' END AS path,
  CASE k WHEN 0 THEN 'order' WHEN 1 THEN 'user' WHEN 2 THEN CASE dir WHEN 'src/app/orders' THEN 'orders' WHEN 'src/features/order' THEN 'features' WHEN 'src/(shop)/billing/lines' THEN 'billing' END WHEN 3 THEN 'http' WHEN 4 THEN 'order' END AS concept,
  CASE WHEN k = 2 THEN CASE dir WHEN 'src/app/orders' THEN 'src/app' WHEN 'src/features/order' THEN 'src' WHEN 'src/(shop)/billing/lines' THEN 'src/(shop)' END WHEN dir = '' THEN '.' ELSE dir END AS anchor FROM named)"""
_ANCHORS = f"""{with_views('code_files')}, {_NAMED}, anchors AS (SELECT repo, concept, anchor, count(*) AS n FROM physical WHERE concept IS NOT NULL GROUP BY ALL),
 found AS (SELECT repo, concept, CAST(sum(n) AS BIGINT) AS n_files, max(n) AS max_cluster, count(*) AS n_anchors, count(*) FILTER (n >= 2) >= 2 AS mirrored FROM anchors GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY max_cluster DESC, concept) AS place FROM found WHERE max_cluster >= 4 OR mirrored)"""

_CHANGES = """rows_ AS (SELECT repo, ordinal, CASE WHEN ordinal % 17 = 0 THEN '../' || path ELSE path END AS path, ordinal % 4 = 0 AS is_delete, n_chars + 1 AS content_version FROM code_files WHERE repo <> 'src4')"""
_OPERATION = "CASE WHEN ordinal % 10 = 0 THEN 'create' WHEN ordinal % 10 = 1 THEN 'delete' ELSE 'update' END"
_CONVERGED = f"""{with_views('code_files', 'tree_base', 'tree_candidate', 'dependencies')},
 actual AS (SELECT coalesce(b.repo, c.repo) AS repo, coalesce(b.path, c.path) AS path, CASE WHEN b.path IS NULL THEN 'create' WHEN c.path IS NULL THEN 'delete' ELSE 'update' END AS op
  FROM tree_base b FULL JOIN tree_candidate c ON b.repo = c.repo AND b.path = c.path WHERE b.path IS NULL OR c.path IS NULL OR b.content_version <> c.content_version),
 planned AS (SELECT repo, path, {_OPERATION} AS op FROM code_files WHERE ordinal % 10 IN (0, 1) OR ordinal % 26 = 0),
 b AS (SELECT DISTINCT repo, from_path AS f, to_path AS t FROM dependencies WHERE ordinal <= 2), c AS (SELECT DISTINCT repo, from_path AS f, to_path AS t FROM dependencies WHERE ordinal <> 2),
 w AS (SELECT DISTINCT repo, CASE WHEN from_ordinal % 2 = 0 THEN from_path ELSE to_path END AS f, CASE WHEN from_ordinal % 2 = 0 THEN to_path ELSE from_path END AS t FROM dependencies WHERE from_ordinal % 3 = 0 AND ordinal = 1),
 near AS (SELECT repo, path FROM planned UNION SELECT repo, path FROM actual), gone AS (SELECT repo, path FROM planned WHERE op = 'delete'),
 contra AS (SELECT repo, t AS f, f AS t FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo = w.repo AND c.f = w.f AND c.t = w.t)),
 findings AS (
  SELECT coalesce(p.repo, a.repo) AS repo, 'file' AS subject, coalesce(p.path, a.path) AS id, CASE WHEN p.path IS NULL THEN 'unplanned' WHEN a.path IS NULL THEN 'missing' WHEN p.op = a.op THEN 'satisfied' ELSE 'contradictory' END AS classification
   FROM planned p FULL JOIN actual a ON p.repo = a.repo AND p.path = a.path
  UNION ALL SELECT w.repo, 'dependency', w.f || '->' || w.t, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.repo = w.repo AND c.f = w.f AND c.t = w.t) THEN 'satisfied' WHEN EXISTS (SELECT 1 FROM c WHERE c.repo = w.repo AND c.f = w.t AND c.t = w.f) THEN 'contradictory' ELSE 'missing' END FROM w
  UNION ALL SELECT repo, 'dependency', f || '->' || t, 'unplanned' FROM (SELECT * FROM c EXCEPT SELECT * FROM b EXCEPT SELECT * FROM w EXCEPT SELECT * FROM contra) x WHERE EXISTS (SELECT 1 FROM near n WHERE n.repo = x.repo AND n.path IN (x.f, x.t))
  UNION ALL SELECT repo, 'dependency', f || '->' || t, 'unplanned' FROM (SELECT * FROM b EXCEPT SELECT * FROM c) x WHERE EXISTS (SELECT 1 FROM near n WHERE n.repo = x.repo AND n.path IN (x.f, x.t)) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo = x.repo AND g.path IN (x.f, x.t)))"""

_LONG = "length(repo) > 4"
_DELTA = f"""{_REPOS}, delta AS (SELECT repo, path, classification, kind FROM (SELECT repo, unnest([
  CASE WHEN {_LONG} THEN ['$.layers[Kernel]', 'weakening', 'layer-removed'] END,
  CASE WHEN {_LONG} THEN ['$.layers[Features].patterns', 'strengthening', 'added'] END, CASE WHEN {_LONG} THEN ['$.layers[Features].patterns', 'weakening', 'removed'] END,
  CASE WHEN NOT {_LONG} THEN ['$.layers[PresentationAdapters].capabilities', 'weakening', 'removed'] END, CASE WHEN repo = 'src3' THEN ['$.layers[DomainModel].optional', 'weakening', 'enabled'] END,
  CASE WHEN repo = 'src1' THEN ['$.rules[DomainModel->PresentationAdapters]', 'weakening', 'deny-removed'] END, CASE WHEN {_LONG} THEN ['$.rules[PresentationAdapters->PersistenceAdapters].allowed', 'weakening', 'deny-disabled'] END,
  CASE WHEN repo = 'src2' THEN ['$.rules[Features->Features].peerIsolation', 'weakening', 'peer-isolation-disabled'] END,
  CASE WHEN {_LONG} THEN ['$.cyclePolicy', 'strengthening', 'cycle-policy-changed'] WHEN repo = 'src2' THEN ['$.cyclePolicy', 'judgment-required', 'cycle-policy-changed'] END,
  CASE WHEN repo = 'src6' THEN ['$.safety.maxAnyCasts', 'weakening', 'threshold-raised'] END, CASE WHEN {_LONG} THEN ['$.safety.maxTsSuppressions', 'strengthening', 'threshold-lowered'] END,
  CASE WHEN repo = 'src8' THEN ['$.exclude', 'weakening', 'added'] END]) AS x FROM repos), LATERAL (SELECT x[1] AS path, x[2] AS classification, x[3] AS kind) WHERE x IS NOT NULL)"""

_CELLS = with_views("experiment_cells")
_ADOPTED = f"{_CELLS}, adopted AS (SELECT 'size' || pair_id % 3 AS size, 'style' || pair_id % 4 AS style, restricted_ms AS apply_ms, pair_id % 101 AS percent, pair_id % 3 <> 0 AS green FROM experiment_cells)"
_PLACED = f"""{_base()}, a AS (SELECT ordinal // 10 AS scenario, CASE WHEN ordinal % 2 = 0 THEN 'weak' ELSE 'golden' END AS arm, ordinal % 10 // 2 + 1 AS turn, ordinal % 7 IN (2, 3) OR coalesce(layer = 'DomainModel', false) AS hit FROM classified),
 turns AS (SELECT scenario, arm, coalesce(min(turn) FILTER (hit), max(turn) + 1) AS turns, count(*) FILTER (hit) > 0 AS landed FROM a GROUP BY ALL)"""
_EVENTS = with_views("domain_events")


def _lensed(said: str) -> str:
    """said (repo, source, id, evidence): what speaks for lenses."""
    return f"""{_base('sources', 'dependencies')}, {_EDGES}, {_SMELLS}, lens_of(source, id, lens, priority) AS (VALUES ('design', 'god-module', 'cohesion', 2), ('design', 'soft-contract', 'rules', 1), ('design', 'mixed-pattern-cluster', 'cohesion', 2), ('rules', 'LAYER_IMPORT_VIOLATION', 'direction', 0), ('rules', 'NEVER', 'never', 9)),
 said AS ({said}),
 told AS (SELECT repo, lens, count(DISTINCT evidence) AS n, array_to_string(list_slice(list(DISTINCT evidence ORDER BY evidence), 1, 12), ',') AS evidence FROM said JOIN lens_of ON lens_of.source = said.source AND lens_of.id = said.id GROUP BY ALL),
 lensed AS (SELECT r.repo, l.lens, l.priority, CASE WHEN t.n IS NULL THEN 'clear' ELSE 'residual' END AS status, coalesce(t.n, 0) AS n, coalesce(t.evidence, '') AS evidence
  FROM (SELECT DISTINCT repo FROM code_files) r CROSS JOIN (SELECT lens, CAST(min(priority) AS BIGINT) AS priority FROM lens_of GROUP BY lens) l LEFT JOIN told t ON t.repo = r.repo AND t.lens = l.lens),
 residual AS (SELECT repo, lens, row_number() OVER (PARTITION BY repo ORDER BY priority, lens) AS place FROM lensed WHERE status = 'residual')"""


_LENSED = _lensed("SELECT repo, 'design' AS source, smell AS id, path AS evidence FROM every UNION ALL SELECT repo, 'rules', 'LAYER_IMPORT_VIOLATION', from_layer || '->' || to_layer FROM violations")
#: Of smells what their evidence lists, of violations those of repositories with longer names.
_LENSED_IN_PART = _lensed("SELECT repo, 'design' AS source, smell AS id, unnest(string_split(evidence, ',')) AS evidence FROM smells UNION ALL SELECT repo, 'rules', 'LAYER_IMPORT_VIOLATION', from_layer || '->' || to_layer FROM violations WHERE length(repo) > 4")

_ORACLE = {
    "module_capability": f"{with_views('module_imports')} SELECT repo, file, ordinal, specifier, {_MODULE} AS capability FROM module_imports",
    "ambient_capability": f"{with_views('ambient_uses')} SELECT repo, file, line, symbol, {_AMBIENT} AS capability FROM ambient_uses",
    "forbidden_global_violations": f"""{_base('ambient_uses')} SELECT u.repo, 'FORBIDDEN_GLOBAL' AS rule_id, file, line, layer AS from_layer, symbol AS target FROM ambient_uses u JOIN classified c ON c.repo = u.repo AND c.path = u.file
 WHERE (layer = 'DomainModel' AND symbol = 'Date.now') OR (layer = 'ApplicationOrchestration' AND symbol IN ('process.env.HOME', 'process.cwd'))""",
    "capability_violations": f"""{_base('ambient_uses', 'module_imports')}, uses AS (SELECT repo, file, line, specifier AS target, {_MODULE} AS capability, kind, true AS imported FROM module_imports WHERE NOT type_only
  UNION ALL SELECT repo, file, line, symbol, {_AMBIENT}, NULL, false FROM ambient_uses),
 placed AS (SELECT u.*, c.layer FROM uses u JOIN classified c ON c.repo = u.repo AND c.path = u.file WHERE capability IS NOT NULL),
 judged AS (SELECT *, CASE WHEN NOT imported AND ((layer = 'DomainModel' AND target = 'Date.now') OR (layer = 'ApplicationOrchestration' AND starts_with(target, 'process'))) THEN NULL
  WHEN imported AND layer = 'ApplicationOrchestration' AND target = 'process' THEN 'FORBIDDEN_GLOBAL'
  WHEN layer = 'DomainModel' OR (layer = 'ApplicationOrchestration' AND capability IN ('filesystem', 'network')) OR (layer = 'PresentationAdapters' AND capability = 'persistence') THEN 'CAPABILITY_VIOLATION' END AS rule_id FROM placed)
 SELECT repo, rule_id, file, line, layer AS from_layer, target, CASE WHEN rule_id = 'CAPABILITY_VIOLATION' THEN capability END AS capability, kind AS edge_kind FROM judged WHERE rule_id IS NOT NULL""",
    "publish_violations": f"""{_base('publish_calls')}, p AS (SELECT x.*, c.layer AS from_layer, {_PREFIXED.format('source_intent')} AS source_layer FROM publish_calls x JOIN classified c ON c.repo = x.repo AND c.path = x.file WHERE c.layer IS NOT NULL)
 SELECT repo, 'RAW_EVENT_PUBLISH' AS rule_id, file, line, CAST(NULL AS VARCHAR) AS from_layer, CAST(NULL AS VARCHAR) AS to_layer, CAST(NULL AS VARCHAR) AS target FROM p WHERE raw_intent = 'Domain.Order.Placed' OR object_has_intent
 UNION ALL SELECT repo, 'PUBLISH_MISSING_SOURCE', file, line, from_layer, NULL, NULL FROM p WHERE candidate AND NOT has_source
 UNION ALL SELECT repo, 'PUBLISH_SOURCE_LAYER_MISMATCH', file, line, from_layer, source_layer, source_intent FROM p WHERE source_layer <> from_layer""",
    "intent_reference_violations": f"""{_base('intent_references')}, p AS (SELECT x.*, c.layer AS from_layer, {_PREFIXED.format('intent')} AS to_layer FROM intent_references x JOIN classified c ON c.repo = x.repo AND c.path = x.file)
 SELECT repo, 'LAYER_INTENT_REFERENCE_VIOLATION' AS rule_id, file, line, from_layer, to_layer, intent AS target,
  CASE WHEN from_layer = 'DomainModel' THEN CASE to_layer WHEN 'ApplicationOrchestration' THEN 'domain stays free of application' ELSE 'domain stays free of persistence' END ELSE 'presentation goes through application' END AS message FROM p WHERE (from_layer, to_layer) IN {_DENIED}""",
    "coverage_atoms": f"{_REPOS}, a(layer, kind, atom) AS (VALUES {_values(_ATOMS)}) SELECT DISTINCT repo, layer, kind, atom FROM repos CROSS JOIN a",
    "resolve_specifiers": f"""{with_views('code_files', 'module_imports')} SELECT m.repo, m.file, m.ordinal, m.specifier, c.path AS to_path FROM module_imports m
 LEFT JOIN code_files c ON c.repo = m.repo AND starts_with(m.specifier, './') AND c.path = regexp_replace(m.file, '/[^/]*$', '') || '/' || regexp_extract(m.specifier, 'f[0-9]+$') || '.ts'""",
    "canonical_paths": f"{with_views('code_files')} SELECT repo, CASE ordinal % 6 WHEN 0 THEN '/' || path WHEN 1 THEN './' || path WHEN 2 THEN 'C:/' || path WHEN 3 THEN '../' || path ELSE path END AS odd, ordinal % 6 > 3 AS canonical FROM code_files",
    "scanned_files": f"{with_views('code_files')} SELECT repo, path FROM code_files WHERE NOT suffix(path, '.gen.ts') AND NOT starts_with(path, 'src/lib/')",
    "structure_violations": f"""{_base('class_shapes', 'sources')}, {_HINTS},
 placed AS (SELECT x.*, c.layer FROM class_shapes x JOIN classified c ON c.repo = x.repo AND c.path = x.file WHERE exported AND c.layer = 'DomainModel')
 SELECT repo, 'S1' AS structure_id, 'aggregate-private-state' AS sensor, file, class_name AS subject, true AS fails_strict FROM placed WHERE public_setters OR public_mutable
 UNION ALL SELECT repo, 'S2', 'always-valid-factory', file, class_name, false FROM placed WHERE public_constructor AND NOT static_factory AND (public_setters OR public_mutable OR n_mutating > 0)
 UNION ALL SELECT repo, 'S3', 'domain-event-on-mutation', file, class_name || '.m' || k, true FROM placed, (VALUES (1), (2)) AS m(k) WHERE k <= n_mutating AND NOT guarded
 UNION ALL SELECT repo, 'S4', 'no-anemic-model', file, class_name, false FROM placed WHERE data_only
 UNION ALL SELECT h.repo, 'S5', 'orchestration-only', h.path, h.path, true FROM hinted h JOIN classified c ON c.repo = h.repo AND c.path = h.path WHERE layer = 'ApplicationOrchestration' AND orchestration_heavy
 UNION ALL SELECT h.repo, 'S6', 'thin-adapter', h.path, h.path, false FROM hinted h JOIN classified c ON c.repo = h.repo AND c.path = h.path WHERE layer = 'PersistenceAdapters' AND adapter_thick""",
    "empty_scope": f"""{_REPOS}, x("rule", sensor, source, fails_strict) AS (VALUES ('S7', 'aggregate-private-state', 'rules/domain.json', true), ('INV-4', 'invariant-coverage', 'rules/kernel.json', false)) SELECT repo, x.* FROM repos CROSS JOIN x
 UNION ALL SELECT repo, 'S3', 'domain-event-on-mutation', 'rules/domain.json', true FROM code_files GROUP BY repo HAVING count(*) FILTER (starts_with(path, 'src/domain/')) = 0""",
    "file_hints": f"{with_views('code_files', 'sources')}, {_HINTS} SELECT repo, path, orchestration_heavy, adapter_thick FROM hinted",
    "lines_exports": f"""{with_views('code_files', 'sources')} SELECT repo, path, CAST(len(string_split(content, chr(10))) AS BIGINT) AS n_lines, CAST((CASE WHEN ordinal % 7 IN (0, 1) THEN 1 ELSE 0 END) + (CASE WHEN ordinal % 11 = 0 THEN 500 ELSE 0 END) AS BIGINT) AS n_exports FROM sources""",
    "invariant_coverage": f"""{with_views('code_files', 'sources')}, f AS (SELECT repo, bool_or(is_test) AS t, bool_or(is_test AND ordinal % 46 = 0) AS m1, bool_or(ordinal % 31 = 0) AS s2 FROM sources GROUP BY repo),
 c AS (SELECT repo, 'INV-1' AS invariant, m1 AS by_test, false AS by_symbol, m1 AS covered, NOT t AS partial, t, true AS enforced FROM f UNION ALL SELECT repo, 'INV-2', false, s2, s2, NOT t AND NOT s2, t, true FROM f
  UNION ALL SELECT repo, 'INV-3', false, false, true, false, t, false FROM f UNION ALL SELECT repo, 'INV-4', false, false, false, NOT t, t, false FROM f)
 SELECT repo, invariant, by_test, by_symbol, covered, partial, CASE WHEN covered THEN NULL WHEN t THEN 'tests-disappeared' ELSE 'never-had-tests' END AS kind, enforced AND NOT covered AND NOT partial AS fails_strict FROM c""",
    "safety_report": f"""{with_views('code_files', 'safety_uses')}, n AS (SELECT repo, kind, count(*) AS n, arg_min(file, ordinal) AS file, arg_min(line, ordinal) AS line FROM safety_uses WHERE NOT (starts_with(kind, 'dynamic-') AND starts_with(file, 'src/lib/')) GROUP BY ALL)
 SELECT repo, CASE kind WHEN 'dynamic-import' THEN 'DYNAMIC_IMPORT_NOT_ALLOWLISTED' WHEN 'dynamic-require' THEN 'DYNAMIC_REQUIRE_NOT_ALLOWLISTED' WHEN 'ts-suppression' THEN 'TS_SUPPRESSION_THRESHOLD_EXCEEDED' ELSE 'IN_MEMORY_STORE_IN_PRODUCTION_SOURCE' END AS rule_id, n, file, line
 FROM n WHERE kind IN ('dynamic-import', 'dynamic-require', 'in-memory-store') OR (kind = 'ts-suppression' AND n > 20) UNION ALL SELECT DISTINCT repo, 'PEER_ISOLATION_DISABLED', CAST(1 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM code_files""",
    "completeness_verdict": f"""{_base('dependencies', 'sources')}, {_EDGES}, f AS (SELECT repo, bool_or(is_test) AND {_LONG} AS t, bool_or(is_test AND ordinal % 46 = 0) AND {_LONG} AS m1, bool_or(ordinal % 31 = 0) AS s2 FROM sources GROUP BY repo),
 e AS (SELECT repo, NOT t AS open1, NOT t AND NOT s2 AS open2, CAST(t AND NOT m1 AS INT) + CAST(t AND NOT s2 AS INT) AS strict FROM f), s AS (SELECT repo, count(*) FILTER (starts_with(path, 'src/domain/')) = 0 AS none FROM code_files GROUP BY repo),
 v AS (SELECT repo, count(*) FILTER (blocking) AS n FROM violations GROUP BY repo),
 j AS (SELECT e.repo, CASE WHEN e.repo = 'src3' THEN 'unavailable' WHEN open1 OR open2 THEN 'partial' ELSE 'complete' END AS completeness, coalesce(v.n, 0) + strict AS n_blocking, CAST(2 + CAST(none AS INT) AS BIGINT) AS n_warnings FROM e JOIN s ON s.repo = e.repo LEFT JOIN v ON v.repo = e.repo)
 SELECT repo, completeness, n_blocking, n_warnings, completeness = 'complete' AND n_blocking = 0 AS valid, false AS strict_valid FROM j""",
    "contract_warnings": f"""{_base()}, {_LAYERS}, fixed(code, layer, detail) AS (VALUES ('CONFIG_LAYER_WITHOUT_PATTERNS', 'Bare', NULL), ('CONFIG_DUPLICATE_LAYER', 'Kernel', NULL), ('CONFIG_RULE_UNKNOWN_FROM_LAYER', 'Nobody', 'Kernel'), ('CONFIG_RULE_UNKNOWN_TO_LAYER', 'Kernel', 'Nothing')),
 globs(layer, detail, regex) AS (VALUES ('DomainModel', 'src/domain/**', '^src/domain/'), ('ApplicationOrchestration', 'src/application/**', '^src/application/'), ('PersistenceAdapters', 'src/adapters/persistence/**', '^src/adapters/persistence/'), ('PresentationAdapters', 'src/presentation/**', '^src/presentation/'),
  ('PresentationAdapters', 'src/features/**/ui/**', '^src/features/(.*/)?ui/'), ('Features', 'src/features/**', '^src/features/'), ('Kernel', 'src/kernel/**', '^src/kernel/'), ('Ghost', 'src/ghost/**', '^src/ghost/'), ('Ghost', 'src/domain/**', '^src/domain/'), ('Kernel', 'src/kernel/**', '^src/kernel/')),
 lone AS (SELECT repo, path FROM classified WHERE layer IS NULL AND NOT starts_with(path, 'src/domain/'))
 SELECT repo, code, layer, detail, CAST(NULL AS BIGINT) AS n, true AS fails_strict FROM (SELECT DISTINCT repo FROM code_files) CROSS JOIN fixed
 UNION ALL SELECT repo, 'CONFIG_LAYER_PATTERN_NO_MATCHES', g.layer, g.detail, NULL, false FROM (SELECT DISTINCT repo FROM code_files) r CROSS JOIN globs g WHERE NOT EXISTS (SELECT 1 FROM code_files c WHERE c.repo = r.repo AND regexp_matches(c.path, g.regex))
 UNION ALL SELECT repo, 'CONFIG_UNCLASSIFIED_FILES', NULL, array_to_string(list_slice(list(path ORDER BY path), 1, 5), ','), count(*), true FROM lone GROUP BY repo""",
    "smell_evidence": f"{_base('sources')}, {_EVIDENCE} SELECT repo, smell, path FROM evidence",
    "design_smells": f"{_base('sources')}, {_SMELLS} SELECT * FROM smells",
    "design_fitness": f"""{_base('sources', 'dependencies')}, {_EDGES}, {_SMELLS}, {_COVERAGE}, n AS (SELECT repo, count(*) AS n FROM smells GROUP BY repo), b AS (SELECT repo, count(*) AS b FROM violations WHERE blocking AND {_LONG} GROUP BY repo), o AS (SELECT repo, max(percent) AS percent FROM coverage GROUP BY repo)
 SELECT o.repo, coalesce(n, 0) AS n_smells, CASE WHEN coalesce(b, 0) = 0 AND percent >= 50 AND coalesce(n, 0) > 0 THEN 'design-weak' WHEN coalesce(n, 0) > 0 THEN 'smells-with-open-edges' ELSE 'ok' END AS status FROM o LEFT JOIN n ON n.repo = o.repo LEFT JOIN b ON b.repo = o.repo""",
    "false_green_risk": f"""{with_views('code_files')} SELECT repo, CASE WHEN count(*) FILTER (starts_with(path, 'src/domain/')) = 0 THEN 'DomainModel,PersistenceAdapters' ELSE 'PersistenceAdapters' END AS empty_cores, 'src/adapters/persistence' AS io_paths
 FROM code_files GROUP BY repo HAVING count(*) FILTER (starts_with(path, 'src/adapters/persistence/')) > 0""",
    "baseline_honesty": f"""{_VIOLATIONS}, n AS (SELECT r.repo, count(v.file) AS total, count(v.file) FILTER (line <= 6) AS frozen FROM (SELECT DISTINCT repo FROM code_files) r LEFT JOIN violations v ON v.repo = r.repo GROUP BY r.repo),
 k AS (SELECT *, CASE WHEN {_LONG} THEN 0 ELSE total - frozen END AS active FROM n)
 SELECT repo, CASE WHEN repo = 'src3' THEN CASE WHEN total > 0 THEN 'missing-with-debt' ELSE 'absent' END WHEN active = 0 AND frozen > 0 AND (frozen >= 5 OR (total >= 3 AND frozen >= total * 0.5)) THEN 'dirty-freeze' WHEN frozen > 0 THEN 'active-freeze' ELSE 'empty-freeze' END AS status FROM k""",
    "fitness_score": f"""{_VIOLATIONS}, {_COVERAGE}, o AS (SELECT repo, max(percent) AS c FROM coverage GROUP BY repo), v AS (SELECT repo, count(*) AS n FROM violations WHERE line = 3 GROUP BY repo),
 g AS (SELECT repo, CAST(floor(100.0 * count(*) FILTER (ordinal % 3 = 0) / count(*) + 0.5) AS BIGINT) AS g FROM code_files WHERE repo <> 'src5' GROUP BY repo),
 p AS (SELECT o.repo, c AS of_coverage, CAST(greatest(0, 100 - least(100, 4 * coalesce(n, 0))) AS BIGINT) AS of_edges, coalesce(g, 40) AS of_gates, CAST(20 AS BIGINT) AS of_rules FROM o LEFT JOIN v ON v.repo = o.repo LEFT JOIN g ON g.repo = o.repo),
 q AS (SELECT *, CAST(floor((4 * of_coverage + 3 * of_edges + 2 * of_gates + of_rules) / 10.0 + 0.5) AS BIGINT) AS score FROM p)
 SELECT *, CASE WHEN score >= 90 THEN 'elite' WHEN score >= 70 THEN 'strong' WHEN score >= 50 THEN 'ok' ELSE 'weak' END AS tone FROM q""",
    "core_ratchet": f"""{_VIOLATIONS}, {_COVERAGE}, v AS (SELECT DISTINCT repo FROM violations WHERE {_LONG})
 SELECT c.repo, layer, CASE WHEN layer = 'DomainModel' THEN CASE WHEN n_files > 0 THEN 'ratchet' ELSE 'stay-empty' END ELSE 'strict' END AS action, CASE WHEN v.repo IS NOT NULL THEN 'violations' WHEN percent < 50 THEN 'low-coverage' END AS refused
 FROM coverage c LEFT JOIN v ON v.repo = c.repo WHERE layer = 'DomainModel' OR (layer IN ('ApplicationOrchestration', 'PersistenceAdapters', 'PresentationAdapters') AND n_files > 0)""",
    "rules_under_contract": f"""{_base('sources')}, {_COVERAGE}, f AS (SELECT repo, bool_or(is_test AND ordinal % 46 = 0) AS m1, bool_or(ordinal % 31 = 0) AS s2 FROM sources GROUP BY repo), o AS (SELECT repo, max(percent) AS percent FROM coverage GROUP BY repo),
 x(layer, s, i) AS (VALUES ('DomainModel', 5, 3), ('ApplicationOrchestration', 1, 0), ('PersistenceAdapters', 1, 0), ('Kernel', 0, 1)),
 k AS (SELECT o.repo, layer, CAST(s AS BIGINT) AS n_structure, CAST(i AS BIGINT) AS n_invariants, CAST(CASE WHEN layer = 'DomainModel' THEN 1 + CAST(m1 AS INT) + CAST(s2 AS INT) ELSE 0 END AS BIGINT) AS n_covered, percent FROM o JOIN f ON f.repo = o.repo CROSS JOIN x)
 SELECT repo, layer, n_structure, n_invariants, n_covered, n_invariants - n_covered AS n_uncovered, CASE WHEN percent >= 50 THEN 'on' ELSE 'deferred' END AS teeth FROM k""",
    "next_pilot": f"""{_base('sources')}, {_SMELLS}, p(smell, pri) AS (VALUES ('facade-sql-in-routes', 0), ('io-under-application', 1), ('handler-in-persistence', 2), ('domain-logic-in-ui', 3), ('god-module', 4), ('soft-contract', 5), ('mixed-pattern-cluster', 6)),
 s AS (SELECT repo, smells.smell, pri, CAST(100 * CASE WHEN pri >= 5 THEN 0 ELSE least(n, 12) END - 10 * pri - row_number() OVER (PARTITION BY repo ORDER BY smells.smell) + 1 AS BIGINT) AS score FROM smells JOIN p ON p.smell = smells.smell)
 SELECT repo, arg_max(smell, (score, -pri)) AS smell, max(score) AS score FROM s GROUP BY repo""",
    "pilot_residual": f"""{_base('sources')}, {_EVIDENCE}, pilots AS (SELECT * FROM evidence WHERE smell IN ('god-module', 'domain-logic-in-ui')), left_ AS (SELECT * FROM evidence WHERE NOT (smell = 'god-module' AND {_LONG}) AND NOT regexp_matches(path, '[02468][.]')),
 a AS (SELECT repo, smell, count(DISTINCT path) AS n FROM left_ GROUP BY ALL), b AS (SELECT repo, smell, count(DISTINCT path) AS n FROM pilots GROUP BY ALL)
 SELECT b.repo, b.smell, b.n AS n_before, coalesce(a.n, 0) AS n_after, a.n IS NULL AS cleared, coalesce(a.n, 0) < b.n OR a.n IS NULL AS reduced FROM b LEFT JOIN a ON a.repo = b.repo AND a.smell = b.smell""",
    "contract_smells": f"""{_base()}, {_COVERAGE}, e(smell, edge, detail, late) AS (VALUES {_values(_EDGE_ROWS)}),
 empties AS (SELECT repo, layer FROM coverage WHERE n_files = 0 AND layer IN ('DomainModel', 'Kernel', 'ApplicationOrchestration', 'PersistenceAdapters')),
 allowed(edge, a, b, late) AS (VALUES ('DomainModel->Kernel', 'DomainModel', 'Kernel', false), ('Kernel->DomainModel', 'DomainModel', 'Kernel', false), ('AuditTrail->ApplicationOrchestration', 'ApplicationOrchestration', NULL, false), ('IntegrationAdapters->PersistenceAdapters', 'PersistenceAdapters', NULL, false),
  ('DomainModel->ReportingReadModels', 'DomainModel', NULL, true), ('DomainModel->GhostLayer', 'DomainModel', NULL, true)),
 found AS (SELECT repo, smell, edge, detail FROM (SELECT DISTINCT repo FROM code_files) r CROSS JOIN e WHERE NOT late OR {_LONG}
  UNION ALL SELECT repo, 'contract-dead-rule', edge, 'rule:' || edge || ' (empty layer: ' || layer || ')' FROM empties JOIN allowed ON layer IN (a, b) WHERE NOT late OR {_LONG})
 SELECT repo, smell, edge, detail, CASE WHEN repo = 'src7' THEN 'none' WHEN edge = 'Kernel->Kernel' THEN 'expired' WHEN smell = 'contract-lateral-adapter-allow' THEN 'malformed' ELSE 'none' END AS ack FROM found
  WHERE repo = 'src7' OR smell NOT IN ('contract-bidirectional-allow', 'contract-peripheral-depends-core')
 UNION ALL SELECT DISTINCT repo, 'contract-dead-rule', 'Gone->Gone', CAST(NULL AS VARCHAR), 'stale' FROM code_files WHERE repo <> 'src7'""",
    "classify_remediation": f"{_FLAGGED} SELECT repo, rule_id, file, line, target, x[1] AS class, CAST(x[2] AS DOUBLE) AS confidence, x[3] AS remediation FROM judged",
    "fix_class": f"""{_FLAGGED} SELECT repo, rule_id, file, line, target, CASE WHEN rule_id = 'LAYER_IMPORT_VIOLATION' THEN CASE WHEN type_only OR only_types OR named THEN 'file-move' WHEN peer THEN 'cross-slice-boundary'
  WHEN regexp_matches(target, '(^|/)application/') OR (from_layer IN ('DomainModel', 'ApplicationOrchestration') AND to_layer = 'PersistenceAdapters') OR port THEN 'port-inversion' ELSE 'review-contract' END
  WHEN rule_id = 'FORBIDDEN_GLOBAL' THEN 'inject-port' WHEN rule_id = 'CIRCULAR_DEPENDENCY' THEN 'break-cycle' WHEN rule_id = 'RAW_EVENT_PUBLISH' THEN 'registered-intent' ELSE 'review-contract' END AS fix_class,
 CASE WHEN rule_id = 'LAYER_IMPORT_VIOLATION' THEN CASE WHEN type_only OR only_types OR named THEN 'small' ELSE 'medium' END WHEN rule_id IN ('CIRCULAR_DEPENDENCY', 'ARKRULE_STRUCTURE') THEN 'medium' ELSE 'small' END AS effort FROM flagged""",
    "remediation_plan": f"""{_FLAGGED} SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY CASE x[1] WHEN 'mechanical-safe' THEN 0 WHEN 'judgment' THEN 1 ELSE 2 END + CASE WHEN type_only OR named THEN 10 ELSE 0 END, rule_id, file, line, target NULLS FIRST) AS step, x[1] AS class, type_only FROM judged""",
    "plan_summary": f"""{_FLAGGED}, {_COVERAGE}, o AS (SELECT repo, max(percent) AS percent FROM coverage GROUP BY repo), n AS (SELECT repo, count(*) FILTER (x[1] = 'mechanical-safe') AS m, count(*) FILTER (x[1] = 'judgment') AS j, count(*) FILTER (x[1] = 'deferred') AS d, count(*) FILTER (blocking) AS b FROM judged GROUP BY repo)
 SELECT o.repo, coalesce(m, 0) AS n_mechanical, coalesce(j, 0) AS n_judgment, coalesce(d, 0) AS n_deferred, coalesce(b, 0) = 0 AND percent >= 50 AS goal_met FROM o LEFT JOIN n ON n.repo = o.repo""",
    "freeze_guard": f"""{_VIOLATIONS}, k AS (SELECT repo, from_layer, to_layer, count(*) AS n FROM violations WHERE from_layer = 'DomainModel' OR repo <> 'src2' GROUP BY ALL), n AS (SELECT *, sum(n) OVER (PARTITION BY repo) AS total FROM k)
 SELECT repo, from_layer || '->' || to_layer AS edge FROM n WHERE total >= 10 AND n / total >= 0.9""",
    "classify_physical": f"{with_views('code_files')}, {_NAMED} SELECT repo, ordinal, path, concept, CASE WHEN concept IS NOT NULL THEN anchor END AS anchor FROM physical",
    "physical_cohesion": f"{_ANCHORS} SELECT * FROM ranked WHERE place <= 5",
    "reshape_pilot": f"""{_ANCHORS}, m AS (SELECT a.*, 'src/features/' || a.concept AS target FROM anchors a JOIN ranked r ON r.repo = a.repo AND r.concept = a.concept AND r.place = 1
  WHERE NOT regexp_matches(anchor || '/', '(^|/)(app|pages)(/|$)') AND anchor <> 'src/features/' || a.concept AND NOT starts_with(anchor, 'src/features/' || a.concept || '/')),
 o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN n >= 10 THEN 0 ELSE 1 END, CASE WHEN n >= 10 THEN n ELSE -n END, CASE WHEN n >= 10 THEN anchor END, anchor DESC) AS k FROM m)
 SELECT repo, concept, anchor, n, target FROM o WHERE k = 1""",
    "suggest_layer": f"""{with_views('code_files')}, t(k, folder, layer) AS (VALUES (0, 'src/app/(x)/api/y', 'ApplicationOrchestration'), (1, 'api/z', 'ApplicationOrchestration'), (2, 'src/domain/order', 'DomainModel'), (3, 'src/lib/prisma', 'PersistenceAdapters'), (4, 'src/lib/components', NULL),
  (5, 'src/components/deep', 'PresentationAdapters'), (6, 'src/services/repositories/x', 'PersistenceAdapters'), (7, 'src/nothing', NULL), (8, 'packages/usecases', 'ApplicationOrchestration')) SELECT repo, ordinal, folder, layer FROM code_files JOIN t ON k = ordinal % 9""",
    "preflight_changes": f"""{with_views('code_files', 'tree_base')}, {_CHANGES}
 SELECT repo, 'INVALID_CHANGE_PATH' AS rule_id, '<change-set>' AS file FROM rows_ CROSS JOIN (VALUES (1), (2)) AS t(k) WHERE ordinal % 17 = 0 AND (k = 1 OR ordinal % 23 = 0)
 UNION ALL SELECT repo, 'DUPLICATE_CHANGE_PATH', path FROM rows_ WHERE ordinal % 23 = 0 AND ordinal % 17 <> 0
 UNION ALL SELECT r.repo, 'DELETE_TARGET_MISSING', r.path FROM rows_ r LEFT JOIN tree_base b ON b.repo = r.repo AND b.path = r.path WHERE is_delete AND ordinal % 17 <> 0 AND b.path IS NULL
 UNION ALL SELECT DISTINCT repo, 'CHANGE_SET_EMPTY', '<change-set>' FROM code_files WHERE repo = 'src4'""",
    "prepared_changes": f"""{with_views('code_files', 'tree_base')}, {_CHANGES} SELECT r.repo, r.path, CASE WHEN is_delete THEN 'delete' WHEN b.path IS NOT NULL THEN 'update' ELSE 'create' END AS operation, b.content_version AS "before", CASE WHEN NOT is_delete THEN r.content_version END AS "after"
 FROM rows_ r LEFT JOIN tree_base b ON b.repo = r.repo AND b.path = r.path WHERE ordinal % 17 <> 0""",
    "validate_change_map": f"""{_base('dependencies')}, f AS (SELECT repo, ordinal, CASE WHEN ordinal % 6 = 0 THEN '/' || path ELSE path END AS path, CASE ordinal % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'rename' ELSE 'update' END AS op, CASE ordinal % 7 WHEN 0 THEN 'Nobody' WHEN 1 THEN 'Kernel' ELSE coalesce(layer, 'DomainModel') END AS said, layer AS real, ordinal % 6 <> 0 AS fine FROM classified WHERE ordinal % 10 <> 3),
 two AS (SELECT f.*, 1 AS nth FROM f UNION ALL SELECT f.*, 2 FROM f WHERE ordinal % 13 = 0),
 issues AS (SELECT repo, path AS subject, unnest(list_filter([CASE WHEN NOT fine THEN 'path-not-canonical' END, CASE WHEN op = 'rename' THEN 'unknown-operation' END, CASE WHEN said = 'Nobody' THEN 'unknown-layer' END, CASE WHEN fine AND nth = 2 THEN 'duplicate-path' END,
   CASE WHEN fine AND said <> 'Nobody' AND real IS NULL THEN 'unclassified-path' END, CASE WHEN fine AND said <> 'Nobody' AND real <> said THEN 'other-layer' END], lambda x: x IS NOT NULL)) AS issue FROM two),
 p AS (SELECT repo, path, op FROM f WHERE fine), e AS (SELECT d.*, row_number() OVER (PARTITION BY d.repo, d.from_path, d.to_path ORDER BY 3 * d.from_ordinal + d.ordinal) AS again, a.op AS fo, b.op AS t_o FROM dependencies d LEFT JOIN p a ON a.repo = d.repo AND a.path = d.from_path LEFT JOIN p b ON b.repo = d.repo AND b.path = d.to_path)
 SELECT * FROM issues UNION ALL SELECT repo, from_path || ' -> ' || to_path, unnest(list_filter([CASE WHEN fo IS NULL THEN 'from-not-planned' END, CASE WHEN t_o IS NULL THEN 'to-not-planned' END, CASE WHEN fo = 'delete' THEN 'from-deleted' END, CASE WHEN t_o = 'delete' THEN 'to-deleted' END,
  CASE WHEN from_path = to_path THEN 'self-dependency' END, CASE WHEN again > 1 THEN 'duplicate-dependency' END], lambda x: x IS NOT NULL)) FROM e""",
    "convergence_findings": f"{_CONVERGED} SELECT repo, subject, id, classification FROM findings",
    "convergence_summary": f"""{_CONVERGED}, s AS (SELECT repo, count(*) FILTER (classification = 'satisfied') AS n_satisfied, count(*) FILTER (classification = 'missing') AS n_missing, count(*) FILTER (classification = 'contradictory') AS n_contradictory, count(*) FILTER (classification = 'unplanned') AS n_unplanned FROM findings GROUP BY repo)
 SELECT *, n_missing + n_contradictory + n_unplanned = 0 AS converged FROM s""",
    "design_delta": f"""{with_views('code_files', 'safety_uses')}, u AS (SELECT repo, file, kind AS smell, 's' || ordinal % 40 AS symbol, ordinal AS o FROM safety_uses),
 b AS (SELECT repo, file AS path, smell, symbol, max(o % 9) AS m FROM u WHERE o % 5 <> 0 GROUP BY ALL), c AS (SELECT repo, CASE WHEN o % 11 = 0 THEN file || 'x' ELSE file END AS path, smell, symbol, max(o % 7) AS m FROM u GROUP BY ALL),
 t AS (SELECT DISTINCT repo, path FROM c WHERE symbol <> 's7'), free AS (SELECT repo, smell, symbol, max(m) AS m FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo = b.repo AND c.path = b.path AND c.smell = b.smell AND c.symbol = b.symbol) GROUP BY ALL HAVING count(*) = 1),
 j AS (SELECT c.*, coalesce(b.m, f.m) AS known FROM c JOIN t ON t.repo = c.repo AND t.path = c.path LEFT JOIN b ON b.repo = c.repo AND b.path = c.path AND b.smell = c.smell AND b.symbol = c.symbol LEFT JOIN free f ON f.repo = c.repo AND f.smell = c.smell AND f.symbol = c.symbol)
 SELECT repo, path, smell, symbol, 'rule' AS kind, CASE WHEN known IS NULL THEN 'new' ELSE 'worsened' END AS change FROM j WHERE known IS NULL OR m > known""",
    "decision_memory": f"""{_ANCHORS}, d AS (SELECT DISTINCT repo, concept FROM anchors WHERE concept IN ('order', 'user', 'http')),
 s AS (SELECT *, CASE WHEN concept = 'user' AND {_LONG} THEN 'stale' WHEN concept = 'user' THEN 'expired' WHEN concept = 'order' THEN 'current' ELSE 'undated' END AS status FROM d) SELECT repo, concept, status, status IN ('current', 'undated') AND {_LONG} AS suppresses FROM s""",
    "policy_delta": f"{_DELTA} SELECT *, classification || ':' || path || ':' || kind AS id FROM delta",
    "policy_class": f"""{_DELTA}, w AS (SELECT repo, max(CASE classification WHEN 'weakening' THEN 3 WHEN 'judgment-required' THEN 2 ELSE 1 END) AS k FROM delta WHERE repo <> 'src9' GROUP BY repo)
 SELECT r.repo, CASE k WHEN 3 THEN 'weakening' WHEN 2 THEN 'judgment-required' WHEN 1 THEN 'strengthening' ELSE 'neutral' END AS classification FROM repos r LEFT JOIN w ON w.repo = r.repo""",
    "policy_ack": f"{_REPOS} SELECT repo, CASE WHEN {_LONG} THEN repo <> 'src10' ELSE repo NOT IN ('src1', 'src2', 'src3', 'src5', 'src6', 'src7', 'src8') END AS valid FROM repos",
    "contract_hashes": f"{_REPOS} SELECT repo, false AS unchanged FROM repos",
    "team_gate": f"""{with_views('commit_paths')}, c AS (SELECT commit_id AS i, count(*) FILTER (regexp_matches(path, '^src/p[0-4][.]ts$')) AS law, count(*) FILTER (regexp_matches(path, '^src/p[0-9][0-9][.]ts$')) AS product FROM commit_paths GROUP BY commit_id)
 SELECT i AS change_id, CASE WHEN law > 0 AND product > 0 THEN 'mixed-law-and-product' WHEN law > 0 AND i % 2 <> 0 THEN 'law-in-feature' WHEN (i % 3 = 0 OR i % 5 > 0) AND (i % 2 <> 0 OR (i % 7 <> 0 AND i % 4 <> 0)) THEN CASE WHEN i % 3 = 0 THEN 'steward-only-loosen' ELSE 'steward-only-baseline-grow' END ELSE 'ok' END AS reason FROM c""",
    "hot_paths": f"""{with_views('commit_paths')}, k AS (SELECT DISTINCT repo, commit_id FROM commit_paths), r AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY repo ORDER BY commit_id DESC) <= 1000),
 h AS (SELECT p.repo, p.path, count(*) AS hits FROM commit_paths p JOIN r ON r.repo = p.repo AND r.commit_id = p.commit_id GROUP BY ALL HAVING count(*) >= 3)
 SELECT *, row_number() OVER (PARTITION BY repo ORDER BY hits DESC, path) AS place FROM h QUALIFY place <= 8""",
    "event_layers": f"{_EVENTS} SELECT event_id, CASE WHEN starts_with(intent, 'Domain.') THEN 'Long' END AS layer FROM domain_events",
    "declared_layer_policy": f"""{with_views('intent_flows')} SELECT DISTINCT from_intent, to_intent, 'ApplicationOrchestration' AS from_layer, 'DomainModel' AS to_layer, CAST(7 AS BIGINT) AS "rule" FROM intent_flows WHERE kind = 'produces'""",
    "history_query": f"{_EVENTS} SELECT source, event_id FROM domain_events WHERE intent = 'Domain.Order.Placed' QUALIFY row_number() OVER (PARTITION BY source ORDER BY occurred_at DESC, event_id DESC) <= 50",
    "validate_entities": f"""{with_views('code_files')}, e AS (SELECT CASE WHEN ordinal % 50 = 49 THEN ' ' ELSE 'e' || ordinal % 50 END AS entity, CASE WHEN ordinal % 31 = 0 THEN ' ' ELSE 'f' || ordinal END AS field, ordinal % 29 = 0 AS typeless, CASE WHEN ordinal % 4 = 0 THEN 'e' || ordinal % 60 END AS relation FROM code_files)
 SELECT entity, field, 'field-name' AS issue FROM e WHERE field = ' ' UNION ALL SELECT entity, field, 'field-type' FROM e WHERE typeless UNION ALL SELECT entity, field, 'unknown-relation' FROM e WHERE relation IS NOT NULL AND relation NOT IN (SELECT entity FROM e) UNION ALL SELECT DISTINCT entity, CAST(NULL AS VARCHAR), 'entity-name' FROM e WHERE entity = ' '""",
    "entities_by_intent": f"""{with_views('code_files')}, r AS (SELECT DISTINCT 'i' || i AS intent, 'e' || ordinal AS entity, ordinal % 3 = 0 AND i = ordinal % 13 AS eats FROM (SELECT ordinal, unnest([ordinal % 13, ordinal % 7]) AS i FROM code_files))
 SELECT intent, entity, CASE WHEN eats THEN 'both' ELSE 'emits' END AS role FROM r""",
    "intercept_events": f"""{_EVENTS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{{"extra":{{"a":1,"b":[2]}},"k":1}}' ELSE '{{"extra":{{"a":1}},"k":1}}' END AS payload, CASE WHEN event_id % 2 = 0 THEN 'fill,again' ELSE 'fill' END AS interceptions, CASE WHEN event_id % 3 = 0 THEN 'clash' ELSE '' END AS failures
 FROM domain_events WHERE intent = 'Domain.Order.Placed'""",
    "usage_summary": f"""{_CELLS}, u AS (SELECT arm, CASE WHEN pair_id % 10 <> 0 OR arm = 'control' THEN pair_id % 1000 END AS i, pair_id % 77 AS o, pair_id % 5 AS c FROM experiment_cells)
 SELECT arm, count(i) AS n_reported, count(*) - count(i) AS n_unreported, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) FILTER (i IS NOT NULL) AS BIGINT) AS output_tokens, CASE WHEN count(i) = count(*) THEN CAST(sum(c) AS BIGINT) END AS cost_micros, count(i) <> count(*) AS is_partial FROM u GROUP BY arm""",
    "adoption_matrix": f"""{_ADOPTED}, v AS (SELECT 'size' AS dimension, 'size' || unnest(range(4)) AS value UNION ALL SELECT 'style', 'style' || unnest(range(4))), n AS (SELECT 'size' AS dimension, size AS value, count(*) AS n FROM adopted GROUP BY ALL UNION ALL SELECT 'style', style, count(*) FROM adopted GROUP BY ALL)
 SELECT v.dimension, v.value, coalesce(n, 0) AS n FROM v LEFT JOIN n ON n.dimension = v.dimension AND n.value = v.value""",
    "adoption_summary": f"""{_ADOPTED} SELECT count(*) AS n_cells, count(*) FILTER (green) AS n_green, count(*) FILTER (NOT green) AS n_adapt, CAST(median(apply_ms) AS DOUBLE) AS median_apply_ms, CAST(median(percent) AS DOUBLE) AS median_percent,
 (SELECT count(*) FILTER (pair_id % 4 <= 1) FROM experiment_cells) AS n_open, false AS accepted FROM adopted""",
    "arm_comparison": f"""{_CELLS}, p AS (SELECT arm, task_id, sum(pair_id % 3) AS v, count(DISTINCT pair_id % 20) FILTER (pair_id % 3 > 0) AS f, max(CASE WHEN pair_id % 2 = 0 THEN pair_id % 24 + 70 END) AS g FROM experiment_cells GROUP BY ALL)
 SELECT arm, count(*) AS n_prompts, round(sum(v) / count(*), 6) AS mean_violations, round(sum(f) / count(*), 6) AS mean_misplaced, round(sum(coalesce(g, 0)) / count(*), 6) AS mean_governed FROM p GROUP BY arm""",
    "loop_cost": f"""{_CELLS} SELECT arm, count(*) AS n_cases, count(*) FILTER (pair_id % 2 = 0 AND pair_id % 9 <> 0) AS n_green, CAST(median(pair_id % 11 + length(arm)) FILTER (pair_id % 2 = 0 AND pair_id % 9 <> 0) AS DOUBLE) AS median_turns, round(count(*) FILTER (pair_id % 17 = 0) / count(*), 6) AS cheated_rate FROM experiment_cells GROUP BY arm""",
    "placement_turns": f"{_PLACED} SELECT * FROM turns",
    "placement_comparison": f"""{_PLACED}, b AS (SELECT scenario, max(turns) FILTER (arm = 'weak') AS base_turns, max(turns) FILTER (arm = 'golden') AS other_turns FROM turns GROUP BY scenario)
 SELECT *, base_turns - other_turns AS delta, round((base_turns - other_turns) / base_turns, 6) AS reduction, base_turns > other_turns AS better FROM b WHERE base_turns IS NOT NULL AND other_turns IS NOT NULL""",
    "parse_health": f"""{with_views('code_files')}, f AS (SELECT repo, path, CASE WHEN ordinal % 3 = 0 THEN ordinal % 5 ELSE 0 END AS d FROM code_files)
 SELECT repo, count(*) FILTER (d > 0) AS n_affected, CAST(sum(d) AS BIGINT) AS n_diagnostics, coalesce(array_to_string(list_slice(list(path ORDER BY path) FILTER (d > 0), 1, 4), ','), '') AS paths FROM f GROUP BY repo""",
    "dynamic_blind_spots": f"""{with_views('code_files', 'dependencies')} SELECT repo, count(*) AS n, count(*) FILTER (ordinal = 2) AS n_template, array_to_string(list_slice(list(from_path || ':' || line ORDER BY from_path, line), 1, 3), ',') AS "first" FROM dependencies WHERE kind = 'dynamic-import' GROUP BY repo""",
    "tree_hashes": f"""{with_views('code_files', 'tree_base', 'tree_candidate')} SELECT DISTINCT b.repo, b.repo <> 'src2' OR NOT EXISTS ((SELECT repo, path, content_version FROM tree_base WHERE repo = 'src2' EXCEPT SELECT repo, path, content_version FROM tree_candidate) UNION ALL (SELECT repo, path, content_version FROM tree_candidate WHERE repo = 'src2' EXCEPT SELECT repo, path, content_version FROM tree_base)) AS same FROM tree_base b""",
    "retained_snapshots": f"{_EVENTS} SELECT intent AS repo, event_id AS ts FROM domain_events QUALIFY row_number() OVER (PARTITION BY intent ORDER BY event_id) = 1 OR row_number() OVER (PARTITION BY intent ORDER BY event_id DESC) <= 5",
    "validate_fact_keys": f"{with_views('code_files')} SELECT repo, path, 'duplicate-path' AS issue FROM code_files WHERE ordinal % 40 = 0 UNION ALL SELECT repo, path || 'x', 'unknown-file' FROM code_files",
    "read_structure_rules": f"""{with_views('code_files')} SELECT repo, path || 'x' AS path, 'missing-file' AS problem, true AS blocking FROM code_files WHERE ordinal % 6 = 3 UNION ALL SELECT repo, path, 'unreferenced-file', false FROM code_files WHERE ordinal % 6 IN (2, 4)""",
    "valid_acks": f"""{with_views('code_files')}, a AS (SELECT repo, 'a' || ordinal // 100 AS file, ordinal % 97 = 0 AS bad, path AS edge FROM code_files) SELECT repo, file, edge FROM a WHERE (repo, file) NOT IN (SELECT (repo, file) FROM a WHERE bad)""",
    "intent_cycles": """WITH n AS (SELECT s_nationkey AS k, count(*) AS n, min('Domain.S' || s_suppkey) AS anchor, string_agg('Domain.S' || s_suppkey, ',' ORDER BY 'Domain.S' || s_suppkey) AS members FROM supplier GROUP BY ALL) SELECT anchor, n AS n_members, members FROM n WHERE k % 2 = 0 AND n > 1""",
    "extract_imports": f"""{with_views('code_files')} SELECT repo, path AS file, CAST(0 AS BIGINT) AS ordinal, CAST(1 AS BIGINT) AS line, CASE ordinal % 5 WHEN 0 THEN 'pg' ELSE './other' END AS specifier, false AS type_only, false AS require_call FROM code_files WHERE ordinal % 5 <= 1""",
    "extract_class_shapes": f"""{with_views('code_files')} SELECT repo, path AS file, 'C' || ordinal AS class_name, false AS public_setters, ordinal % 4 <= 1 AS public_mutable, ordinal % 4 = 0 AS public_constructor, ordinal % 4 = 2 AS static_factory, ordinal % 4 = 1 AS data_only, CAST(CASE WHEN ordinal % 4 = 2 THEN 1 ELSE 0 END AS BIGINT) AS n_mutating FROM code_files""",
    "extract_module_state": f"""{_base()} SELECT repo, path, CAST(1 AS BIGINT) AS line, 'counter' AS name FROM classified WHERE layer = 'DomainModel' AND ordinal % 2 = 1 UNION ALL SELECT repo, path, 3, 'v' || ordinal FROM classified WHERE layer = 'DomainModel'""",
    "nested_payload_issues": f"""{_EVENTS}, t(k, path, code) AS (VALUES (1, 'id', 'type'), (1, 'state', 'enum'), (1, 'buyer', 'nested-object'), (2, 'buyer.name', 'missing-required'), (2, 'buyer.age', 'type'), (2, 'lines[1].sku', 'missing-required'), (2, 'lines[2]', 'type'),
  (3, 'id', 'missing-required'), (3, 'buyer', 'missing-required'), (4, '$', 'not-object'), (5, 'more', 'additional'), (6, 'id', 'missing-required'), (6, 'buyer', 'missing-required')) SELECT event_id, path, code FROM domain_events JOIN t ON k = event_id % 7 WHERE intent = 'Domain.Order.Placed'""",
    "evaluate_policies": f"""{_EVENTS} SELECT event_id, 'positive' AS policy, 'hard' AS severity, 'positive failed' AS message FROM domain_events WHERE NOT coalesce(value > 5, false) UNION ALL SELECT event_id, 'named', 'soft', 'no source' FROM domain_events WHERE source IS NULL
 UNION ALL SELECT event_id, 'many', 'soft', unnest(['first', 'second']) FROM domain_events WHERE event_id % 50 = 0""",
    "drift_report": f"""{with_views('domain_events', 'intent_flows')}, d AS (SELECT DISTINCT from_intent, to_intent FROM intent_flows WHERE kind = 'produces'), o AS (SELECT DISTINCT coalesce(source, '') AS from_intent, intent AS to_intent FROM domain_events UNION SELECT from_intent, to_intent FROM intent_flows WHERE kind = 'observed'),
 r AS (SELECT from_intent AS n FROM d UNION SELECT from_intent FROM o WHERE from_intent NOT IN ('', 'Domain.Order') UNION SELECT 'Domain.Never')
 SELECT 'declared-unobserved' AS list, * FROM (SELECT * FROM d EXCEPT SELECT * FROM o) UNION ALL SELECT 'observed-undeclared', * FROM (SELECT * FROM o WHERE from_intent <> 'unknown' EXCEPT SELECT * FROM d) UNION ALL SELECT 'unknown-source', * FROM o WHERE from_intent IN ('', 'unknown')
 UNION ALL SELECT DISTINCT 'unregistered-source', from_intent, CAST(NULL AS VARCHAR) FROM o WHERE from_intent NOT IN ('', 'unknown') AND from_intent NOT IN (SELECT n FROM r) UNION ALL SELECT DISTINCT 'unregistered-intent', CAST(NULL AS VARCHAR), to_intent FROM o WHERE to_intent NOT IN (SELECT n FROM r)
 UNION ALL SELECT 'never-observed', NULL, n FROM r WHERE n NOT IN (SELECT from_intent FROM o UNION SELECT to_intent FROM o)""",
    "verify_evidence": f"""{_EVENTS}, n AS (SELECT correlation_id AS ledger, event_id AS i, row_number() OVER (PARTITION BY correlation_id ORDER BY event_id) AS sequence FROM domain_events), z AS (SELECT ledger FROM n WHERE i % 17 = 0 GROUP BY ledger HAVING count(*) > 1)
 SELECT ledger, sequence, unnest(list_filter([CASE WHEN i % 11 = 0 THEN 'entry-hash' END, CASE WHEN i % 13 = 0 THEN 'manifest' END, CASE WHEN i % 17 = 0 AND i <> 0 THEN 'order' END, CASE WHEN i % 19 = 0 AND sequence > 1 THEN 'overlap' END, CASE WHEN i % 17 = 0 AND ledger IN (SELECT ledger FROM z) THEN 'duplicate-cell' END], lambda x: x IS NOT NULL)) AS failure FROM n
 UNION ALL SELECT ledger, max(sequence) + 1, 'missing' FROM n GROUP BY ledger""",
    "arm_outcomes": f"""{_CELLS} SELECT arm, count(*) AS n_cells, CAST(sum(pair_id % 9) AS BIGINT) AS turns, CAST(sum(pair_id % 2) AS BIGINT) AS escapes, CAST(sum(pair_id % 3) AS BIGINT) AS false_blocks, CAST(sum(pair_id % 4) AS BIGINT) AS bypasses, CAST(sum(pair_id % 6) AS BIGINT) AS decisions,
 count(*) FILTER (pair_id % 5 <> 0 AND pair_id % 7 <> 0) AS n_green, count(*) FILTER (pair_id % 5 = 0) AS n_red, count(*) FILTER (pair_id % 5 <> 0 AND pair_id % 7 = 0) AS n_not_run, round(sum(pair_id % 9) / count(*), 6) AS mean_turns FROM experiment_cells GROUP BY arm""",
    "compass": f"{_LENSED} SELECT * FROM lensed",
    "top_residual": f"{_LENSED_IN_PART} SELECT * FROM residual WHERE place <= 2",
    "deepening_candidates": f"""{_LENSED}, p(smell, pri) AS (VALUES ('facade-sql-in-routes', 0), ('io-under-application', 1), ('handler-in-persistence', 2), ('domain-logic-in-ui', 3), ('god-module', 4), ('soft-contract', 5), ('mixed-pattern-cluster', 6)),
 s AS (SELECT repo, smells.smell, pri, 100 * CASE WHEN pri >= 5 THEN 0 ELSE least(n, 12) END - 10 * pri - row_number() OVER (PARTITION BY repo ORDER BY smells.smell) + 1 AS score FROM smells JOIN p ON p.smell = smells.smell),
 c AS (SELECT repo, 0 AS l, 0 AS rank, arg_max(smell, (score, -pri)) AS target, 'pilot' AS friction FROM s GROUP BY repo UNION ALL SELECT repo, 1, 0, upper(smell), CASE WHEN n > 3 THEN 'pilot' ELSE 'few' END FROM smells UNION ALL SELECT repo, 2, place, 'lens:' || lens, 'residual' FROM residual WHERE place <= 5),
 f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo, lower(target), lower(friction) ORDER BY l, rank, target, friction) = 1)
 SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY l, rank, target, friction) AS place, target, friction FROM f QUALIFY row_number() OVER (PARTITION BY repo ORDER BY l, rank, target, friction) <= 4""",
    "best_fit_model": f"""{with_views('code_files')}, t(folder, model, i) AS (VALUES ('features', 'sliced', 0), ('ui', 'sliced', 0), ('domain', 'hexagonal', 1), ('application', 'hexagonal', 1), ('adapters', 'hexagonal', 1), ('kernel', 'kernel', 2), ('lib', 'kernel', 2), ('gen', 'kernel', 2)),
 d AS (SELECT DISTINCT repo, unnest(string_split(regexp_replace(path, '/[^/]*$', ''), '/')) AS folder FROM code_files), h AS (SELECT repo, model, i, count(*) AS hits FROM d JOIN t ON t.folder = d.folder GROUP BY ALL)
 SELECT repo, arg_max(model, (hits, -i)) AS model, max(hits) AS hits FROM h GROUP BY repo""",
    "archetype_scores": f"""{with_views('code_files')}, w(lang, archetype, weight) AS (VALUES ('en', 'service', 3), ('en', 'library', -1), ('de', 'library', 2), ('fr', 'app', 4), ('es', 'app', -2), ('es', 'service', 1)),
 s AS (SELECT repo, archetype, CAST(sum(weight) AS BIGINT) AS score FROM code_files JOIN w ON w.lang = code_files.lang GROUP BY ALL)
 SELECT repo, archetype, score, row_number() OVER o AS place, score - lead(score) OVER o AS margin FROM s WINDOW o AS (PARTITION BY repo ORDER BY score DESC, archetype)""",
    "recommendations": f"""{_base()}, {_COVERAGE}, w(lang, archetype, weight) AS (VALUES ('en', 'service', 6), ('en', 'library', -1), ('de', 'library', 5), ('fr', 'app', 4), ('es', 'app', -2), ('es', 'service', 1), ('zh', 'app', 3)),
 g AS (SELECT repo, lang, count(*) % 2 AS value FROM code_files GROUP BY ALL), s AS (SELECT repo, archetype, sum(weight * value) AS score FROM g JOIN w ON w.lang = g.lang GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, archetype) AS k FROM s),
 t AS (SELECT repo, count(*) AS n, min(ordinal) % 5 = 0 AS tiny FROM code_files GROUP BY repo), c AS (SELECT repo, CASE WHEN length(repo) > 4 THEN 100 ELSE max(percent) END AS share FROM coverage GROUP BY repo),
 x AS (SELECT t.*, share < 90 AS low, a.archetype AS one, b.archetype AS two, coalesce(a.score, 0) AS s1, b.score AS s2, CASE a.archetype WHEN 'service' THEN 7 WHEN 'app' THEN 7 ELSE 5 END AS most FROM t JOIN c ON c.repo = t.repo LEFT JOIN r a ON a.repo = t.repo AND a.k = 1 LEFT JOIN r b ON b.repo = t.repo AND b.k = 2),
 y AS (SELECT *, s1 > 0 AS found, s1 > 0 AND coalesce(s1 - s2 <= 2, false) AS near, s1 > 0 AND (n < 8 OR tiny) AS thin, least(1.0, greatest(0.1, CAST(s1 AS DOUBLE) / most * 0.7 + CASE WHEN s2 > 0 THEN CAST(s1 - s2 AS DOUBLE) / greatest(s1, 1) ELSE 0.25 END * 0.3)) AS sure FROM x)
 SELECT repo, CASE WHEN found THEN one ELSE 'spike' END AS archetype, CASE WHEN NOT found OR two <> one THEN two END AS runner_up, CAST(s1 AS BIGINT) AS score,
  CAST(CASE WHEN found THEN floor(least(sure, CASE WHEN thin THEN 0.28 ELSE 1 END, CASE WHEN near OR low THEN 0.49 ELSE 1 END) * 1000 + 0.5) / 1000 WHEN tiny THEN 0.55 ELSE 0.35 END AS DOUBLE) AS confidence, near AS close, thin, low AS low_coverage, NOT found OR near OR thin OR low AS to_confirm FROM y""",
}

def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
