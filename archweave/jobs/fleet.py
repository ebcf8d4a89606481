"""Registered queries with a contract for each repository, and over several snapshots of it, with their SQL.

Of the derived fleet, repositories 0, 3, ... keep the fleet's contract, 1, 4, ... and 2, 5, ... have one of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave.contract import FLEET, Contract, Layer, Rule
from archweave.derive import facts, with_views
from archweave.operators import fleet, layers
from archweave.sources.contracts import contract_tables

Query = Callable[[SparkSession, str], DataFrame]

ONION = Contract(
    layers=(Layer("Core", ("src/{domain,kernel}/**",), ("**/*.gen.ts",)), Layer("Edge", ("src/**/ui/**", "src/presentation/**")), Layer("Rest", ("src/**",))),
    rules=(
        Rule("Core", "Rest", allowed=True, message="allowed, and denied below"),
        Rule("Core", "Rest", message="the core imports nothing"),
        Rule("Rest", "Core", allowed=True),
        Rule("Core", "Edge", message="the first rule counts"),
        Rule("Core", "Edge", message="never told"),
        Rule("Rest", "Edge", message="nothing imports the edge"),
    ),
)
SLICED = Contract(
    layers=(Layer("Features", ("src/features/*/**",)), Layer("Adapters", ("src/adapters/**",)), Layer("Lib", ("src/lib/f?*.ts",), ("src/lib/f1*.ts",)), Layer("Generated", ("**/*.gen.ts",))),
    rules=(
        Rule("Features", "Features", peer_isolation=True, message="slices are inferred"),
        Rule("Lib", "Features", peer_isolation=True, slice_folders=("lib",), message="no slice, no evidence"),
        Rule("Adapters", "Adapters", message="never fires: same layer"),
        Rule("Features", "Adapters", message="features stay free of adapters"),
        Rule("Features", "Lib", message="features stay free of lib"),
    ),
)
_CONTRACTS = (FLEET, ONION, SLICED)


def _variant() -> Column:
    return F.regexp_extract("repo", r"(\d+)$", 1).cast("int") % len(_CONTRACTS)


def _contracts(spark: SparkSession, sf: str) -> fleet.Contracts:
    repos = facts(spark, sf, "code_files").select("repo").distinct()
    each = [contract_tables(c, repos.where(_variant() == i)) for i, c in enumerate(_CONTRACTS)]
    return fleet.compiled(*[reduce(DataFrame.union, [tables[name] for tables in each]) for name in ("layers", "rules")])


def classify_fleet(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.classify_fleet(facts(spark, sf, "code_files"), _contracts(spark, sf)).select("repo", "path", "layer")


def fleet_memberships(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.fleet_memberships(facts(spark, sf, "code_files"), _contracts(spark, sf))


def _violations(spark: SparkSession, sf: str, files: str = "code_files", dependencies: str = "dependencies") -> DataFrame:
    contracts = _contracts(spark, sf)
    classified = fleet.classify_fleet(facts(spark, sf, files), contracts)
    return fleet.fleet_violations(layers.build_edges(facts(spark, sf, dependencies), classified), contracts)


def fleet_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _violations(spark, sf)


def snapshot_edges(spark: SparkSession, sf: str) -> DataFrame:
    classified = fleet.classify_fleet(facts(spark, sf, "snapshot_files"), _contracts(spark, sf))
    edges = layers.build_edges(facts(spark, sf, "snapshot_dependencies"), classified)
    return edges.groupBy("repo", "snapshot", "from_layer", "to_layer").agg(F.count("*").alias("n_edges"))


def snapshot_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return layers.violation_breakdown(_violations(spark, sf, "snapshot_files", "snapshot_dependencies"))


def snapshot_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    shots = facts(spark, sf, "snapshot_files").select("repo", "snapshot").distinct()
    return layers.verdict(shots, _violations(spark, sf, "snapshot_files", "snapshot_dependencies"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (classify_fleet, fleet_memberships, fleet_violations, snapshot_edges, snapshot_breakdown, snapshot_verdicts)}


_VARIANT = "CAST(regexp_extract(repo, '([0-9]+)$', 1) AS INTEGER) % 3"
_GLOBS = """globs(v, layer, regex, excluded, fixed, base) AS (VALUES
 (0, 'DomainModel', '^src/domain/', '[.]gen[.]ts$', 2020011, 0), (0, 'ApplicationOrchestration', '^src/application/', NULL, 2020016, 0), (0, 'PersistenceAdapters', '^src/adapters/persistence/', NULL, 3030025, 0),
 (0, 'PresentationAdapters', '^src/presentation/', NULL, 2020017, 0), (0, 'PresentationAdapters', '^src/features/(.*/)?ui/', NULL, NULL, 30017), (0, 'Features', '^src/features/', NULL, 2020013, 0), (0, 'Kernel', '^src/kernel/', NULL, 2020011, 0),
 (1, 'Core', '^src/(domain|kernel)/', '[.]gen[.]ts$', 1010020, 0), (1, 'Edge', '^src/(.*/)?ui/', NULL, NULL, 20008), (1, 'Edge', '^src/presentation/', NULL, 2020017, 0), (1, 'Rest', '^src/', NULL, 1010004, 0),
 (2, 'Features', '^src/features/[^/]*/', NULL, 2020014, 0), (2, 'Adapters', '^src/adapters/', NULL, 2020013, 0), (2, 'Lib', '^src/lib/f[^/][^/]*[.]ts$', '^src/lib/f1[^/]*[.]ts$', 2020013, 0), (2, 'Generated', '[.]gen[.]ts$', NULL, 8, 0))"""
_RULES = """rules(v, n, from_layer, to_layer, peer, message) AS (VALUES
 (0, 1, 'DomainModel', 'ApplicationOrchestration', false, 'domain stays free of application'), (0, 2, 'DomainModel', 'PersistenceAdapters', false, 'domain stays free of persistence'),
 (0, 3, 'DomainModel', 'PresentationAdapters', false, 'domain stays free of presentation'), (0, 4, 'ApplicationOrchestration', 'PresentationAdapters', false, 'application stays free of presentation'),
 (0, 5, 'PresentationAdapters', 'PersistenceAdapters', false, 'presentation goes through application'), (0, 6, 'Features', 'Features', true, 'features are isolated'),
 (1, 1, 'Core', 'Rest', false, 'the core imports nothing'), (1, 2, 'Core', 'Edge', false, 'the first rule counts'), (1, 3, 'Rest', 'Edge', false, 'nothing imports the edge'),
 (2, 1, 'Features', 'Features', true, 'slices are inferred'), (2, 2, 'Lib', 'Features', true, 'no slice, no evidence'), (2, 3, 'Features', 'Adapters', false, 'features stay free of adapters'), (2, 4, 'Features', 'Lib', false, 'features stay free of lib'))"""
_SLICE = "regexp_extract({0}, '^src/(features/[^/]+)/', 1)"


def _members(files: str, keys: str) -> str:
    """Layers of files, with the depth of ``ui`` as the only segment that a rank must look for."""
    depth = "list_position(string_split(path, '/'), 'ui')"
    return f"""{_GLOBS}, {_RULES}, members AS (SELECT {keys}, path, layer, CAST(max(coalesce(fixed, {depth} * 1000000 + base)) AS BIGINT) AS score
 FROM {files} JOIN globs ON v = {_VARIANT} AND regexp_matches(path, regex) AND (excluded IS NULL OR NOT regexp_matches(path, excluded)) GROUP BY ALL),
 best AS (SELECT {keys}, path, arg_max(layer, score) AS layer FROM members GROUP BY ALL)"""


def _denied(dependencies: str, keys: list[str]) -> str:
    on = lambda side: " AND ".join(f"{side}.{k} = d.{k}" for k in keys)
    own = ", ".join(f"e.{k}" for k in keys)
    return f"""edges AS (SELECT d.*, f.layer AS from_layer, t.layer AS to_layer FROM {dependencies} d LEFT JOIN best f ON {on('f')} AND f.path = d.from_path LEFT JOIN best t ON {on('t')} AND t.path = d.to_path),
 violations AS (SELECT {own}, 'LAYER_IMPORT_VIOLATION' AS rule_id, e.from_path AS file, e.line, e.from_layer, e.to_layer, e.to_path AS target, e.type_only, (NOT e.type_only OR r.peer) AS blocking, r.message
  FROM edges e JOIN rules r ON r.v = {_VARIANT} AND r.from_layer = e.from_layer AND r.to_layer = e.to_layer
  WHERE NOT r.peer OR r.from_layer = 'Lib' OR {_SLICE.format('e.from_path')} <> {_SLICE.format('e.to_path')})"""


_ONE = f"{with_views('code_files', 'dependencies')}, {_members('code_files', 'repo')}"
_SHOTS = f"{with_views('code_files', 'dependencies', 'snapshot_files', 'snapshot_dependencies')}, {_members('snapshot_files', 'repo, snapshot')}, {_denied('snapshot_dependencies', ['repo', 'snapshot'])}"


def oracle_sql() -> dict[str, str]:
    return {
        "classify_fleet": f"{_ONE} SELECT c.repo, c.path, b.layer FROM code_files c LEFT JOIN best b ON b.repo = c.repo AND b.path = c.path",
        "fleet_memberships": f"{_ONE} SELECT repo, path, layer, score FROM members",
        "fleet_violations": f"{_ONE}, {_denied('dependencies', ['repo'])} SELECT * FROM violations",
        "snapshot_edges": f"{_SHOTS} SELECT repo, snapshot, from_layer, to_layer, count(*) AS n_edges FROM edges GROUP BY ALL",
        "snapshot_breakdown": f"""{_SHOTS}, fine AS (SELECT repo, snapshot, from_layer, to_layer, array_to_string(list_slice(string_split(regexp_replace(target, '/[^/]*$', ''), '/'), 1, 3), '/') AS subtree,
  count(*) AS n, count(*) FILTER (type_only) AS nt FROM violations GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, snapshot, from_layer, to_layer ORDER BY n DESC, subtree) AS k FROM fine),
  coarse AS (SELECT repo, snapshot, from_layer, to_layer, CAST(sum(n) AS BIGINT) AS n_violations, CAST(sum(nt) AS BIGINT) AS n_type_only, string_agg(subtree, ',' ORDER BY k) FILTER (k <= 4) AS subtrees FROM ranked GROUP BY ALL),
  summed AS (SELECT *, sum(n_violations) OVER (PARTITION BY repo, snapshot) AS total FROM coarse)
  SELECT repo, snapshot, from_layer, to_layer, n_violations, n_type_only, subtrees, round(n_violations / total, 6) AS share, total >= 10 AND n_violations / total >= 0.9 AS concentrated FROM summed""",
        "snapshot_verdicts": f"""{_SHOTS}, v AS (SELECT r.repo, r.snapshot, count(*) FILTER (blocking) AS n_blocking, count(*) FILTER (NOT blocking) AS n_warnings
  FROM (SELECT DISTINCT repo, snapshot FROM snapshot_files) r LEFT JOIN violations v ON v.repo = r.repo AND v.snapshot = r.snapshot GROUP BY ALL)
  SELECT repo, snapshot, n_blocking, n_warnings, n_blocking = 0 AS valid, n_blocking + n_warnings = 0 AS strict_valid FROM v""",
    }
