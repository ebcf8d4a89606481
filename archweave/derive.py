"""Fact tables derived from the star-schema test tables: what the governance jobs read where no real facts exist.

Each view is SQL that Spark and DuckDB read alike; the oracle puts the same text in front of its queries.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = {
    "code_files": ["documents"],
    "dependencies": ["documents"],
    "domain_events": ["events"],
    "workflow_steps": ["conversations"],
    "experiment_cells": ["orders"],
    "intent_flows": ["lineitem"],
    "commit_paths": ["lineitem"],
    "tree_base": ["documents"],
    "tree_candidate": ["documents"],
}

CODE_FILES = """SELECT source AS repo, doc_id AS ordinal, lang, n_chars,
 concat('src/', CASE CAST(floor(doc_id / 20) AS BIGINT) % 9 WHEN 0 THEN 'domain' WHEN 1 THEN 'application' WHEN 2 THEN 'adapters/persistence'
  WHEN 3 THEN 'presentation' WHEN 4 THEN concat('features/', lang) WHEN 5 THEN 'kernel' WHEN 6 THEN 'lib'
  WHEN 7 THEN concat('features/', lang, '/ui') ELSE 'domain/gen' END, '/f', doc_id,
  CASE CAST(floor(doc_id / 20) AS BIGINT) % 9 WHEN 8 THEN '.gen.ts' ELSE '.ts' END) AS path
FROM documents"""

DEPENDENCIES = """SELECT f.repo, f.path AS from_path, t.path AS to_path, f.ordinal AS from_ordinal, t.ordinal AS to_ordinal, k.k AS ordinal,
 CASE WHEN (f.ordinal + k.k) % 11 = 0 THEN 'dynamic-import' WHEN (f.ordinal + k.k) % 7 = 0 THEN 'require' WHEN k.k = 3 THEN 'export' ELSE 'import' END AS kind,
 (f.ordinal + k.k) % 6 = 0 AS type_only, k.k * 3 AS line
FROM code_files f CROSS JOIN (SELECT CAST(1 AS BIGINT) AS k UNION ALL SELECT CAST(2 AS BIGINT) UNION ALL SELECT CAST(3 AS BIGINT)) k
JOIN code_files t ON t.repo = f.repo
 AND t.ordinal = (f.ordinal + 20 * (k.k * k.k + f.ordinal % 5)) % (SELECT count(*) FROM documents)"""

DOMAIN_EVENTS = """SELECT event_id, ts AS occurred_at, concat('c', user_id) AS correlation_id, value, props AS payload,
 CASE event_type WHEN 'purchase' THEN 'Domain.Order.Placed' WHEN 'signup' THEN 'Domain.User.Registered' WHEN 'click' THEN 'Application.Ui.Clicked'
  WHEN 'view' THEN 'Reporting.Page.Viewed' ELSE 'raw-error' END AS intent,
 CASE user_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN 'Adapter.Persistence.Orders' WHEN 3 THEN 'Application.PlaceOrder'
  WHEN 4 THEN 'Presentation.Web' ELSE 'Domain.Order' END AS source,
 CASE event_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '9' ELSE NULL END AS event_version
FROM events"""

WORKFLOW_STEPS = """SELECT conv_id AS workflow_id, turn AS seq, concat('step', turn) AS step, CAST(1 + (conv_id + turn) % 3 AS BIGINT) AS attempts,
 CASE WHEN (conv_id * 7 + turn) % 9 = 0 THEN 'failed' ELSE 'completed' END AS outcome, turn % 2 = 0 AS has_compensation FROM conversations"""

EXPERIMENT_CELLS = """SELECT CAST(floor(o_orderkey / 2) AS BIGINT) AS pair_id, CASE o_orderkey % 2 WHEN 0 THEN 'control' ELSE 'treatment' END AS arm,
 CAST(floor(o_orderkey / 2) AS BIGINT) % 6 AS repository_id, CAST(floor(o_orderkey / 2) AS BIGINT) % 24 AS task_id,
 CASE WHEN o_orderstatus = 'F' THEN 'first_valid' ELSE 'censored' END AS outcome,
 CASE WHEN o_orderstatus = 'F' THEN least(CAST(floor(o_totalprice) AS BIGINT) + 1, 240000) ELSE 240000 END AS restricted_ms FROM orders"""

INTENT_FLOWS = """SELECT concat('Application.S', l_suppkey) AS from_intent, concat('Domain.P', l_partkey) AS to_intent,
 CASE WHEN l_linestatus = 'O' THEN 'produces' ELSE 'observed' END AS kind FROM lineitem"""

COMMIT_PATHS = "SELECT l_orderkey AS commit_id, concat('r', l_orderkey % 7) AS repo, concat('src/p', l_partkey % 500, '.ts') AS path FROM lineitem"

TREE_BASE = "SELECT repo, path, n_chars AS content_version FROM code_files WHERE ordinal % 10 <> 0"

TREE_CANDIDATE = "SELECT repo, path, n_chars + CASE WHEN ordinal % 13 = 0 THEN 1 ELSE 0 END AS content_version FROM code_files WHERE ordinal % 10 <> 1"

_TWICE = "(SELECT CAST(1 AS BIGINT) AS k UNION ALL SELECT CAST(2 AS BIGINT)) k"

MODULE_IMPORTS = f"""SELECT f.repo, f.path AS file, k.k AS ordinal, 10 * k.k AS line, CASE k.k WHEN 1 THEN 'import' ELSE 'require' END AS kind, f.ordinal % 8 = 0 AS type_only,
 CASE (f.ordinal + k.k) % 9 WHEN 0 THEN 'fs' WHEN 1 THEN 'node:fs/promises' WHEN 2 THEN 'pg' WHEN 3 THEN 'axios/lib/core' WHEN 4 THEN 'process' WHEN 5 THEN '@prisma/client/edge'
  WHEN 6 THEN concat('./x/.././f', f.ordinal + 180) WHEN 7 THEN '../none' ELSE 'left-pad' END AS specifier
FROM code_files f CROSS JOIN {_TWICE}"""

AMBIENT_USES = f"""SELECT f.repo, f.path AS file, 20 + k.k AS line,
 CASE (2 * f.ordinal + k.k) % 7 WHEN 0 THEN 'fetch' WHEN 1 THEN 'Date.now' WHEN 2 THEN 'Math.random' WHEN 3 THEN 'process.env.HOME' WHEN 4 THEN 'process.cwd' WHEN 5 THEN 'window.location' ELSE 'Dated' END AS symbol
FROM code_files f CROSS JOIN {_TWICE}"""

PUBLISH_CALLS = """SELECT repo, path AS file, CAST(7 AS BIGINT) AS line, CASE ordinal % 4 WHEN 0 THEN 'Domain.Order.Placed' WHEN 1 THEN 'not an intent' END AS raw_intent, ordinal % 6 = 0 AS object_has_intent,
 ordinal % 3 <> 0 AS candidate, ordinal % 2 = 0 AS has_source, CASE ordinal % 5 WHEN 0 THEN 'Domain.Order' WHEN 1 THEN 'Application.PlaceOrder' WHEN 2 THEN 'Presentation.Web' WHEN 3 THEN 'Nobody.Knows' END AS source_intent FROM code_files"""

INTENT_REFERENCES = """SELECT repo, path AS file, CAST(9 AS BIGINT) AS line,
 CASE ordinal % 4 WHEN 0 THEN 'Application.Ship' WHEN 1 THEN 'Domain.Order' WHEN 2 THEN 'Adapter.Persistence.Orders' ELSE 'Nobody.Knows' END AS intent FROM code_files"""

CLASS_SHAPES = """SELECT repo, path AS file, concat('C', ordinal) AS class_name, ordinal % 7 <> 0 AS exported, ordinal % 5 = 0 AS public_setters, ordinal % 11 = 0 AS public_mutable, ordinal % 2 = 0 AS public_constructor,
 ordinal % 3 = 0 AS static_factory, CASE ordinal % 4 WHEN 0 THEN true WHEN 1 THEN false END AS data_only, ordinal % 3 AS n_mutating, ordinal % 13 = 0 AS guarded FROM code_files"""

SAFETY_USES = f"""SELECT f.repo, f.path AS file, 30 + k.k AS line, 3 * f.ordinal + k.k AS ordinal,
 CASE (f.ordinal + k.k) % 6 WHEN 0 THEN 'ts-suppression' WHEN 1 THEN 'any-cast' WHEN 2 THEN 'dynamic-import' WHEN 3 THEN 'dynamic-require' WHEN 4 THEN 'in-memory-store' ELSE 'other' END AS kind
FROM code_files f CROSS JOIN {_TWICE}"""

#: Scripts: some lines of code by ordinal, then the document's text as prose.
SOURCES = """SELECT f.repo, f.path, f.ordinal, f.ordinal % 23 = 0 AS is_test, concat(
 CASE f.ordinal % 5 WHEN 0 THEN concat('import { db } from ''pg'';', chr(10)) WHEN 1 THEN concat('import x from ''./other'';', chr(10)) ELSE '' END,
 CASE f.ordinal % 7 WHEN 0 THEN concat('export function canShip(order) { if (order.total > 3) { return 1 } }', chr(10)) WHEN 1 THEN concat('export function GET() {}', chr(10))
  WHEN 2 THEN concat('const shouldShow = () => useState(isOpen);', chr(10)) WHEN 3 THEN concat('const shouldOpen = () => cart.limit > 1;', chr(10)) WHEN 4 THEN concat('const toDomain = (row) => row;', chr(10)) ELSE '' END,
 CASE WHEN f.ordinal % 6 = 0 THEN repeat(concat('if (status) { go() } switch (x) {}', chr(10)), 3) ELSE '' END,
 CASE WHEN f.ordinal % 11 = 0 THEN repeat(concat('export const a = 1', chr(10)), 500) ELSE '' END,
 CASE WHEN f.ordinal % 46 = 0 THEN concat('it(''INV-1 holds'')', chr(10)) ELSE '' END, CASE WHEN f.ordinal % 31 = 0 THEN concat('class Order { place() {} }', chr(10)) ELSE '' END,
 coalesce(d.text, '')) AS content
FROM code_files f JOIN documents d ON d.doc_id = f.ordinal"""

#: Three snapshots a repository; from each, files are missing, and from the last but one their layer has moved.
SNAPSHOT_FILES = """SELECT f.repo, concat('s', k.k) AS snapshot, f.ordinal, CASE WHEN k.k = 2 THEN replace(f.path, 'src/lib/', 'src/kernel/') ELSE f.path END AS path
FROM code_files f CROSS JOIN (SELECT CAST(1 AS BIGINT) AS k UNION ALL SELECT CAST(2 AS BIGINT) UNION ALL SELECT CAST(3 AS BIGINT)) k WHERE f.ordinal % 7 <> k.k"""

SNAPSHOT_DEPENDENCIES = """SELECT d.repo, concat('s', k.k) AS snapshot, CASE WHEN k.k = 2 THEN replace(d.from_path, 'src/lib/', 'src/kernel/') ELSE d.from_path END AS from_path,
 CASE WHEN k.k = 2 THEN replace(d.to_path, 'src/lib/', 'src/kernel/') ELSE d.to_path END AS to_path, d.type_only, d.line
FROM dependencies d CROSS JOIN (SELECT CAST(1 AS BIGINT) AS k UNION ALL SELECT CAST(2 AS BIGINT) UNION ALL SELECT CAST(3 AS BIGINT)) k WHERE d.from_ordinal % 7 <> k.k"""

VIEWS = {
    "code_files": CODE_FILES,
    "dependencies": DEPENDENCIES,
    "domain_events": DOMAIN_EVENTS,
    "workflow_steps": WORKFLOW_STEPS,
    "experiment_cells": EXPERIMENT_CELLS,
    "intent_flows": INTENT_FLOWS,
    "commit_paths": COMMIT_PATHS,
    "tree_base": TREE_BASE,
    "tree_candidate": TREE_CANDIDATE,
    "module_imports": MODULE_IMPORTS,
    "ambient_uses": AMBIENT_USES,
    "publish_calls": PUBLISH_CALLS,
    "intent_references": INTENT_REFERENCES,
    "class_shapes": CLASS_SHAPES,
    "safety_uses": SAFETY_USES,
    "sources": SOURCES,
    "snapshot_files": SNAPSHOT_FILES,
    "snapshot_dependencies": SNAPSHOT_DEPENDENCIES,
}
_OF_FILES = ("dependencies", "tree_base", "tree_candidate", "module_imports", "ambient_uses", "publish_calls", "intent_references", "class_shapes", "safety_uses", "sources", "snapshot_files")
_NEEDS = {name: ["code_files"] for name in _OF_FILES}
_NEEDS["snapshot_dependencies"] = ["code_files", "dependencies"]
TABLES |= {name: ["documents"] for name in (*_OF_FILES, "snapshot_dependencies")}
#: For Spark, views whose joins its optimizer would reorder to a join on repo alone: the same rows, each end's key made before the join.
_FOR_SPARK = {
    "dependencies": """SELECT f.repo, f.path AS from_path, t.path AS to_path, f.ordinal AS from_ordinal, t.ordinal AS to_ordinal, f.k AS ordinal,
 CASE WHEN (f.ordinal + f.k) % 11 = 0 THEN 'dynamic-import' WHEN (f.ordinal + f.k) % 7 = 0 THEN 'require' WHEN f.k = 3 THEN 'export' ELSE 'import' END AS kind,
 (f.ordinal + f.k) % 6 = 0 AS type_only, f.k * 3 AS line
FROM (SELECT repo, path, ordinal, k, (ordinal + 20 * (k * k + ordinal % 5)) % (SELECT count(*) FROM documents) AS wanted
  FROM (SELECT repo, path, ordinal, explode(array(1L, 2L, 3L)) AS k FROM code_files)) f
JOIN code_files t ON t.repo = f.repo AND t.ordinal = f.wanted""",
}
#: Names of the views while they are read, so that a session's own tables and views aren't replaced.
_PREFIX = "archweave_"


_SCHEMAS: dict[str, StructType] = {}


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A table, whose schema is looked up in its files the first time only."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view over the tables of ``sf_dir``."""
    used = {x: _PREFIX + x for x in (*TABLES[name], *_NEEDS.get(name, []))}
    own = lambda sql: reduce(lambda text, kv: re.sub(rf"(FROM|JOIN) {kv[0]}\b", rf"\1 {kv[1]}", text), used.items(), sql)
    for table in TABLES[name]:
        _read(spark, f"{sf_dir}/{table}.parquet").createOrReplaceTempView(used[table])
    for needed in _NEEDS.get(name, []):
        spark.sql(own(_FOR_SPARK.get(needed, VIEWS[needed]))).createOrReplaceTempView(used[needed])
    return spark.sql(own(_FOR_SPARK.get(name, VIEWS[name])))


def with_views(*names: str) -> str:
    """The same views as a WITH clause for the oracle."""
    needed = dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n])
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
