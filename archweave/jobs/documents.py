"""Registered query of strict reading: facts documents made of the derived facts, some with faults, written and read back; with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave.derive import facts, with_views
from archweave.lineage import checkpoint_dir
from archweave.sources import strict_facts as strict

Query = Callable[[SparkSession, str], DataFrame]


def _written(spark: SparkSession, sf: str) -> str:
    """Four snapshots of each repository, a document each; some files have a key that no schema names, some uses stand on line 0."""
    at = ["repo", "snapshot"]
    snapshot = lambda c: F.concat(F.lit("s"), F.col(c) % 4).alias("snapshot")
    code = facts(spark, sf, "code_files")
    file = F.struct("path", F.col("path").alias("contentHash"), F.lit("parsed").alias("parseStatus"), F.lit(0).alias("parseDiagnosticCount"), (F.col("ordinal") % 3 == 0).alias("exportsOnlyTypes"), F.array().cast("array<string>").alias("typeOnlyExportNames"), F.lit(False).alias("hasTopLevelSideEffects"), F.when(F.col("ordinal") % 97 == 5, 1).alias("more"))
    use = F.struct(F.col("path").alias("file"), F.when(F.col("ordinal") % 89 == 7, 0).otherwise(3).alias("line"), F.lit("fetch").alias("symbol"))
    held = code.groupBy("repo", snapshot("ordinal")).agg(F.collect_list(file).alias("files"), F.collect_list(use).alias("ambientUses"))
    edge = F.struct(F.col("from_path").alias("from"), F.lit("./x").alias("specifier"), "kind", F.col("type_only").alias("typeOnly"), "line", F.lit("resolved-project").alias("resolution"), F.col("to_path").alias("target"))
    edges = facts(spark, sf, "dependencies").groupBy("repo", snapshot("from_ordinal")).agg(F.collect_list(edge).alias("dependencies"))
    none = F.array().cast("array<string>")
    fixed = {"schemaVersion": F.lit("1.1"), "completeness": F.lit("complete"), "completenessReasons": none, **{k: F.lit("x") for k in strict.IDENTITIES}, **{k: none for k in ("capabilityUses", "publishCalls", "intentReferences", "safetyUses")}}
    documents = held.join(edges, at, "left").withColumns({"dependencies": F.coalesce("dependencies", F.array()), **fixed})
    folder = f"{checkpoint_dir(spark).rstrip('/')}/facts-{uuid.uuid4()}"
    documents.write.json(folder)
    return folder


def strict_facts(spark: SparkSession, sf: str) -> DataFrame:
    got = strict.read_facts_strictly(spark, _written(spark, sf))
    kinds = [got[name].select("repo", "snapshot", F.lit(name).alias("kind")) for name in ("files", "dependencies", "ambient_uses")]
    rows = kinds[0].union(kinds[1]).union(kinds[2]).union(got["rejects"].select("repo", "snapshot", F.concat(F.lit("rejected: "), "reason")))
    return rows.groupBy("repo", "snapshot", "kind").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return {"strict_facts": strict_facts}


def oracle_sql() -> dict[str, str]:
    snapshot = "'s' || CAST({0} % 4 AS VARCHAR)"
    return {
        "strict_facts": f"""{with_views('code_files', 'dependencies')}, f AS (SELECT repo, {snapshot.format('ordinal')} AS snapshot, ordinal % 97 = 5 AS more, ordinal % 89 = 7 AS zero FROM code_files),
  bad AS (SELECT DISTINCT repo, snapshot FROM f WHERE more OR zero), d AS (SELECT repo, {snapshot.format('from_ordinal')} AS snapshot FROM dependencies),
  r AS (SELECT repo, snapshot, kind FROM (SELECT repo, snapshot, unnest(['files', 'ambient_uses']) AS kind FROM f UNION ALL SELECT repo, snapshot, 'dependencies' FROM d) x WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.repo = x.repo AND b.snapshot = x.snapshot)
   UNION ALL SELECT repo, snapshot, 'rejected: unknown-key' FROM f WHERE more UNION ALL SELECT repo, snapshot, 'rejected: invalid' FROM f WHERE zero)
  SELECT repo, snapshot, kind, count(*) AS n FROM r GROUP BY ALL""",
    }
