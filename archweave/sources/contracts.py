"""Contracts, acknowledgements, ledgers, audit trails and snapshots as tables keyed by repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.contract import DEFAULT_PREFIXES, Contract, Layer, Rule

_CONTRACT = """repo string, include array<string>, exclude array<string>, dynamicImportAllowlist array<string>, cyclePolicy string, excludeGenerated boolean,
 safety struct<maxTsSuppressions: bigint, maxAnyCasts: bigint, allowInMemory: boolean, allowDisabledPeerIsolation: boolean>,
 layers array<struct<name: string, patterns: array<string>, exclude: array<string>, intentPrefixes: array<string>, optional: boolean, pure: boolean,
  capabilities: struct<deny: array<string>>, forbiddenGlobals: array<string>>>,
 rules array<struct<`from`: string, `to`: string, allowed: boolean, peerIsolation: boolean, sliceFolders: array<string>, message: string>>,
 _corrupt string"""
#: Flows that the default rules leave open; all others between the default layers are denied.
OPEN_FLOWS = (
    ("PresentationAdapters", "ApplicationOrchestration"),
    ("ApplicationOrchestration", "DomainModel"),
    ("WorkflowSagaEngine", "ApplicationOrchestration"),
    ("WorkflowSagaEngine", "DomainModel"),
    ("BackgroundJobsScheduling", "ApplicationOrchestration"),
)


def default_rules() -> list[tuple[str, str]]:
    """The edges that a contract without rules denies, in the order of the default layers."""
    names = list(DEFAULT_PREFIXES)
    return [(a, b) for a in names for b in names if a != b and (a, b) not in OPEN_FLOWS]


def read_contract(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One JSON contract a line -> layers, rules, settings (as ``operators.policy`` takes them), and rejects (raw, reason).

    A contract without rules gets the default ones. All rules stay, in their order: the first that denies an edge counts, and only
    ``allowed: false`` denies.
    """
    raw = spark.read.schema(_CONTRACT).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    good = raw.where("_corrupt is null and repo is not null")
    none = F.array().cast("array<string>")
    or_none = lambda c: F.coalesce(c, none)
    defaults = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(False).alias("allowed"), F.lit(None).cast("boolean").alias("peerIsolation"), F.lit(None).cast("array<string>").alias("sliceFolders"), F.lit(None).cast("string").alias("message")) for a, b in default_rules()])
    layers = good.select("repo", F.posexplode("layers").alias("ordinal", "x"))
    layers = layers.select("repo", "ordinal", F.col("x.name").alias("layer"), F.coalesce("x.optional", F.lit(False)).alias("optional"), F.coalesce("x.pure", F.lit(False)).alias("pure"), or_none("x.patterns").alias("patterns"), or_none("x.exclude").alias("exclude"), or_none("x.intentPrefixes").alias("prefixes"), or_none("x.capabilities.deny").alias("deny"), or_none("x.forbiddenGlobals").alias("forbidden_globals"))
    rules = good.select("repo", F.posexplode(F.coalesce("rules", defaults)).alias("ordinal", "x"))
    rules = rules.select("repo", "ordinal", F.col("x.from").alias("source"), F.col("x.to").alias("target"), F.coalesce("x.allowed", F.lit(True)).alias("allowed"), F.coalesce("x.peerIsolation", F.lit(False)).alias("peer_isolation"), or_none("x.sliceFolders").alias("slice_folders"), F.coalesce("x.message", F.lit("")).alias("message"))
    settings = good.select(
        "repo",
        F.coalesce("include", F.array(F.lit("src"))).alias("include"),
        or_none("exclude").alias("exclude"),
        or_none("dynamicImportAllowlist").alias("allowlist"),
        F.coalesce("cyclePolicy", F.lit("strict")).alias("cycle_policy"),
        F.coalesce("excludeGenerated", F.lit(True)).alias("exclude_generated"),
        F.coalesce("safety.maxTsSuppressions", F.lit(0)).alias("max_suppressions"),
        F.coalesce("safety.maxAnyCasts", F.lit(0)).alias("max_any"),
        F.coalesce("safety.allowInMemory", F.lit(False)).alias("in_memory"),
        F.coalesce("safety.allowDisabledPeerIsolation", F.lit(False)).alias("disabled_peers"),
    )
    rejects = raw.where("_corrupt is not null or repo is null").select("repo", F.when(F.col("_corrupt").isNotNull(), "not-json").otherwise("no-repo").alias("reason"))
    return {"layers": layers, "rules": rules, "settings": settings, "rejects": rejects}


def contract_tables(contract: Contract, repos: DataFrame) -> dict[str, DataFrame]:
    """layers and rules of one contract, for each repository."""
    strings = lambda values: F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    each = [F.struct(F.lit(i).alias("ordinal"), F.lit(x.name).alias("layer"), F.lit(x.optional).alias("optional"), strings(x.patterns).alias("patterns"), strings(x.exclude).alias("exclude"), strings(x.prefixes).alias("prefixes")) for i, x in enumerate(contract.layers)]
    edges = [F.struct(F.lit(i).alias("ordinal"), F.lit(r.source).alias("source"), F.lit(r.target).alias("target"), F.lit(r.allowed).alias("allowed"), F.lit(r.peer_isolation).alias("peer_isolation"), strings(r.slice_folders).alias("slice_folders"), F.lit(r.message).alias("message")) for i, r in enumerate(contract.rules)]
    table = lambda rows: repos.select("repo", F.explode(F.array(*rows)).alias("x")).select("repo", "x.*")
    return {"layers": table(each), "rules": table(edges)}


def as_contract(layers: DataFrame, rules: DataFrame, repo: str, most: int = 10_000) -> Contract:
    """One repository's contract as a driver-side value; more than ``most`` layers or rules are refused."""

    def rows(table: DataFrame) -> list:
        found = table.where(F.col("repo") == repo).orderBy("ordinal").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"the contract of {repo} has more than {most} layers or rules; operators.fleet takes it as a table")
        return found

    own = tuple(Layer(x.layer, tuple(x.patterns), tuple(x.exclude), tuple(x.prefixes), x.optional) for x in rows(layers))
    return Contract(own, tuple(Rule(r.source, r.target, r.allowed, r.peer_isolation, tuple(r.slice_folders), r.message or "") for r in rows(rules)))


def read_structure_rules(references: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, problem, blocking): rule files that a layer refers to but that aren't there, and files that nobody refers to.

    references (repo, layer, path), files (repo, path).
    """
    there, asked = files.select("repo", "path").distinct(), references.select("repo", "path").distinct()
    lost = asked.join(there, ["repo", "path"], "left_anti").select("repo", "path", F.lit("missing-file").alias("problem"), F.lit(True).alias("blocking"))
    return lost.union(there.join(asked, ["repo", "path"], "left_anti").select("repo", "path", F.lit("unreferenced-file"), F.lit(False)))


def valid_acks(entries: DataFrame) -> DataFrame:
    """entries (repo, file, smell, edge, review_by) of the files all of whose entries are well formed; a bad file suppresses nothing."""
    fine = F.col("smell").isNotNull() & (F.trim(F.coalesce("edge", F.lit(""))) != "")
    good = entries.groupBy("repo", "file").agg(F.bool_and(fine).alias("good")).where("good").select("repo", "file")
    return entries.join(good, ["repo", "file"], "left_semi")


def read_acks(spark: SparkSession, path: str) -> DataFrame:
    """Acknowledgement files, one JSON document each, with an array of entries -> those of well-formed files."""
    schema = "repo string, acks array<struct<id: string, edge: string, reviewBy: string>>, _corrupt string"
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path, multiLine=True)
    rows = raw.where("_corrupt is null and acks is not null").select("repo", F.input_file_name().alias("file"), F.explode("acks").alias("x"))
    return valid_acks(rows.select("repo", "file", F.col("x.id").alias("smell"), "x.edge", F.col("x.reviewBy").alias("review_by"))).drop("file")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger entries, one JSON document a line: (ledger, manifest_hash, sequence, previous_hash, entry_hash, cell_id, started_at, ended_at)."""
    schema = "ledger string, manifestHash string, sequence bigint, previousHash string, entryHash string, cellId string, startedAt timestamp, endedAt timestamp"
    raw = spark.read.schema(schema).json(path)
    return raw.select("ledger", F.col("manifestHash").alias("manifest_hash"), "sequence", F.col("previousHash").alias("previous_hash"), F.col("entryHash").alias("entry_hash"), F.col("cellId").alias("cell_id"), F.col("startedAt").alias("started_at"), F.col("endedAt").alias("ended_at"))


def append_audit(records: DataFrame, path: str, at: str = "occurred_at") -> None:
    """Adds audit records to the trail, by day, so that queries over a span of time read its days only."""
    records.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def append_snapshot(reports: DataFrame, path: str) -> None:
    """Adds one report (repo, ts, ...) a repository to the snapshots."""
    reports.write.mode("append").parquet(path)


def retained_snapshots(snapshots: DataFrame, newest: int) -> DataFrame:
    """Of each repository's snapshots the first one and the newest ``newest``."""
    first, last = W.partitionBy("repo").orderBy("ts"), W.partitionBy("repo").orderBy(F.desc("ts"))
    ranked = snapshots.withColumns({"_first": F.row_number().over(first), "_last": F.row_number().over(last)})
    return ranked.where((F.col("_first") == 1) | (F.col("_last") <= newest)).drop("_first", "_last")
