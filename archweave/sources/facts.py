"""Facts documents, baselines and source trees as tables. Schemas are explicit; what doesn't fit is set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_FACTS = """repo string, snapshot string, schemaVersion string,
 files array<struct<path: string, contentHash: string, parseStatus: string, parseDiagnosticCount: bigint, exportsOnlyTypes: boolean>>,
 dependencies array<struct<`from`: string, specifier: string, kind: string, typeOnly: boolean, line: bigint, resolution: string, target: string>>,
 publishCalls array<struct<file: string, line: bigint, intent: string, source: string>>,
 _corrupt string"""
VERSIONS = ("1.0", "1.1")


def read_facts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One JSON document a line and (repo, snapshot) -> files, dependencies, publish_calls, and rejects (raw, reason)."""
    raw = spark.read.schema(_FACTS).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    reason = F.when(F.col("_corrupt").isNotNull(), "not-json").when(F.col("repo").isNull(), "no-repo").when(~F.coalesce(F.col("schemaVersion").isin(*VERSIONS), F.lit(False)), "version")
    judged = raw.withColumn("reason", reason)
    good = judged.where("reason is null")
    at = ["repo", "snapshot"]
    table = lambda name: good.select(*at, F.posexplode(name).alias("ordinal", "x"))
    dependencies = table("dependencies").select(*at, "ordinal", F.col("x.from").alias("from_path"), F.col("x.target").alias("to_path"), "x.specifier", "x.kind", F.coalesce("x.typeOnly", F.lit(False)).alias("type_only"), "x.line", "x.resolution")
    return {
        "files": table("files").select(*at, "ordinal", "x.path", F.col("x.contentHash").alias("content_hash"), F.col("x.parseStatus").alias("parse_status"), F.col("x.parseDiagnosticCount").alias("diagnostics")),
        "dependencies": dependencies.withColumn("to_path", F.when(F.col("resolution") == "resolved-project", F.col("to_path"))),
        "publish_calls": table("publishCalls").select(*at, "ordinal", "x.file", "x.line", "x.intent", "x.source"),
        "rejects": judged.where("reason is not null").select("repo", "snapshot", "reason"),
    }


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(repo, key) of frozen violations: of the older list and the newer map of records alike."""
    raw = spark.read.schema("repo string, violations array<string>, records map<string, string>").json(path)
    keys = F.array_union(F.coalesce("violations", F.array().cast("array<string>")), F.coalesce(F.map_keys("records"), F.array().cast("array<string>")))
    return raw.select("repo", F.explode(keys).alias("key")).distinct()


def write_baseline(keyed: DataFrame, path: str) -> None:
    keyed.select("repo", "key").distinct().groupBy("repo").agg(F.array_sort(F.collect_list("key")).alias("violations")).write.mode("overwrite").json(path)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of source files: scripts, without declarations and tests."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return files.where(F.col("path").rlike(r"\.[cm]?[tj]sx?$") & ~F.col("path").rlike(r"(\.d\.[cm]?ts$)|(\.(test|spec)\.[cm]?[tj]sx?$)|/node_modules/"))


def validate_fact_keys(files: DataFrame, child: DataFrame, column: str) -> DataFrame:
    """(repo, path, issue): paths that occur twice, and child facts of files that don't exist."""
    twice = files.groupBy("repo", "path").agg(F.count("*").alias("n")).where("n > 1").select("repo", "path", F.lit("duplicate-path").alias("issue"))
    lost = child.select("repo", F.col(column).alias("path")).distinct().join(files.select("repo", "path"), ["repo", "path"], "left_anti")
    return twice.union(lost.select("repo", "path", F.lit("unknown-file").alias("issue")))


def parse_health(files: DataFrame, most: int = 12) -> DataFrame:
    """Per repo: files with diagnostics, all diagnostics, the first ``most`` such paths."""
    bad = files.where(F.col("diagnostics") > 0).withColumn("k", F.row_number().over(W.partitionBy("repo").orderBy("path")))
    first = bad.where(F.col("k") <= most).groupBy("repo").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    counts = files.groupBy("repo").agg(F.count_if(F.col("diagnostics") > 0).alias("n_affected"), F.sum("diagnostics").alias("n_diagnostics"))
    return counts.join(first, "repo", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def dynamic_blind_spots(dependencies: DataFrame, most: int = 8) -> DataFrame:
    """(repo, n, n_template, first): imports whose target no scan can tell, how many are templates, the first ``most`` places.

    dependencies (repo, from_path, line, resolution, reason); reason is template-interpolation or non-literal.
    """
    open_ = dependencies.where(F.col("resolution") == "dynamic")
    place = F.concat("from_path", F.lit(":"), "line")
    ranked = open_.withColumn("k", F.row_number().over(W.partitionBy("repo").orderBy("from_path", "line", "reason")))
    first = ranked.where(F.col("k") <= most).groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", place.alias("at")))), lambda x: x["at"]), ",").alias("first"))
    return open_.groupBy("repo").agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "template-interpolation").alias("n_template")).join(first, "repo")


def tree_hashes(files: DataFrame, buckets: int = 256) -> DataFrame:
    """files (repo, path, content_hash) -> (repo, tree_hash), the same for the same paths and contents in any order.

    A tree is hashed in two levels: by ``buckets`` of paths, each in order of path, then the buckets' hashes, so a giant
    repository is no single task's work.
    """
    entry = F.to_json(F.struct(F.col("content_hash").alias("contentHash"), "path"))
    own = files.groupBy("repo", F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))), lambda x: x["e"]), ","), 256).alias("h"))
    return own.groupBy("repo").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("tree_hash"))
