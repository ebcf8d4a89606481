"""Trees and plans compared: full outer joins on (repo, path), hashes or versions instead of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tree_diff(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(repo, path, change): created, deleted or changed. Trees: (repo, path, content_version)."""
    b = base.select("repo", "path", F.col("content_version").alias("before"), F.lit(True).alias("in_base"))
    c = candidate.select("repo", "path", F.col("content_version").alias("after"), F.lit(True).alias("in_candidate"))
    change = F.when(F.col("in_base").isNull(), "created").when(F.col("in_candidate").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return b.join(c, ["repo", "path"], "full").select("repo", "path", change.alias("change")).where("change is not null")


def overlay_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Base files with a change set (repo, path, operation, content_version) applied."""
    joined = base.join(changes.select("repo", "path", "operation", F.col("content_version").alias("new")), ["repo", "path"], "full")
    kept = joined.where(F.col("operation").isNull() | (F.col("operation") != "delete"))
    return kept.select("repo", "path", F.when(F.col("operation").isNull(), F.col("content_version")).otherwise(F.col("new")).alias("content_version"))


def preflight_resolved(base: DataFrame, candidate: DataFrame, declared: DataFrame) -> DataFrame:
    """(repo, path, issue): candidate changes that nobody declared, and declared ones that didn't happen."""
    actual = tree_diff(base, candidate).withColumn("operation", F.expr("CASE change WHEN 'created' THEN 'create' WHEN 'deleted' THEN 'delete' ELSE 'update' END"))
    joined = actual.join(declared.select("repo", "path", F.col("operation").alias("said")), ["repo", "path"], "full")
    issue = F.when(F.col("said").isNull(), "undeclared").when(F.col("operation").isNull(), F.when(F.col("said") == "delete", "delete-not-applied").otherwise("change-missing")).when(F.col("said") != F.col("operation"), "other-operation")
    return joined.select("repo", "path", issue.alias("issue")).where("issue is not null")


def convergence(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """Per repo: planned files satisfied, missing, contradictory, and unplanned changes; converged if all are satisfied."""
    joined = planned.select("repo", "path", F.col("operation").alias("p")).join(actual.select("repo", "path", F.col("operation").alias("a")), ["repo", "path"], "full")
    kind = F.when(F.col("p").isNull(), "unplanned").when(F.col("a").isNull(), "missing").when(F.col("p") == F.col("a"), "satisfied").otherwise("contradictory")
    kinds = ["satisfied", "missing", "contradictory", "unplanned"]
    counted = joined.select("repo", kind.alias("kind")).groupBy("repo").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    return counted.withColumn("converged", F.col("n_missing") + F.col("n_contradictory") + F.col("n_unplanned") == 0)


def change_set_gate(changes: DataFrame, law: str, product: str) -> DataFrame:
    """(change_id, counts, gate) of paths by kind; law and product are patterns of paths."""
    kind = F.when(F.col("path").rlike(law), "law").when(F.col("path").rlike(product), "product").otherwise("other")
    counts = changes.select("change_id", kind.alias("kind")).groupBy("change_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("law", "product", "other")])
    gate = F.when((F.col("n_law") > 0) & (F.col("n_product") > 0), "mixed").when(F.col("n_law") > 0, "law").otherwise("open")
    return counts.withColumn("gate", gate)


def hot_paths(commits: DataFrame, last: int, least: int, most: int = 8) -> DataFrame:
    """commits (repo, commit_id, path) -> (repo, path, hits, place): over each repository's last commits, the ``most`` changed paths.

    The cut is a rank over distinct commits, so that each task keeps ``last`` commits a repository before the shuffle.
    """
    recent = commits.select("repo", "commit_id").distinct().withColumn("k", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("commit_id")))).where(F.col("k") <= last)
    hits = commits.join(recent.select("repo", "commit_id"), ["repo", "commit_id"], "left_semi").groupBy("repo", "path").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    return hits.withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("hits"), "path")).cast("long")).where(F.col("place") <= most)


def team_gate(sets: DataFrame) -> DataFrame:
    """sets (change_id, n_law, n_product, session, policy, n_grow, has_stewards, is_steward) -> (change_id, reason).

    policy: loosen, tighten or the like. ok, or the first reason to refuse: mixed sets; law without a session; loosening
    or a growing baseline without a session, or by someone who isn't a steward where there are some.
    """
    loosen, grow = F.coalesce(F.col("policy") == "loosen", F.lit(False)), F.col("n_grow") > 0
    why = F.when(loosen, "steward-only-loosen").otherwise("steward-only-baseline-grow")
    asks = loosen | grow
    reason = (
        F.when((F.col("n_law") > 0) & (F.col("n_product") > 0), "mixed-law-and-product")
        .when((F.col("n_law") > 0) & ~F.col("session"), "law-in-feature")
        .when(asks & ~F.col("session"), why)
        .when(asks & F.col("has_stewards") & ~F.col("is_steward"), why)
        .otherwise("ok")
    )
    return sets.select("change_id", reason.alias("reason"))


def evolution(snapshots: DataFrame) -> DataFrame:
    """snapshots (repo, ts, layer, n_files): per repo and layer, files at the first and last snapshot, and the delta."""
    edge = snapshots.groupBy("repo").agg(F.min("ts").alias("origin"), F.max("ts").alias("latest"))
    joined = snapshots.join(edge, "repo")
    summed = lambda c: F.coalesce(F.sum(F.when(F.col("ts") == F.col(c), F.col("n_files"))), F.lit(0))
    out = joined.groupBy("repo", "layer").agg(summed("origin").alias("n_origin"), summed("latest").alias("n_latest"))
    return out.withColumn("delta", F.col("n_latest") - F.col("n_origin"))
