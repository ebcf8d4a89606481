"""Change sets and plans: is a change well formed, is a plan, and has the one become the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.contract import Contract
from archweave.functions.paths import is_canonical_path, normalize_path
from archweave.operators.layers import layer_of

OPERATIONS = ("create", "update", "delete")


def preflight_changes(base: DataFrame, changes: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, rule_id, file): bad paths, paths that a change set names twice, deletes of files that aren't there, empty sets.

    changes (repo, ordinal, path, is_delete), base (repo, path). Paths are compared when normalised; the first of a
    path's changes is the one that counts.
    """
    raw = F.replace("path", F.lit("\\"), F.lit("/"))
    clean = normalize_path(F.col("path"))
    bad = (clean == "") | (clean == "..") | clean.startswith("../") | raw.startswith("/") | raw.rlike("^[A-Za-z]:/") | raw.contains("\0")
    rows = changes.select("repo", "ordinal", "is_delete", clean.alias("path"), F.coalesce(bad, F.lit(True)).alias("bad"))
    nth = F.row_number().over(W.partitionBy("repo", "path").orderBy("ordinal"))
    known = rows.where("not bad").withColumn("nth", nth)
    finding = lambda df, rule, file: df.select("repo", F.lit(rule).alias("rule_id"), file.alias("file"))
    lost = known.where("nth = 1 and is_delete").join(base.select("repo", "path"), ["repo", "path"], "left_anti")
    empty = repos.select("repo").join(changes.select("repo").distinct(), "repo", "left_anti")
    parts = [
        finding(rows.where("bad"), "INVALID_CHANGE_PATH", F.lit("<change-set>")),
        finding(known.where("nth > 1"), "DUPLICATE_CHANGE_PATH", F.col("path")),
        finding(lost, "DELETE_TARGET_MISSING", F.col("path")),
        finding(empty, "CHANGE_SET_EMPTY", F.lit("<change-set>")),
    ]
    return reduce(DataFrame.union, parts)


def prepared_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(repo, path, operation, before, after) of each path's first change, with the versions of both sides.

    changes (repo, ordinal, path, is_delete, content_version), base (repo, path, content_version).
    """
    nth = F.row_number().over(W.partitionBy("repo", "path").orderBy("ordinal"))
    first = changes.withColumn("path", normalize_path(F.col("path"))).withColumn("nth", nth).where("nth = 1")
    joined = first.join(base.select("repo", "path", F.col("content_version").alias("before")), ["repo", "path"], "left")
    operation = F.when(F.col("is_delete"), "delete").when(F.col("before").isNotNull(), "update").otherwise("create")
    return joined.select("repo", "path", operation.alias("operation"), "before", F.when(~F.col("is_delete"), F.col("content_version")).alias("after"))


def validate_change_map(files: DataFrame, dependencies: DataFrame, contract: Contract) -> DataFrame:
    """(repo, subject, issue) of a plan's files (repo, ordinal, path, operation, layer) and dependencies (repo, ordinal, from_path, to_path)."""
    canonical = is_canonical_path(F.col("path"))
    known = F.col("layer").isin([x.name for x in contract.layers])
    resolved = layer_of(F.col("path"), contract)
    nth = F.row_number().over(W.partitionBy("repo", "path").orderBy("ordinal"))
    rows = files.select("repo", "path", "operation", "layer", F.coalesce(canonical, F.lit(False)).alias("fine"), F.coalesce(known, F.lit(False)).alias("known"), resolved.alias("resolved"), nth.alias("nth"))
    tests = [
        (~F.col("fine"), "path-not-canonical"),
        (~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), "unknown-operation"),
        (~F.col("known"), "unknown-layer"),
        (F.col("fine") & (F.col("nth") > 1), "duplicate-path"),
        (F.col("fine") & F.col("known") & F.col("resolved").isNull(), "unclassified-path"),
        (F.col("fine") & F.col("known") & (F.col("resolved") != F.col("layer")), "other-layer"),
    ]
    of_files = rows.select("repo", F.col("path").alias("subject"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in tests]))).alias("issue"))
    # Of a path planned twice, the last operation counts.
    planned = rows.where("fine").groupBy("repo", "path").agg(F.max_by("operation", "nth").alias("operation"))
    side = lambda name: planned.select("repo", F.col("path").alias(f"{name}_path"), F.col("operation").alias(f"{name}_operation"))
    again = F.row_number().over(W.partitionBy("repo", "from_path", "to_path").orderBy("ordinal"))
    edges = dependencies.withColumn("again", again).join(side("from"), ["repo", "from_path"], "left").join(side("to"), ["repo", "to_path"], "left")
    tests = [
        (F.col("from_operation").isNull(), "from-not-planned"),
        (F.col("to_operation").isNull(), "to-not-planned"),
        (F.col("from_operation") == "delete", "from-deleted"),
        (F.col("to_operation") == "delete", "to-deleted"),
        (F.col("from_path") == F.col("to_path"), "self-dependency"),
        (F.col("again") > 1, "duplicate-dependency"),
    ]
    subject = F.concat("from_path", F.lit(" -> "), "to_path")
    return of_files.union(edges.select("repo", subject.alias("subject"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in tests]))).alias("issue")))


def convergence_findings(planned: DataFrame, actual: DataFrame, wanted: DataFrame, base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(repo, subject, id, classification): a plan's files and dependencies against what has become of them.

    planned, actual (repo, path, operation); wanted, base, candidate (repo, from_path, to_path). A planned dependency
    whose reverse is there is contradictory, and that reverse edge is no finding of its own. Edges that came or went
    count only where an end is planned or changed; those of planned deletes may go.
    """
    joined = planned.select("repo", "path", F.col("operation").alias("p")).join(actual.select("repo", "path", F.col("operation").alias("a")), ["repo", "path"], "full")
    kind = F.when(F.col("p").isNull(), "unplanned").when(F.col("a").isNull(), "missing").when(F.col("p") == F.col("a"), "satisfied").otherwise("contradictory")
    of_files = joined.select("repo", F.lit("file").alias("subject"), F.col("path").alias("id"), kind.alias("classification"))

    key = ["repo", "from_path", "to_path"]
    mark = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    turned = lambda df: df.select("repo", F.col("to_path").alias("from_path"), F.col("from_path").alias("to_path"))
    edges = mark(wanted, "w").join(mark(base, "b"), key, "full").join(mark(candidate, "c"), key, "full")
    edges = edges.join(mark(turned(candidate), "rc"), key, "left").join(mark(turned(wanted), "rw"), key, "left")
    relevant = planned.select("repo", "path").union(actual.select("repo", "path")).distinct()
    deletes = planned.where("operation = 'delete'").select("repo", "path").distinct()
    at = lambda df, end, name: df.select("repo", F.col("path").alias(end), F.lit(True).alias(name))
    for end in ("from_path", "to_path"):
        edges = edges.join(at(relevant, end, f"near_{end}"), ["repo", end], "left").join(at(deletes, end, f"gone_{end}"), ["repo", end], "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    near = is_("near_from_path") | is_("near_to_path")
    going = is_("gone_from_path") | is_("gone_to_path")
    # The reverse of a planned edge that is missing itself.
    mirror = is_("rw") & ~is_("rc")
    kind = (
        F.when(is_("w"), F.when(is_("c"), "satisfied").when(is_("rc"), "contradictory").otherwise("missing"))
        .when(is_("c") & ~is_("b") & ~mirror & near, "unplanned")
        .when(is_("b") & ~is_("c") & ~going & near, "unplanned")
    )
    # A planned edge that base had and candidate lacks is a removed one too.
    removed = edges.where(is_("w") & is_("b") & ~is_("c") & ~going & near)
    name = F.concat("from_path", F.lit("->"), "to_path")
    of_edges = edges.select("repo", F.lit("dependency").alias("subject"), name.alias("id"), kind.alias("classification")).where("classification is not null")
    return of_files.union(of_edges).union(removed.select("repo", F.lit("dependency"), name, F.lit("unplanned")))


def convergence_summary(findings: DataFrame) -> DataFrame:
    """(repo, counts by classification, converged)."""
    kinds = ["satisfied", "missing", "contradictory", "unplanned"]
    counted = findings.groupBy("repo").agg(*[F.count_if(F.col("classification") == k).alias(f"n_{k}") for k in kinds])
    return counted.withColumn("converged", F.col("n_missing") + F.col("n_contradictory") + F.col("n_unplanned") == 0)


def design_delta(base: DataFrame, candidate: DataFrame, touched: DataFrame) -> DataFrame:
    """(repo, path, smell, symbol, kind, change): findings on touched paths that are new, or worse than in the base.

    base, candidate (repo, path, smell, symbol, kind, magnitude). What has no counterpart at its path is looked for
    elsewhere: where one base finding alone of that (smell, symbol, kind) has lost its place, it has moved.
    """
    key = ["repo", "path", "smell", "symbol", "kind"]
    loose = ["repo", "smell", "symbol", "kind"]
    before = base.groupBy(*key).agg(F.max("magnitude").alias("before"))
    now = candidate.groupBy(*key).agg(F.max("magnitude").alias("magnitude")).join(touched.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    placed = now.join(before, key, "left")
    free = before.join(candidate.select(*key).distinct(), key, "left_anti").groupBy(*loose).agg(F.count("*").alias("n"), F.max("before").alias("moved")).where("n = 1")
    joined = placed.join(free.select(*loose, "moved"), loose, "left")
    known = F.coalesce("before", "moved")
    change = F.when(known.isNull(), "new").when(F.col("magnitude") > known, "worsened")
    return joined.select(*key, change.alias("change")).where("change is not null")


def decision_memory(decisions: DataFrame, anchors: DataFrame, today: str) -> DataFrame:
    """(repo, concept, status, suppresses): decisions (repo, concept, anchors, verdict, review_by) against today's anchors.

    anchors (repo, concept, anchor). A decision on another set of anchors is stale; else its date decides. Current ones
    that reject or defer keep the concept from being proposed.
    """
    from archweave.operators.health import _lifecycle

    sets = anchors.groupBy("repo", "concept").agg(F.array_sort(F.collect_set("anchor")).alias("now"))
    joined = decisions.join(sets, ["repo", "concept"], "left")
    same = F.array_sort(F.array_distinct("anchors")) == F.coalesce("now", F.array().cast("array<string>"))
    status = F.when(~same, "stale").otherwise(_lifecycle(F.col("review_by"), today))
    return joined.select("repo", "concept", status.alias("status"), (status.isin("current", "undated") & F.col("verdict").isin("rejected", "deferred")).alias("suppresses"))
