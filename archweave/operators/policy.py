"""Contracts compared: what a candidate contract strengthens or weakens, per repository, and who has agreed to it.

Contracts are tables keyed by repository, so one call handles a fleet with a contract each:

* layers (repo, layer, optional, patterns, exclude, prefixes, raw_globals, atoms), the last five array<string>
* rules (repo, ordinal, source, target, allowed, peer_isolation, slice_folders array<string>), of which the first of each edge counts
* settings (repo, include, exclude, allowlist array<string>, cycle_policy, exclude_generated,
  max_suppressions, max_any, in_memory, disabled_peers)

Findings are (repo, path, classification, kind); a finding's id is 'classification:path:kind'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRONGER, WEAKER, JUDGE = "strengthening", "weakening", "judgment-required"
#: How strict a cycle policy is.
CYCLES = {"off": 0, "soft": 1, "framework-soft": 1, "strict": 2}


def _both(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., b, a): the rows of each side as structs, null where a side has none."""
    side = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    return before.transform(side, "b").join(after.transform(side, "a"), keys, "full")


def _row(when: Column, path: Column, classification, kind) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(path.alias("path"), lit(classification).alias("classification"), lit(kind).alias("kind")))


def _set(field: str, path: Column, added: str, removed: str) -> list[Column]:
    """Findings on the values of an array field; null counts as empty."""
    none = F.array().cast("array<string>")
    b, a = F.coalesce(F.col(f"b.{field}"), none), F.coalesce(F.col(f"a.{field}"), none)
    return [_row(F.size(F.array_except(a, b)) > 0, path, added, "added"), _row(F.size(F.array_except(b, a)) > 0, path, removed, "removed")]


def _flag(field: str, path: Column, enabled: str) -> Column:
    b, a = F.coalesce(F.col(f"b.{field}"), F.lit(False)), F.coalesce(F.col(f"a.{field}"), F.lit(False))
    other = {STRONGER: WEAKER, WEAKER: STRONGER}[enabled]
    return _row(a != b, path, F.when(a, enabled).otherwise(other), F.when(a, "enabled").otherwise("disabled"))


def _same_set(field: str) -> Column:
    none = F.array().cast("array<string>")
    clean = lambda side: F.array_sort(F.array_distinct(F.coalesce(F.col(f"{side}.{field}"), none)))
    return clean("b") == clean("a")


def _exploded(rows: DataFrame, found: list[Column]) -> DataFrame:
    return rows.select("repo", F.explode(F.array_compact(F.array(*found))).alias("x")).select("repo", "x.*")


def layer_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    path = F.concat(F.lit("$.layers["), "layer", F.lit("]"))
    at = lambda name: F.concat(path, F.lit(f".{name}"))
    rows = _both(before, after, ["repo", "layer"])
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    inside = [
        *_set("patterns", at("patterns"), STRONGER, WEAKER),
        *_set("exclude", at("exclude"), WEAKER, STRONGER),
        *_set("raw_globals", at("forbiddenGlobals"), STRONGER, WEAKER),
        *_set("atoms", at("capabilities"), STRONGER, WEAKER),
        _row(~_same_set("prefixes"), at("intentPrefixes"), JUDGE, "intent-prefixes-changed"),
        _flag("optional", at("optional"), WEAKER),
    ]
    return _exploded(rows, [_row(F.col("b").isNull(), path, JUDGE, "layer-added"), _row(F.col("a").isNull(), path, WEAKER, "layer-removed"), *[F.when(both, x) for x in inside]])


def rule_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    path = F.concat(F.lit("$.rules["), "source", F.lit("->"), "target", F.lit("]"))
    at = lambda name: F.concat(path, F.lit(f".{name}"))
    edge = ["repo", "source", "target"]
    fields = F.struct("allowed", "peer_isolation", "slice_folders")
    first = lambda rules: rules.groupBy(*edge).agg(F.min_by(fields, "ordinal").alias("x")).select(*edge, "x.*")
    rows = _both(first(before), first(after), edge)
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    b, a = F.col("b.peer_isolation"), F.col("a.peer_isolation")
    kind = F.when(a, "peer-isolation-enabled").otherwise("peer-isolation-disabled")
    inside = [
        _row(F.col("b.allowed") != F.col("a.allowed"), at("allowed"), F.when(F.col("a.allowed"), WEAKER).otherwise(STRONGER), F.when(F.col("a.allowed"), "deny-disabled").otherwise("deny-enabled")),
        _row(a != b, at("peerIsolation"), F.when(F.col("source") != F.col("target"), JUDGE).when(a, STRONGER).otherwise(WEAKER), kind),
        _row(~_same_set("slice_folders"), at("sliceFolders"), JUDGE, "slice-folders-changed"),
    ]
    alone = [_row(F.col("b").isNull() & ~F.col("a.allowed"), path, STRONGER, "deny-added"), _row(F.col("a").isNull() & ~F.col("b.allowed"), path, WEAKER, "deny-removed")]
    return _exploded(rows, [*alone, *[F.when(both, x) for x in inside]])


def settings_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Repositories on both sides only."""
    rows = _both(before, after, ["repo"]).where("b is not null and a is not null")
    at = lambda name: F.lit(f"$.{name}")
    cycles = lambda side: F.coalesce(F.col(f"{side}.cycle_policy"), F.lit("strict"))
    rank = lambda side: F.element_at(F.create_map(*[F.lit(x) for kv in CYCLES.items() for x in kv]), cycles(side))

    def threshold(field: str, name: str) -> Column:
        b, a = F.coalesce(F.col(f"b.{field}"), F.lit(0)), F.coalesce(F.col(f"a.{field}"), F.lit(0))
        return _row(a != b, at(name), F.when(a > b, WEAKER).otherwise(STRONGER), F.when(a > b, "threshold-raised").otherwise("threshold-lowered"))

    found = [
        *_set("include", at("include"), STRONGER, WEAKER),
        *_set("exclude", at("exclude"), WEAKER, STRONGER),
        *_set("allowlist", at("dynamicImportAllowlist"), WEAKER, STRONGER),
        _row(cycles("a") != cycles("b"), at("cyclePolicy"), F.when(rank("a") == rank("b"), JUDGE).when(rank("a") > rank("b"), STRONGER).otherwise(WEAKER), "cycle-policy-changed"),
        _flag("exclude_generated", at("excludeGenerated"), WEAKER),
        threshold("max_suppressions", "safety.maxTsSuppressions"),
        threshold("max_any", "safety.maxAnyCasts"),
        _flag("in_memory", at("safety.allowInMemory"), WEAKER),
        _flag("disabled_peers", at("safety.allowDisabledPeerIsolation"), WEAKER),
    ]
    return _exploded(rows, found)


def _first(rules: DataFrame) -> DataFrame:
    """One row of each (repo, layer, rule): of several, the last in the file, as its index keeps it."""
    fields = [c for c in rules.columns if c not in ("repo", "layer", "rule", "ordinal")]
    order = F.col("ordinal") if "ordinal" in rules.columns else F.struct(*fields)
    return rules.groupBy("repo", "layer", "rule").agg(F.max_by(F.struct(*fields), order).alias("x")).select("repo", "layer", "rule", "x.*")


def rule_file_delta(before: dict[str, DataFrame], after: dict[str, DataFrame], coverage: DataFrame | None = None) -> DataFrame:
    """(repo, path, classification, kind) of rule files: references, structure rules and invariants that they hold.

    before, after: rule_files (repo, layer, file), structure (repo, layer, rule, sensor, mode, [ordinal]), invariants
    (repo, layer, rule, mode, [ordinal]); modes are advisory and enforced. coverage (repo, invariant, covered, partial):
    the candidate's evidence; an invariant that is promoted without whole evidence isn't stronger, it is to be judged.
    """
    at = lambda kind, key: F.concat(F.lit(f"$.rules.{kind}["), key, F.lit("]"))
    new, gone = F.col("b").isNull(), F.col("a").isNull()
    both = ~new & ~gone
    path = F.concat(F.lit("$.ruleFiles["), "layer", F.lit("]"))
    references = _both(before["rule_files"].distinct(), after["rule_files"].distinct(), ["repo", "layer"])
    of_files = [_row(new, path, STRONGER, "rule-file-added"), _row(gone, path, WEAKER, "rule-file-removed"), _row(both & (F.col("b.file") != F.col("a.file")), path, JUDGE, "rule-file-moved")]

    key = F.concat("layer", F.lit("::"), "rule")
    up = both & (F.col("b.mode") == "advisory") & (F.col("a.mode") == "enforced")
    down = both & (F.col("b.mode") != F.col("a.mode")) & ~up
    structure = _both(_first(before["structure"]), _first(after["structure"]), ["repo", "layer", "rule"])
    here = at("structure", key)
    inside = lambda name: F.concat(here, F.lit(f".{name}"))
    of_structure = [
        _row(new, here, STRONGER, "structure-added"),
        _row(gone, here, WEAKER, "structure-removed"),
        _row(up, inside("mode"), STRONGER, "structure-promoted"),
        _row(down, inside("mode"), WEAKER, "structure-demoted"),
        _row(both & (F.col("b.sensor") != F.col("a.sensor")), inside("sensor"), JUDGE, "sensor-changed"),
    ]

    invariants = _both(_first(before["invariants"]), _first(after["invariants"]), ["repo", "layer", "rule"])
    if coverage is None:
        invariants = invariants.withColumn("proven", F.lit(False))
    else:
        proof = coverage.groupBy("repo", F.col("invariant").alias("rule")).agg(F.bool_and(F.col("covered") & ~F.col("partial")).alias("proven"))
        invariants = invariants.join(proof, ["repo", "rule"], "left").withColumn("proven", F.coalesce("proven", F.lit(False)))
    place = at("invariants", key)
    mode = F.concat(place, F.lit(".mode"))
    of_invariants = [
        _row(new, place, STRONGER, "invariant-added"),
        _row(gone, place, WEAKER, "invariant-removed"),
        _row(up & F.col("proven"), mode, STRONGER, "invariant-promoted"),
        _row(up & ~F.col("proven"), mode, JUDGE, "invariant-promotion-refused"),
        _row(down, mode, WEAKER, "invariant-demoted"),
    ]
    return reduce(DataFrame.union, [_exploded(references, of_files), _exploded(structure, of_structure), _exploded(invariants, of_invariants)])


def policy_delta(before: dict[str, DataFrame], after: dict[str, DataFrame], coverage: DataFrame | None = None) -> DataFrame:
    """before, after: layers, rules, settings and, where both sides have them, rule_files, structure, invariants
    (``rule_file_delta``). (repo, path, classification, kind, id)."""
    parts = [layer_delta(before["layers"], after["layers"]), rule_delta(before["rules"], after["rules"]), settings_delta(before["settings"], after["settings"])]
    if "rule_files" in before and "rule_files" in after:
        parts.append(rule_file_delta(before, after, coverage))
    return reduce(DataFrame.union, parts).withColumn("id", F.concat_ws(":", "classification", "path", "kind"))


def policy_class(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, classification): the worst of a repository's findings, neutral where there are none."""
    worst = F.max(F.when(F.col("classification") == WEAKER, 3).when(F.col("classification") == JUDGE, 2).otherwise(1))
    known = findings.groupBy("repo").agg(worst.alias("rank"))
    name = F.when(F.col("rank") == 3, WEAKER).when(F.col("rank") == 2, JUDGE).when(F.col("rank") == 1, STRONGER).otherwise("neutral")
    return repos.join(known, "repo", "left").select("repo", name.alias("classification"))


def policy_ack(acks: DataFrame, findings: DataFrame, hashes: DataFrame) -> DataFrame:
    """(repo, valid): an acknowledgement holds for exactly these findings that need one, between exactly these contracts.

    acks (repo, base_hash, candidate_hash, finding_ids, reason), hashes (repo, base_hash, candidate_hash). A repository
    has at most some thousand findings, which is what bounds the set per row.
    """
    wanted = findings.where(F.col("classification").isin(WEAKER, JUDGE)).groupBy("repo").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    joined = hashes.join(wanted, "repo", "left").join(acks.select("repo", F.col("base_hash").alias("b"), F.col("candidate_hash").alias("c"), "finding_ids", "reason"), "repo", "left")
    none = F.array().cast("array<string>")
    same = F.array_sort(F.array_distinct(F.coalesce("finding_ids", none))) == F.coalesce("ids", none)
    valid = (F.col("b") == F.col("base_hash")) & (F.col("c") == F.col("candidate_hash")) & same & (F.trim("reason") != "")
    return joined.select("repo", F.coalesce(valid, F.lit(False)).alias("valid"))


def contract_hashes(layers: DataFrame, rules: DataFrame, hash_of) -> DataFrame:
    """(repo, policy_hash): of the repository's layers and rules in a canonical order. hash_of: Column -> Column."""
    fields = [c for c in sorted(layers.columns) if c != "repo"]
    own = layers.groupBy("repo").agg(F.to_json(F.array_sort(F.collect_list(F.struct("layer", *[c for c in fields if c != "layer"])))).alias("l"))
    edges = rules.groupBy("repo").agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "target", "allowed", "peer_isolation")))).alias("r"))
    joined = own.join(edges, "repo", "left")
    return joined.select("repo", hash_of(F.concat(F.col("l"), F.lit("|"), F.coalesce("r", F.lit("[]")))).alias("policy_hash"))
