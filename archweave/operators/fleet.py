"""Contracts of many repositories in one job: globs and rules are data that files and edges meet in a join.

``operators.layers`` makes one contract part of the plan. Here contracts are tables, as ``sources.contracts`` reads them,
keyed by repository (and by snapshot where they have one):

* layers (repo, ordinal, layer, patterns array<string>, exclude array<string>)
* rules (repo, ordinal, source, target, allowed, peer_isolation, slice_folders array<string>, message)

``compiled`` turns each glob, once, into what rows need: a literal head, a regular expression, the parts of its rank. A
contract becomes one row; files join it by repository, and edges join the denying rules of their pair of layers. Both are
broadcast while they are small (checked), else joined by shuffle, where AQE splits the files of a giant repository.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archweave.functions.paths import concrete_segments, glob_to_regex, segments
from archweave.keys import scope, shared, sized
from archweave.lineage import cut
from archweave.operators.layers import folders_of
from archweave.ship import ship_package

#: Contracts, or pairs of layers with denying rules, that are broadcast.
SMALL = 20_000
_GLOB = "struct<head: string, whole: boolean, regex: string, named: array<string>, base: bigint, fixed: bigint>"
_NONE = "array<string>"


def glob_parts(glob: str) -> dict:
    """head: what any match begins with. whole: it is all that matters. fixed: the rank, if it is the same for all paths
    that match; else base, and the depth of the last of the named segments times a million."""
    named, literal = concrete_segments(glob), len(glob.replace("*", ""))
    head = re.match(r"[^*?{}\[\]\\]*", glob)[0]
    base = len(named) * 10_000 + literal
    leading = glob.split("/")[: len(named)] == named
    fixed = literal if not named else len(named) * 1_000_000 + base if leading else None
    return {"head": head, "whole": head.endswith("/") and glob == f"{head}**" and head != "/", "regex": glob_to_regex(glob), "named": named, "base": base, "fixed": fixed}


def _parts(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda globs: [glob_parts(g) for g in globs])


def _any_of(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda globs: "|".join(glob_to_regex(g) for g in globs) if len(globs) else None)


def _inferred(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda globs: list(folders_of(globs)))


@dataclass(frozen=True)
class Contracts:
    """layers: one row a contract. denials: one row for each pair of layers that a rule of a contract may deny."""

    layers: DataFrame
    denials: DataFrame


def compiled(layers: DataFrame, rules: DataFrame) -> Contracts:
    """Nulls in arrays of globs count as empty arrays; a layer without globs matches nothing; rules that allow are left out, as are
    rules of a layer to itself that aren't peer rules."""
    ship_package(layers.sparkSession)
    keys = scope(layers)
    or_none = lambda c: F.coalesce(c, F.array().cast(_NONE))
    of_globs = lambda f, kind, c: F.pandas_udf(f, kind)(or_none(c))  # noqa: E731  made here, as workers without a session read this module too
    made = cut(layers.select(*keys, "ordinal", "layer", of_globs(_parts, f"array<{_GLOB}>", "patterns").alias("globs"), of_globs(_any_of, "string", "exclude").alias("excluded"), of_globs(_inferred, _NONE, "patterns").alias("folders")))
    packed = made.groupBy(*keys).agg(F.collect_list(F.struct((-F.col("ordinal")).alias("back"), "layer", "globs", "excluded")).alias("_layers"))
    # A peer rule without folders of its own takes those that its layer's globs name.
    first = made.groupBy(*keys, F.col("layer").alias("source")).agg(F.min_by("folders", "ordinal").alias("inferred"))
    denying = rules.where(~F.col("allowed") & (F.col("peer_isolation") | (F.col("source") != F.col("target")))).join(first, [*shared(rules, first), "source"], "left")
    own = F.when(F.size(or_none("slice_folders")) > 0, F.col("slice_folders")).otherwise(or_none("inferred"))
    rule = F.struct("ordinal", F.col("peer_isolation").alias("peer"), F.transform(own, F.lower).alias("folders"), F.coalesce("message", F.lit("")).alias("message"))
    denials = denying.groupBy(*scope(rules), F.col("source").alias("from_layer"), F.col("target").alias("to_layer")).agg(F.array_sort(F.collect_list(rule)).alias("_rules"))
    return Contracts(cut(packed), cut(denials))


def _rank(path: Column, glob: Column) -> Column:
    """The glob's rank if it matches the path, else null."""
    own = segments(path)

    def onward(at: Column, name: Column) -> Column:
        next_ = F.array_position(F.slice(own, (at + 1).cast("int"), F.greatest(F.size(own), F.lit(1))), name)
        return F.when(at.isNull() | (next_ == 0), F.lit(None)).otherwise(at + next_)

    walked = F.coalesce(F.aggregate(glob["named"], F.lit(0).cast("long"), onward) * 1_000_000, F.lit(0).cast("long")) + glob["base"]
    hit = F.when(~F.startswith(path, glob["head"]), False).when(glob["whole"], True).otherwise(F.rlike(path, glob["regex"]))
    return F.when(hit, F.coalesce(glob["fixed"], walked))


def _ranked(path: Column) -> Column:
    """array<struct<score, back, layer>> of the contract's layers that match; the best glob of each."""

    def scored(layer: Column) -> Column:
        best = F.array_max(F.transform(layer["globs"], lambda g: _rank(path, g)))
        out = F.coalesce(F.rlike(path, layer["excluded"]), F.lit(False))
        return F.struct(F.when(~out, best).alias("score"), layer["back"].alias("back"), layer["layer"].alias("layer"))

    return F.filter(F.transform("_layers", scored), lambda x: x["score"].isNotNull())


def classify_fleet(files: DataFrame, contracts: Contracts) -> DataFrame:
    """files (repo, ..., path) with layer, by the contract of each repository; null where none matches or there is no contract."""
    on = shared(files, contracts.layers)
    joined = files.drop("layer").join(sized(contracts.layers, SMALL), on, "left")
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    return joined.withColumn("layer", F.array_max(_ranked(path))["layer"]).drop("_layers")


def fleet_memberships(files: DataFrame, contracts: Contracts) -> DataFrame:
    """(repo, path, layer, score) of all layers that match."""
    on = shared(files, contracts.layers)
    joined = files.select(*scope(files), "path").join(sized(contracts.layers, SMALL), on)
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    return joined.select(*scope(files), "path", F.explode(_ranked(path)).alias("m")).select(*scope(files), "path", "m.layer", "m.score")


def _slice(path: Column, folders: Column) -> Column:
    parts = F.transform(segments(path), F.lower)
    pairs = F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    first = F.get(F.filter(pairs, lambda p: p["b"].isNotNull() & F.array_contains(folders, p["a"])), F.lit(0))
    return F.concat(first["a"], F.lit("/"), first["b"])


def fleet_violations(edges: DataFrame, contracts: Contracts) -> DataFrame:
    """Violations of each repository's own rules, as ``layers.layer_violations`` gives them for one contract.

    The first rule that denies counts; a peer rule denies unless both slices are known and the same.
    """
    on = shared(edges, contracts.denials)
    joined = edges.join(sized(contracts.denials, SMALL), [*on, "from_layer", "to_layer"])
    same = lambda r: F.coalesce(_slice(F.col("from_path"), r["folders"]) == _slice(F.col("to_path"), r["folders"]), F.lit(False))
    rule = F.get(F.filter("_rules", lambda r: ~r["peer"] | (F.size(r["folders"]) == 0) | ~same(r)), F.lit(0))
    denied = joined.withColumn("rule", rule).where("rule is not null")
    return denied.select(
        *scope(edges),
        F.lit("LAYER_IMPORT_VIOLATION").alias("rule_id"),
        F.col("from_path").alias("file"),
        "line",
        "from_layer",
        "to_layer",
        F.col("to_path").alias("target"),
        "type_only",
        (~F.col("type_only") | F.col("rule.peer")).alias("blocking"),
        F.col("rule.message").alias("message"),
    )
