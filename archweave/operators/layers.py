"""Files to layers, edges to denied edges. Map-only, but for the join of edges to files.

Tables are keyed by repo, and by snapshot where they have one (see ``keys``). One contract a call; ``fleet`` takes a contract
for each repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.contract import Contract
from archweave.functions.paths import glob_to_regex, matches, parent, slice_id, specificity
from archweave.keys import scope, shared


def _scores(path: Column, contract: Contract, excludes: bool = True) -> Column:
    """array<struct<layer, score, ordinal>> of the layers whose globs match; the best glob of each."""
    found = []
    for ordinal, layer in enumerate(contract.layers):
        hit = [F.when(matches(path, p), specificity(path, p)) for p in layer.patterns]
        if not hit:
            continue
        score = F.greatest(*hit) if len(hit) > 1 else hit[0]
        if excludes and layer.exclude:
            out = path.rlike("|".join(glob_to_regex(p) for p in layer.exclude))
            score = F.when(~out, score)
        found.append(F.when(score.isNotNull(), F.struct(score.cast("long").alias("score"), F.lit(-ordinal).alias("back"), F.lit(layer.name).alias("layer"))))
    return F.array_compact(F.array(*found))


def layer_of(path: Column, contract: Contract) -> Column:
    """The layer of highest specificity; of equals the one declared first."""
    return F.array_max(_scores(path, contract))["layer"]


def classify_layers(files: DataFrame, contract: Contract) -> DataFrame:
    """files (..., path) -> with layer, null where none matches."""
    return files.withColumn("layer", layer_of(F.col("path"), contract))


def layer_memberships(files: DataFrame, contract: Contract) -> DataFrame:
    """(repo, path, layer, score) of all layers that match."""
    return files.select(*scope(files), "path", F.explode(_scores(F.col("path"), contract)).alias("m")).select(*scope(files), "path", "m.layer", "m.score")


def ambiguous_layers(files: DataFrame, contract: Contract) -> DataFrame:
    """(repo, layers, n_files): layers that share a file's highest score; excludes don't count here."""
    found = files.select(*scope(files), "path", _scores(F.col("path"), contract, excludes=False).alias("m"))
    best = found.withColumn("top", F.array_max("m")["score"])
    tied = best.select(*scope(files), F.transform(F.filter("m", lambda x: x["score"] == F.col("top")), lambda x: x["layer"]).alias("tied")).where(F.size("tied") > 1)
    return tied.groupBy(*scope(files), F.array_join(F.array_sort("tied"), ",").alias("layers")).agg(F.count("*").alias("n_files"))


def build_edges(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """Dependencies with from_layer and to_layer. files: (repo, path, layer), one row a path of each snapshot.

    Both joins are on the keys and a path: the edges shuffle twice, with AQE to split hub files and giant repos.
    """
    on = shared(dependencies, files)
    source = files.select(*on, F.col("path").alias("from_path"), F.col("layer").alias("from_layer"))
    target = files.select(*on, F.col("path").alias("to_path"), F.col("layer").alias("to_layer"))
    return dependencies.join(source, [*on, "from_path"], "left").join(target, [*on, "to_path"], "left")


def folders_of(globs) -> tuple[str, ...]:
    """Folders that globs name right before a wildcard segment: where slices lie."""
    found: dict[str, None] = {}
    for glob in globs:
        parts = [p for p in glob.split("/") if p]
        for before, part in zip(parts, parts[1:], strict=False):
            if part in ("*", "**") and not set(before) & set("*{}"):
                found[before] = None
    return tuple(found)


def inferred_folders(contract: Contract, name: str) -> tuple[str, ...]:
    """Those of a layer's globs."""
    return folders_of(next((x.patterns for x in contract.layers if x.name == name), ()))


def _first_rule(contract: Contract, source: Column, target: Column, peer_denies) -> Column:
    """The first rule that denies, as struct<ordinal, message, peer>; null if none does."""
    out = F.when(F.lit(False), F.struct(F.lit(0).alias("ordinal"), F.lit("").alias("message"), F.lit(False).alias("peer")))
    for i, r in enumerate(contract.rules):
        if r.allowed or (r.source == r.target and not r.peer_isolation):
            continue
        denies = (source == r.source) & (target == r.target)
        if r.peer_isolation:
            denies &= peer_denies(r)
        out = out.when(denies, F.struct(F.lit(i).alias("ordinal"), F.lit(r.message).alias("message"), F.lit(r.peer_isolation).alias("peer")))
    return out


def denying_rule(contract: Contract) -> Column:
    """Over edges. A peer rule denies unless both slices are known and the same; without folders of its own it takes those of the layer's globs."""

    def peers(r) -> Column:
        folders = r.slice_folders or inferred_folders(contract, r.source)
        if not folders:
            return F.lit(True)
        return ~F.coalesce(slice_id(F.col("from_path"), folders) == slice_id(F.col("to_path"), folders), F.lit(False))

    return _first_rule(contract, F.col("from_layer"), F.col("to_layer"), peers)


def denied_by_layers(contract: Contract, source: Column, target: Column) -> Column:
    """Where there are no paths: peer rules deny."""
    return _first_rule(contract, source, target, lambda r: F.lit(True))


def layer_violations(edges: DataFrame, contract: Contract) -> DataFrame:
    """Violations of layer rules; a type-only edge doesn't block, unless a peer rule denies it."""
    denied = edges.withColumn("rule", denying_rule(contract)).where("rule is not null")
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


def coverage(classified: DataFrame, contract: Contract) -> DataFrame:
    """(repo, layer, n_files, total, percent): every declared layer of every repo, also with 0 files."""
    keys = scope(classified)
    counts = classified.groupBy(*keys).agg(F.count("*").alias("total"), F.count("layer").alias("classified"), *[F.count_if(F.col("layer") == x.name).alias(f"n_{i}") for i, x in enumerate(contract.layers)])
    each = F.explode(F.array(*[F.struct(F.lit(x.name).alias("layer"), F.col(f"n_{i}").alias("n_files")) for i, x in enumerate(contract.layers)]))
    percent = F.when(F.col("total") == 0, 0).otherwise(F.floor(100 * F.col("classified") / F.col("total") + 0.5)).cast("long")
    return counts.select(*keys, each.alias("e"), "total", percent.alias("percent")).select(*keys, "e.layer", "e.n_files", "total", "percent")


def unclassified_dirs(classified: DataFrame) -> DataFrame:
    return classified.where("layer is null").groupBy(*scope(classified), parent(F.col("path")).alias("dir")).agg(F.count("*").alias("n_files"))


def layers_without_rules(contract: Contract, repos: DataFrame) -> DataFrame:
    named = {x for r in contract.rules for x in (r.source, r.target)}
    lone = [x.name for x in contract.layers if x.name not in named]
    return repos.select("repo", F.explode(F.array(*map(F.lit, lone)) if lone else F.array().cast("array<string>")).alias("layer"))


def violation_breakdown(violations: DataFrame, most: int = 4) -> DataFrame:
    """Per repo and edge of layers: counts, share, the ``most`` commonest target subtrees; concentrated at 10 and 0.9."""
    subtree = F.array_join(F.slice(F.split(F.regexp_replace("target", r"/[^/]*$", ""), "/"), 1, 3), "/")
    keys = [*scope(violations), "from_layer", "to_layer"]
    fine = violations.groupBy(*keys, subtree.alias("subtree")).agg(F.count("*").alias("n"), F.count_if("type_only").alias("n_type_only"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "subtree"))
    top = fine.withColumn("k", rank).groupBy(*keys).agg(
        F.sum("n").alias("n_violations"),
        F.sum("n_type_only").alias("n_type_only"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "subtree")))), lambda x: x["subtree"]), ",").alias("subtrees"),
    )
    total = F.sum("n_violations").over(W.partitionBy(*scope(violations)))
    share = F.col("n_violations") / total
    return top.select("*", F.round(share, 6).alias("share"), ((total >= 10) & (share >= 0.9)).alias("concentrated"))


def verdict(repos: DataFrame, violations: DataFrame) -> DataFrame:
    """Per row of repos (repo, and snapshot where violations have one), also clean ones: blocking and other violations, valid (none blocks), strict (none at all)."""
    keys = shared(repos, violations)
    counts = violations.groupBy(*keys).agg(F.count_if("blocking").alias("n_blocking"), F.count_if(~F.col("blocking")).alias("n_warnings"))
    found = repos.join(counts, keys, "left").fillna(0, ["n_blocking", "n_warnings"])
    return found.select(*keys, "n_blocking", "n_warnings", (F.col("n_blocking") == 0).alias("valid"), (F.col("n_blocking") + F.col("n_warnings") == 0).alias("strict_valid"))
