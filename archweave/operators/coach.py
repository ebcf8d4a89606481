"""What to look at next: lenses over facts, candidates for deepening, the model that a tree resembles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.keys import sized

#: Rows of lenses or weights that are broadcast; larger tables are joined.
SMALL = 10_000
#: Parts in which a lens's evidence is ranked.
PARTS = 64


def compass(found: DataFrame, lenses: DataFrame, repos: DataFrame, most: int = 12) -> DataFrame:
    """(repo, lens, status, n, evidence): every lens of every repository, residual where a fact speaks for it, else clear.

    found (repo, source, id, evidence); lenses (source, id, lens, priority), a small table: which facts stand for which
    lens; as a whole it fits one row. n: how many distinct pieces of evidence; evidence: the first ``most``, joined.
    """
    each = lenses.groupBy("lens").agg(F.min("priority").alias("priority"))
    hits = found.join(sized(lenses.select("source", "id", "lens").distinct(), SMALL), ["source", "id"]).select("repo", "lens", "evidence").distinct()
    # Evidence of a lens is ranked in parts, so that no task has all of a large repository's; its first pieces are among the first of the parts.
    ranked = hits.withColumn("part", F.pmod(F.xxhash64("evidence"), F.lit(PARTS))).withColumn("k", F.row_number().over(W.partitionBy("repo", "lens", "part").orderBy("evidence")))
    parts = ranked.groupBy("repo", "lens", "part").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("k") <= most, F.col("evidence"))).alias("firsts"))
    firsts = F.slice(F.array_sort(F.flatten(F.collect_list("firsts"))), 1, most)
    told = parts.groupBy("repo", "lens").agg(F.sum("n").alias("n"), F.array_join(firsts, ",").alias("evidence"))
    # All lenses as one array, so that no join without keys is needed: a row a repository, exploded.
    listed = each.agg(F.collect_list(F.struct("lens", "priority")).alias("lenses")).withColumn("_", F.lit(1))
    every = repos.select("repo", F.lit(1).alias("_")).join(F.broadcast(listed), "_").select("repo", F.explode("lenses").alias("x")).select("repo", "x.*")
    joined = every.join(told, ["repo", "lens"], "left").fillna(0, ["n"])
    return joined.select("repo", "lens", "priority", F.when(F.col("n") > 0, "residual").otherwise("clear").alias("status"), "n", F.coalesce("evidence", F.lit("")).alias("evidence"))


def top_residual(lensed: DataFrame, most: int = 5) -> DataFrame:
    """(repo, lens, place): each repository's first residual lenses, by priority, then name."""
    place = F.row_number().over(W.partitionBy("repo").orderBy("priority", "lens")).cast("long")
    return lensed.where("status = 'residual'").select("repo", "lens", place.alias("place")).where(F.col("place") <= most)


def deepening_candidates(sources: list[DataFrame], most: int = 5) -> DataFrame:
    """(repo, place, target, friction): of several lists (repo, rank, target, friction), earlier lists first, the first ``most``.

    A (target, friction) that was there before, in any case, and blank ones don't count.
    """
    every = reduce(DataFrame.union, [s.select("repo", F.lit(i).alias("list"), "rank", F.trim("target").alias("target"), F.trim("friction").alias("friction")) for i, s in enumerate(sources)])
    fine = every.where("target <> '' and friction <> ''")
    order = ["list", "rank", "target", "friction"]
    again = F.row_number().over(W.partitionBy("repo", F.lower("target"), F.lower("friction")).orderBy(*order))
    place = F.row_number().over(W.partitionBy("repo").orderBy(*order)).cast("long")
    firsts = fine.withColumn("again", again).where("again = 1").withColumn("place", place)
    return firsts.where(F.col("place") <= most).select("repo", "place", "target", "friction")


def best_fit_model(files: DataFrame, presets: dict[str, list[str]]) -> DataFrame:
    """(repo, model, hits): the preset whose folder names most of the repository's folders have; of equals the first named."""
    pairs = F.array(*[F.struct(F.lit(s).alias("folder"), F.lit(m).alias("model"), F.lit(-i).alias("back")) for i, (m, own) in enumerate(presets.items()) for s in own])
    table = files.sparkSession.range(1).select(F.explode(pairs).alias("x")).select("x.*").distinct()
    folders = files.select("repo", F.explode(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)).alias("folder")).distinct()
    hits = folders.join(F.broadcast(table), "folder").groupBy("repo", "model", "back").agg(F.count("*").alias("hits"))
    return hits.groupBy("repo").agg(F.max_by("model", F.struct("hits", "back")).alias("model"), F.max("hits").alias("hits"))


def archetype_scores(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """signals (repo, signal, value), weights (signal, archetype, weight) -> (repo, archetype, score, place, margin).

    place: by score, then name; margin: how far the next one is behind, null for the last.
    """
    scored = signals.join(sized(weights, SMALL), "signal").groupBy("repo", "archetype").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    order = W.partitionBy("repo").orderBy(F.desc("score"), "archetype")
    return scored.select("repo", "archetype", "score", F.row_number().over(order).cast("long").alias("place"), (F.col("score") - F.lead("score").over(order)).alias("margin"))


#: What caps a recommendation's confidence, and from where on it needs to be confirmed.
_CLOSE, _THIN_FILES, _WHOLE = 2, 8, 90
_THIN_CAP, _UNSURE_CAP = 0.28, 0.49
_NONE_TINY, _NONE = 0.55, 0.35


def recommendations(scores: DataFrame, weights: DataFrame, trees: DataFrame, fallback: str) -> DataFrame:
    """(repo, archetype, runner_up, score, confidence, close, thin, low_coverage, to_confirm): one row for each tree.

    scores: of ``archetype_scores``; weights (signal, archetype, weight): the positive ones are what an archetype could
    have scored at most; trees (repo, n_sources, tiny, coverage), coverage in percent, nulls count as none. Confidence
    is seven tenths the share of that most, three tenths the margin; thin trees, close runners-up and low coverage cap
    it. Where no archetype scores above zero it is ``fallback``, whose runner-up is the second of the list, if another.
    """
    most = weights.groupBy("archetype").agg(F.sum(F.when(F.col("weight") > 0, F.col("weight"))).alias("most"))
    first = scores.where("place = 1").select("repo", "archetype", F.col("score").alias("first"))
    second = scores.where("place = 2").select("repo", F.col("archetype").alias("second_name"), F.col("score").alias("second"))
    rows = trees.join(first, "repo", "left").join(second, "repo", "left").join(sized(most, SMALL), "archetype", "left")
    tiny = F.coalesce("tiny", F.lit(False))
    found = F.coalesce(F.col("first") > 0, F.lit(False))
    close = found & F.coalesce(F.col("first") - F.col("second") <= _CLOSE, F.lit(False))
    thin = found & ((F.coalesce("n_sources", F.lit(0)) < _THIN_FILES) | tiny)
    low = F.coalesce("coverage", F.lit(0)) < _WHOLE
    margin = F.when(F.col("second") > 0, (F.col("first") - F.col("second")) / F.greatest(F.col("first"), F.lit(1))).otherwise(0.25)
    share = F.col("first") / F.when(F.col("most") > 0, F.col("most")).otherwise(1)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.1), share * 0.7 + margin * 0.3))
    capped = F.least(sure, F.when(thin, _THIN_CAP).otherwise(1.0), F.when(close | low, _UNSURE_CAP).otherwise(1.0))
    name = F.when(found, F.col("archetype")).otherwise(fallback)
    # Halves go up, as in scores elsewhere; doubles as they are, so that ties don't depend on decimals.
    confidence = F.when(found, F.floor(capped * 1000 + 0.5) / 1000).otherwise(F.when(tiny, _NONE_TINY).otherwise(_NONE))
    runner = F.when(F.col("second_name") != name, F.col("second_name"))
    flags = [close.alias("close"), thin.alias("thin"), low.alias("low_coverage"), (~found | close | thin | low).alias("to_confirm")]
    return rows.select("repo", name.alias("archetype"), runner.alias("runner_up"), F.coalesce("first", F.lit(0)).cast("long").alias("score"), confidence.cast("double").alias("confidence"), *flags)
