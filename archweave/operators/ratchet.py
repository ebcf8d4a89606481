"""Occurrence keys, references that last, baselines and what is new against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.functions.names import baseline_key, stable_hash
from archweave.keys import scope
from archweave.operators.quantiles import at_rank, value_counts

_KEY = ["rule_id", "file", "from_layer", "to_layer", "target"]


def occurrence_keys(violations: DataFrame) -> DataFrame:
    """With key: repeats of one identity, in order of line, gain '#2', '#3', ..."""
    base = baseline_key(*map(F.col, _KEY))
    keyed = violations.withColumn("_base", base)
    nth = F.row_number().over(W.partitionBy(*scope(violations), "_base").orderBy("line"))
    return keyed.withColumn("_nth", nth).withColumn("key", F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("#"), "_nth"))).drop("_base", "_nth")


def finding_refs(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("ref", stable_hash(F.col("key")))


def ratchet(keyed: DataFrame, baseline: DataFrame) -> DataFrame:
    """(repo, key, state): suppressed (in the baseline), active (new) or stale (in the baseline only)."""
    now, then = keyed.select("repo", "key").distinct().withColumn("now", F.lit(True)), baseline.select("repo", "key").distinct().withColumn("then", F.lit(True))
    state = F.when(F.col("now").isNull(), "stale").when(F.col("then").isNull(), "active").otherwise("suppressed")
    return now.join(then, ["repo", "key"], "full").select("repo", "key", state.alias("state"))


def ratchet_against(keyed: DataFrame, base: DataFrame, changed: DataFrame) -> DataFrame:
    """Violations that the base branch's baseline lacks, in changed files only."""
    return keyed.join(base, ["repo", "key"], "left_anti").join(changed.select("repo", F.col("path").alias("file")).distinct(), ["repo", "file"], "left_semi")


def baseline_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, key, change): grow or shrink."""
    state = ratchet(new, old)
    return state.where("state <> 'suppressed'").select("repo", "key", F.when(F.col("state") == "active", "grow").otherwise("shrink").alias("change"))


def retain_last_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest n of each key."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def nearest_rank_percentile(rows: DataFrame, key: str, value: str, percents: list[int]) -> DataFrame:
    """The value of rank ceil(p / 100 * n), for each key and percent."""
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.col("total") * p / 100))
    return value_counts(rows.select(key, value), [key], value).groupBy(key).agg(*[at_rank(value, rank(p)).alias(f"p{p}") for p in percents], F.max("total").alias("n"))
