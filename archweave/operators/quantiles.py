"""Values at a rank, without sorting rows: counts of distinct values, and running counts over ranges of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_RANGES = 1024


def value_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., value, n, upto, total): how often each value occurs, and how many rows have it or a smaller one.

    Rows are combined to distinct values before the shuffle. Running sums go over ranges of values first and then inside
    each range, so that no task holds all values of a key. Nulls don't count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    edge = counts.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum("n").alias("total"))
    placed = counts.join(edge, keys)
    width = F.greatest((F.col("_high") - F.col("_low")).cast("double") / _RANGES, F.lit(1e-300))
    placed = placed.withColumn("_range", F.floor((F.col(value) - F.col("_low")) / width).cast("int"))
    ranges = placed.groupBy(*keys, "_range").agg(F.sum("n").alias("_own"))
    before = F.sum("_own").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("n").over(W.partitionBy(*keys, "_range").orderBy(value))
    return placed.withColumn("_inside", inside).join(ranges, [*keys, "_range"]).select(*keys, value, "n", (F.col("_before") + F.col("_inside")).alias("upto"), "total")


def at_rank(value: str, rank: Column) -> Column:
    """Aggregate over ``value_counts``: the value that stands at that rank, null beyond the last."""
    return F.min(F.when(F.col("upto") >= rank, F.col(value)))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., median): of an even number the mean of the middle two."""
    low, high = F.ceil(F.col("total") / 2), F.floor(F.col("total") / 2) + 1
    return value_counts(rows, keys, value).groupBy(*keys).agg(((at_rank(value, low) + at_rank(value, high)) / 2).alias("median"))
