"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.lineage import cut

#: Edges, 16 bytes each for longs, up to which a round is one partition: dealt over all of a session's partitions, nearly
#: every task would be empty, and each of them leaves shuffle files and events.
FEW = 1 << 16


def _least(pairs: DataFrame) -> DataFrame:
    """Each node's least neighbour or itself; min is combined before the shuffle, so hubs cost one row a task."""
    return pairs.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _with_least(pairs: DataFrame, n: int) -> DataFrame:
    """``pairs`` with m, the least of u and its neighbours. A join of two single partitions would be dealt again, a window isn't."""
    if n <= FEW:
        return pairs.withColumn("m", F.least(F.min("v").over(W.partitionBy("u")), "u"))
    return pairs.join(_least(pairs), F.col("u") == F.col("node"))


def _together(df: DataFrame, n: int) -> DataFrame:
    """In one partition, which needs no exchange, if it is made of n <= FEW edges."""
    return df.coalesce(1) if n <= FEW else df


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), of one type and without nulls, in any direction -> (node, root) for every node of an edge.

    root is the least node of the component. Each round points neighbours at smaller nodes; rounds grow with the
    logarithm of the longest path. Rounds are written to the checkpoint folder. Self-loops are nodes of their own. A round
    over more than ``FEW`` edges is dealt by node, one over fewer runs in one task; the steps are the same.
    """
    stars = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
        stars = _together(stars, now["n"])
        both = _together(stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))), now["n"])
        large = _with_least(both, now["n"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        loops = stars.where(F.col("u") == F.col("v"))
        large = _together(large.union(loops), now["n"]).distinct()
        small = _with_least(large, now["n"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        stars = cut(_together(small.union(loops), now["n"]).distinct())
    own = stars.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return _together(stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own), now["n"]).groupBy("node").agg(F.min("root").alias("root"))
