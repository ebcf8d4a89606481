"""Mixing sources to target weights by hash-threshold histograms.

Targets: sources in order of code point, null last, have weights 5, 2, 1, repeating, and share ``share`` times all
words; a source's target stops at ``most`` times its words, and the excess is shared again by weight among the rest
until none is above.

Taking: a source's documents are taken floor(target / size) times whole, and the rest of the target is met by a
threshold on a hash of each document. To find it without sorting, words are summed by source and by the hash's next
``BITS`` bits; the bucket in which the running sum crosses the budget is the only one whose documents are looked at
again, by further bits, until it holds one hash. That document is taken if this comes nearer to the budget. Thresholds
are nested: a smaller budget takes a subset.

Hashes are of doc_id and text, so reruns agree and only identical rows share one; those are taken alike.

Defined results: a null text has size 0; null is a source of its own; a source without words has target 0; repeated
rows are documents of their own; other columns are kept by ``mixed_documents``, but for one named ``copies``, in any
case, which the mix's own replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.keys import sized
from archweave.lineage import cut

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Bits of the hash that one pass looks at, and all of them (15 hex digits).
BITS, ALL_BITS = 12, 60
#: Sources whose thresholds are broadcast.
SOURCES = 100_000
SPACE = " \t\n\x0b\f\r"


def size_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    trimmed = F.trim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size), one row a source -> with target. Water-filling as one pass over sorted caps.

    At water level x a source gets min(most * size, weight * x). Sorted by cap / weight, the first k are capped; x for
    each k follows from running sums, and the right k is the first at which the next cap is not below the level. One
    row a source goes through one task; sources are names, not documents.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    rows = sizes.select("source", "source_size", F.get(weights, (F.row_number().over(by_name) - 1) % len(WEIGHTS)).alias("weight"))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto = by_cap.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    rows = rows.withColumns({"capped": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)), "spent": F.coalesce(F.sum("weight").over(upto), F.lit(0.0)), "budget": share * F.sum("source_size").over(every), "total": F.sum("weight").over(every)})
    # If all before this source are capped and it isn't: the level.
    rows = rows.withColumn("level", (F.col("budget") - F.col("capped")) / (F.col("total") - F.col("spent")))
    rows = rows.withColumn("fits", F.col("weight") * F.col("level") <= F.col("cap"))
    rows = rows.withColumn("x", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("x"), F.col("cap"))).alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """sized (source, h, size), wanted (source, source_size, target) -> with whole, below.

    Each document is taken ``whole`` times, and once more if h < below.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = wanted.select("source", "source_size", "target", whole.cast("long").alias("whole"))
    state = state.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    # The open range of each source starts at low; its running sum so far is what was taken off `left`.
    state = cut(state.withColumns({"low": F.lit(0).cast("long")}))
    for done in range(0, ALL_BITS, BITS):
        rest = ALL_BITS - done - BITS
        width = 1 << (rest + BITS)
        edges = state.select(F.col("source").alias("s"), F.col("low").alias("l"))
        inside = sized.join(edges, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") >= F.col("l")) & (F.col("h") < F.col("l") + width)) if done else sized
        sums = inside.groupBy("source", F.shiftright("h", rest).alias("b")).agg(F.sum("size").alias("own"))
        # At most 4096 buckets a source.
        sums = sums.withColumn("upto", F.sum("own").over(W.partitionBy("source").orderBy("b"))).withColumnRenamed("source", "s")
        crossed = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        over = F.col("upto") > F.col("left")
        first = F.min(F.when(over, F.struct("b", "upto", "own")))
        state = crossed.groupBy("source", "source_size", "target", "whole", "left", "low").agg(first.alias("x"), F.max("b").alias("top"))
        # Where nothing crosses, all of the range fits, and so does what is below its end.
        state = state.select("source", "source_size", "target", "whole", (F.col("left") - F.coalesce(F.col("x.upto") - F.col("x.own"), F.lit(0))).alias("left"), F.coalesce(F.shiftleft("x.b", rest), F.lit(1 << ALL_BITS)).alias("low"), F.col("x.own").alias("words"))
        state = cut(state)
    # low is now one hash, of `words` words: in if that is nearer.
    take = F.coalesce(2 * F.col("left") >= F.col("words"), F.lit(False))
    return state.select("source", "source_size", "target", "whole", F.when(take, F.col("low") + 1).otherwise(F.col("low")).alias("below"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("doc"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))


def _taken(rows: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.withColumnRenamed("source", "of")
    copies = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return rows.join(limits, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies)


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken (size times copies)."""
    sized = cut(_sized(docs).select(F.col("doc.doc_id").alias("doc_id"), "source", "size", "h"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    limits = thresholds(sized, targets(sizes, share, most))
    return _taken(sized, limits).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: the rows of ``docs`` that are taken, each with ``copies``. Texts are not shuffled while there are up to ``SOURCES`` sources."""
    measured = cut(_sized(docs).select("source", "size", "h"))
    limits = thresholds(measured, targets(measured.groupBy("source").agg(F.sum("size").alias("source_size")), share, most))
    return _taken(_sized(docs), sized(limits, SOURCES)).where("copies > 0").select(*[F.col("doc")[c].alias(c) for c in docs.columns if c.lower() != "copies"], F.col("copies").cast("long").alias("copies"))
