"""Quality rules with adaptive thresholds, in DataFrame functions only.

Per document, from whole texts: words, their characters, symbols, repeated lines, repeated three-word windows. Fixed base
rules reject documents of fewer than 50 words, or with over half their words in repeated windows. All other cutoffs
come from the corpus: for each language and source a quantile sketch of each ratio is kept, over documents that pass
the base rules, and documents outside its far fences are rejected:

    [q25 - 3 * spread, q75 + 3 * spread],  spread = max(q75 - q25, the ratio's least spread)

The sketch is a log-linear histogram of integers: values below 64 exactly, above with 32 buckets to each doubling (a
relative error of 1/32 at most). It is a plain table (lang, source, metric, bucket, n), so sketches merge by adding
counts: a source with fewer than ``MIN_GROUP`` documents uses its language's merged sketch, a small language that of
all. Counting is combined before the shuffle, so a hot source costs a few rows a task.

Three-word windows are compared by their 64-bit hashes within a document.

Defined results: a null text has no words; null languages and sources are groups of their own; repeated rows each give
a row and count each; other columns are kept by ``filter_documents`` and ignored by ``quality_report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archweave.keys import sized
from archweave.lineage import cut

#: ASCII white space, as characters and as a pattern.
SPACE, SPACE_RE = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"
SYMBOLS_RE = "[#*$%&|<>]"
MIN_WORDS, MOST_REPEATED = 50, 50
MIN_GROUP, FENCE = 100, 3
#: Groups of language and source whose limits are broadcast.
GROUPS = 100_000
#: Ratios as integers (numerator times scale, by denominator), the least spread that counts, and whether low is bad too.
METRICS = {
    "word_length": ("word_chars", 100, "n_words", 50, True),
    "symbols": ("n_symbols", 10_000, "n_words", 500, False),
    "dup_lines": ("n_dup_lines", 10_000, "n_lines", 1_200, False),
    "repeats": ("n_repeat_words", 10_000, "n_words", 1_000, False),
}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of FEATURES, n_lines and base_failed put beside a struct column ``doc`` of all it had."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), text.alias("t"))
    trimmed = F.trim(F.col("t"), F.lit(SPACE))
    rows = rows.select(
        "doc",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE)).alias("w"),
        F.filter(F.split("t", "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "").alias("lines"),
        F.regexp_count("t", F.lit(SYMBOLS_RE)).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "doc",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("runs"),
    )
    # Windows in order of hash, then place; those that equal a neighbour occur twice or more. Each array is a column of
    # its own before a lambda indexes it, so that no element makes it anew.
    rows = rows.withColumn("several", F.size("runs") > F.size(F.array_distinct("runs")))
    rows = rows.withColumn("ordered", F.when(F.col("several"), F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumns({"hashes": F.transform("ordered", lambda x: x["h"]), "at": F.transform("ordered", lambda x: x["i"])})
    equal = lambda a, b: F.coalesce(F.get("hashes", a) == F.get("hashes", b), F.lit(False))
    rows = rows.withColumn("places", F.sort_array(F.filter(F.transform("at", lambda p, j: F.when(equal(j, j - 1) | equal(j, j + 1), p)), F.isnotnull)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("places", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.select("doc", *FEATURES, "n_lines", failed.alias("base_failed"))


def _ratio(metric: str) -> Column:
    numerator, scale, denominator, _, _ = METRICS[metric]
    return F.floor(F.col(numerator) * scale / F.greatest(F.col(denominator), F.lit(1))).cast("long")


def bucket(value: Column) -> Column:
    exponent = F.length(F.bin(value)).cast("long") - 6
    mantissa = F.floor(value / F.pow(F.lit(2), exponent)).cast("long")
    return F.when(value < 64, value).otherwise(exponent * 32 + mantissa)


def bucket_floor(number: Column) -> Column:
    """The least value of a bucket."""
    exponent = F.floor((number - 32) / 32)
    return F.when(number < 64, number).otherwise(((number - exponent * 32) * F.pow(F.lit(2), exponent)).cast("long"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) over documents that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(_ratio(m)).alias("bucket")) for m in METRICS]))
    # No filter below the aggregation: it would be pushed to the scan, and with it a second copy of all features.
    counted = measured.select("lang", "source", "base_failed", each.alias("s")).groupBy("lang", "source", "s.metric", "s.bucket")
    return counted.agg(F.count_if(~F.col("base_failed")).alias("n")).where("n > 0")


def _quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Quartiles of sketches, merged over all that isn't a key."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    # A sketch has some hundred buckets at most, whatever it has counted.
    points = merged.groupBy(*keys, "metric").agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"))

    def quantile(share: float) -> Column:
        rank = F.ceil(F.col("count") * share)
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
        walk = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["n"] >= rank, x["bucket"])).alias("at"))
        return bucket_floor(F.aggregate("b", start, walk, lambda a: a["at"]))

    return points.select(*keys, "metric", "count", quantile(0.25).alias("q25"), quantile(0.75).alias("q75"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, and for each metric its least and greatest allowed value); one row per language and source."""
    own = _quartiles(sketch, "lang", "source")
    lang = _quartiles(sketch, "lang").select(F.col("lang").alias("l"), F.col("metric").alias("lm"), *(F.col(c).alias(f"l_{c}") for c in ("count", "q25", "q75")))
    every = _quartiles(sketch).select(F.col("metric").alias("am"), *(F.col(c).alias(f"a_{c}") for c in ("q25", "q75")))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("lm"))).join(F.broadcast(every), F.col("metric") == F.col("am"))
    pick = lambda q: F.when(F.col("count") >= MIN_GROUP, F.col(q)).when(F.col("l_count") >= MIN_GROUP, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    joined = joined.select("lang", "source", "metric", pick("q25").alias("q25"), pick("q75").alias("q75"))
    spread = lambda m: F.greatest(F.col("q75") - F.col("q25"), F.lit(METRICS[m][3]))
    columns = []
    for m in METRICS:
        mine = F.col("metric") == m
        columns.append(F.max(F.when(mine, F.col("q75") + FENCE * spread(m))).alias(f"{m}_most"))
        columns.append(F.max(F.when(mine, F.col("q25") - FENCE * spread(m))).alias(f"{m}_least"))
    return joined.groupBy("lang", "source").agg(*columns)


def _kept(limits: DataFrame, measured: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: joined to its group's limits."""
    limits = limits.withColumnsRenamed({"lang": "limit_lang", "source": "limit_source"})
    # One expression over both sides of the join, so that no part of it is pushed below and computed twice.
    fails = F.when(F.col("base_failed"), True)
    for m, (_, _, _, _, low) in METRICS.items():
        fails = fails.when(_ratio(m) > F.col(f"{m}_most"), True)
        if low:
            fails = fails.when(_ratio(m) < F.col(f"{m}_least"), True)
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("limit_lang")) & F.col("source").eqNullSafe(F.col("limit_source")), "left")
    return joined.withColumn("kept", ~fails.otherwise(False))


def _measured(docs: DataFrame) -> DataFrame:
    return features(docs).withColumns({"lang": F.col("doc.lang").cast("string"), "source": F.col("doc.source").cast("string")})


def quality_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, source, the features, base_failed and kept."""
    measured = cut(_measured(docs).select(F.col("doc.doc_id").alias("doc_id"), "lang", "source", *FEATURES, "n_lines", "base_failed"))
    limits = thresholds(sketches(measured))
    return _kept(limits, measured).select("doc_id", "lang", "source", *FEATURES, "n_lines", "base_failed", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Features are computed twice, for the sketches and for the verdict, so that no text is shuffled or stored: the limits are
    broadcast up to ``GROUPS`` languages and sources. Beyond that, texts are shuffled by these.
    """
    limits = sized(cut(thresholds(sketches(_measured(docs)))), GROUPS)
    return _kept(limits, _measured(docs)).where("kept").select("doc.*")
