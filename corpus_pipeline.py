"""Training-data pipeline over ``documents``: five stages, each writing Parquet that the next one reads.

Stages map (spark, docs, sf_dir) to a DataFrame; all but the last return the columns of documents.

1. quality rules with adaptive thresholds: rejected documents go.
2. line dedup: later copies of runs of two or more lines, and of single lines of 50 words or more, are deleted from
   texts; documents left without a line go.
3. near-dedup by operator 10 over five-word shingles: pairs of texts within three bits, from its fingerprints and its
   vantage-point tree, are confirmed by a Jaccard similarity of 0.8 or more; all other pairs of that similarity, which
   three bits don't reach, are found by an exact join over what the tree has not joined (``llm/shingle_join.py``). Of the
   rows that links join, that with the smallest doc_id, then MD5, stays, once; a row that shares its doc_id with another
   text is judged by its own. Rows without doc_id stay. Of the 417 pairs that the join alone
   confirms on 0.1 GB, 27 (0.06) are within three bits; all take 18. From 18,000 to 36,000 fingerprints, CPU seconds of
   the search grow by a power of 1.4 at three bits, 1.6 at five, 1.9 at eight and 2.0 at eleven.
4. benchmark decontamination: documents with a window of a benchmark item go.
5. mixing sources to target weights: the documents of the mix, with how often each is taken in ``copies``.

The hashes need XXH64, which DuckDB lacks, so there is no SQL for the whole; tests hold each stage against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.lineage import checkpoint_dir
from archweave.llm import decontaminate, line_dedup, mixing, quality, shingle_join


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and adaptive thresholds keep. Null and empty texts have no words and go; repeated rows are
    judged alike; an empty table stays empty; other columns are kept."""
    return quality.filter_documents(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines. Null and empty texts stay as they are; documents without doc_id
    come last in order; repeated rows are one document, treated alike; an empty table stays empty; other columns are kept."""
    return line_dedup.deduplicated_documents(docs, long_words=line_dedup.LONG_WORDS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: links of operator 10, confirmed, and the exact join's. Rows without doc_id stay; a null text is like no other but empty ones; of
    rows with the same doc_id and text one stays; an empty table stays empty; other columns are kept, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), shingle_join.tag().alias("_tag"), F.col("doc_id").cast("long").alias("_doc"))
    gone = shingle_join.near_copies(docs).select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"))
    kept = rows.join(gone, ["_doc", "_tag"], "left_anti")
    own = lambda df: df.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    # Of rows that share a doc_id and a text, one stays.
    repeated = rows.where("_doc is not null").groupBy("_doc", "_tag").agg(F.count("*").alias("n")).where("n > 1").select("_doc", "_tag")
    if repeated.isEmpty():
        return own(kept)
    once = W.partitionBy("_doc", "_tag").orderBy(F.lit(0))
    again = kept.join(repeated, ["_doc", "_tag"], "left_semi").withColumn("_nth", F.row_number().over(once)).where("_nth = 1")
    return own(kept.join(repeated, ["_doc", "_tag"], "left_anti")).union(own(again))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null and wordless texts are clean; repeated rows are
    judged alike; an empty table, or an empty benchmark, changes nothing; other columns are kept."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, with ``copies``. Null texts have no words and are never taken; a null source is one of its own; repeated rows
    share a hash and are taken alike; an empty table stays empty; a column ``copies`` of the documents is replaced."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written to the checkpoint folder and reread."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
