"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave.llm import decontaminate, grammar_runs, line_dedup, lm_scores, merkle, mixing, oracle, quality, quartile_digest, simhash, substring_dedup, suffix_dedup, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents")).select("doc_id", *quality.FEATURES, "base_failed", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return substring_dedup.remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", "n_intervals", "kept_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores.stupid_backoff(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_backoff", F.round("score", 4).alias("score"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.remove_repeated_runs(_table(spark, sf_dir, "documents"))
    return kept.select("doc.doc_id", "n_lines", "n_removed", "n_runs", "longest_match", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return suffix_dedup.remove_repeated_strings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(warc.records(_table(spark, sf_dir, "pages")))
    return warc.record_table(warc.read_warc(archives, payloads=False))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grammar_runs.find_runs(grammar_runs.with_planted_runs(_table(spark, sf_dir, "documents")))
    best = grammar_runs.longest(F.col("runs"))
    return found.select("doc_id", "runs", "collapsed_text", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(grammar_runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quartile_digest.edited_digests(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    given = [merkle.lower_cased(F.col(c)) if c == "text" else F.col(c) for c in fields]
    presented = F.when(tampered, merkle.leaf(given)).otherwise(merkle.leaf([F.col(c) for c in fields]))
    proofs = merkle.manifest(_table(spark, sf_dir, "documents"), fields, "lang", "doc_id", presented)
    root = merkle.folded(F.col("presented"), F.col("siblings"))
    kept = proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")).alias("proof_sha256"), root.alias("folded_root"))
    return kept.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_substring_dedup, op4_token_counts, op5_lm_scores, op6_line_dedup, op7_mixing, op8_suffix_dedup, op9_warc, op10_simhash, op11_periodic_runs, op12_fingerprints, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
