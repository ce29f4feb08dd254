"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import oracles


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.lm_scoring import score

    return score(_documents(spark, sf_dir), order=3, folds=7, held_out_fold=2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.license_scan import license_digest, scan_licenses

    return license_digest(scan_licenses(_documents(spark, sf_dir)))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.sentence_pieces import round_trip

    return round_trip(_documents(spark, sf_dir), "piece_bpe_32k.model")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.token_counts import count_tokens

    return count_tokens(_documents(spark, sf_dir), "byte_bpe_50k.json").withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.packing import pack

    return pack(_documents(spark, sf_dir), window=2048, end_id=1, tokenizer="byte_bpe_50k.json", with_ids=False)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), shingle=4, radius=4)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.suffix_dedup import repeated_strings

    return repeated_strings(_documents(spark, sf_dir), length=50, with_text=False).drop("spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.quality_rules import quality

    return quality(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"
    )


def op9_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.debruijn_dedup import repeated_passages

    return repeated_passages(_documents(spark, sf_dir), window=35, with_text=False).drop("spans")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.embedding_dedup import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.toxicity import toxicity

    found = toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=4, held_out_fold=2, limit=0.3)
    worst = F.array_sort("offending", lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(F.signum(a["start"] - b["start"]).cast("int")))
    first = F.get(worst, 0)
    return found.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").cast("bigint").alias("n_offending"), first["start"].alias("worst_start"), first["length"].alias("worst_length"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.vector_codes import vector_codes

    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=4, entries=256, rounds=4, scale=1024)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.fill_in_middle import fill_in_middle, restored

    found = fill_in_middle(_documents(spark, sf_dir), seed=1)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_license_scan, op3_sentence_pieces, op4_token_counts, op5_packing, op6_simhash, op7_suffix_dedup, op8_quality_rules, op9_debruijn_dedup, op10_embedding_dedup, op11_toxicity, op12_vector_codes, op13_fill_in_middle)}
ORACLES = {"op8_quality_rules": oracles.QUALITY_RULES, "op12_vector_codes": oracles.vector_codes(), "op13_fill_in_middle": oracles.FILL_IN_MIDDLE}
