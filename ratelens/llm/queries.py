"""The registered queries of this package and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm import (centroids, decontamination, embedding_dedup, exact_dedup, importance, line_dedup, mixing,
                          ngram_jaccard, quality, secrets, substring_dedup, token_output, toxicity)
from ratelens.llm.common import read_table, scratch


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out_dir = scratch(spark, "tokens")
    token_output.write_tokens(read_table(spark, sf_dir, "documents"), out_dir,
                              public_tokenizers.path("word_bpe_49k.json"), by_word=True)
    return token_output.read_tokens(spark, out_dir)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("line_text", 256).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("token").alias("n_chars"), "score", "secret")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(read_table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_token_output": op4_token_output,
    "op5_mix_sources": op5_mix_sources,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_exact_dedup": op13_exact_dedup,
}

LLM_ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_jaccard.ORACLE_SQL,
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op6_embedding_near_dedup": embedding_dedup.ORACLE_SQL,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op11_importance_resampling": importance.ORACLE_SQL,
    "op12_centroid_clustering": centroids.ORACLE_SQL,
    "op13_exact_dedup": exact_dedup.ORACLE_SQL,
}
