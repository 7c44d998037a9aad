"""The corpus operators applied to their whole tables, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_dedup, lm_score, mixing, passages, quality, simhash, token_store, toxicity
from .common import documents, fold

#: Id that ends a document in the token store.
END_ID = 1


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that leaks into it, with the best passage."""
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_key")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the sources to weights 1, 2, 3, repeating, takes of every document."""
    return mixing.mix(documents(spark, sf_dir))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """The model that learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.fit(docs, labels, held_out=toxicity.held_out_fold(F.col("doc_id")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = documents(spark, sf_dir)
    found = toxicity.scored(docs, toxicity_model(spark, docs, sf_dir))
    return found.select("doc_id", toxicity.held_out_fold(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares a passage of 50 words or more with another, with its class."""
    return passages.repeated(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_components(documents(spark, sf_dir), width=3, radius=2)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from a store written with its ids."""
    path = token_store.write_store(documents(spark, sf_dir), tokenizer_file(), END_ID)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a model of the documents outside the held-out fold."""
    return lm_score.scored(documents(spark, sf_dir), fold(F.col("doc_id")) == 1)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return license_scan.scanned(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those removed as boilerplate, and length and checksum of what is left."""
    found = line_dedup.without_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("clean_chars"), F.md5("text").alias("clean_md5"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op4_passages": op4_passages, "op6_lm_score": op6_lm_score, "op7_license_scan": op7_license_scan, "op8_line_dedup": op8_line_dedup, "op10_quality": op10_quality, "op2_mix": op2_mix, "op3_toxicity": op3_toxicity, "op1_decontaminate": op1_decontaminate, "op5_simhash": op5_simhash, "op9_token_store": op9_token_store}
ORACLES: dict[str, str] = {"op2_mix": mixing.oracle_sql(), "op8_line_dedup": line_dedup.oracle_sql(), "op10_quality": quality.oracle_sql()}
