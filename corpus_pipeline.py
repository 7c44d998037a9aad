"""Documents to token ids: toxicity, near duplicates, benchmark leaks, mixing by source, token store.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's documents. All but the last keep the columns of documents.

Null and empty texts are not toxic, are near duplicates of each other, hold no benchmark item and take no part in
the mix, which gives words only; so the store has none. Null ids, languages and sources are values like others.
Repeated rows are judged alike by toxicity and leaks; near-duplicate removal keeps one of them.
Texts of any length are read whole. Further columns stay as they are until the last stage. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessarine.llm import decontaminate, mixing, queries, simhash, token_store, toxicity
from tessarine.llm.common import documents, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labelled rows among ``docs``. Without any it rejects none."""
    return toxicity.without_toxic(docs, queries.toxicity_model(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component: that of the smallest doc_id, null ids last; of rows alike in id and text one, by a hash of all columns."""
    return simhash.simhash_dedup(docs, width=3, radius=2)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks. Without benchmark items all stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for every pass over a document, with the text that it takes. Documents without words, and those of which nothing is taken, go."""
    return mixing.mixed_documents(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every row's ids, read back from the token store; rows of one id stand next to each other, null ids first."""
    path = token_store.write_store(docs, queries.tokenizer_file(), queries.END_ID)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
    ("token_store", store_tokens),
]

#: Learning, hashing of words and tokenizing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs
