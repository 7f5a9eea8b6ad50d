"""A training corpus from raw documents: stages that each read what the stage before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smelter.llm import bpe, mixing, pii, simhash, toxicity
from smelter.session import shared_dir

RANKS_FILE = "byte_bpe_50k.tiktoken"


def without_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores at 0.5 or more go. It learns from the labels of the documents it is given."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose SimHash fingerprints (three-word shingles, three bits) link."""
    return simhash.drop_near_duplicates(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; every document stays."""
    return pii.redact(docs, pii.train(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids, intact): token ids of every text; ``intact`` if they decode to the text."""
    coder = bpe.ByteBpe(spark, public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN)
    rows = docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    coder.learn_frequent_words(rows.select(F.col("doc_id").alias("key"), "text"))
    # A text's digest goes with its codes, not the text: a batch of texts is held by the step that cuts them alone.
    coded = coder.encode(rows.withColumn("digest", F.sha2("text", 256)), "text", keep_text=False, stored=True)
    return coded.select("doc_id", "source", "lang", F.size("coded.ids").cast("long").alias("n_tokens"), "coded.ids",
                        (F.sha2("coded.decoded", 256) == F.col("digest")).alias("intact"))


STAGES = [("toxicity", without_toxic_documents), ("simhash near-dedup", without_near_duplicates),
          ("personal data", without_personal_data), ("source mix", mixed_sources), ("byte-level BPE", encoded)]

# Two stages rest on learned models and one on XXH64: SQL cannot express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{base}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
