"""From raw documents to an encoded corpus: four stages, each over all that the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, language_id, simhash
from ledgerloom.session import stage

# A byte costs eight bits: a text whose best language needs as many is in none of them.
MOST_BITS = 8.0
TOKENIZER = "byte_bpe_50k.tiktoken"


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that some language predicts; ``lang`` becomes the predicted one.

    The model is learned from the labelled rows of ``docs``. Rejected are null texts, texts
    without a letter, and texts that no language shortens.
    """
    model = language_id.train(docs)
    found = docs.select(F.struct("*").alias("row"), language_id.predicted(F.col("text"), spark, model).alias("found"))
    spoken = (F.col("found.lang_pred") != language_id.UNKNOWN) & (F.col("found.bits") < MOST_BITS)
    named = [F.col("found.lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns]
    return found.where(spoken).select(*named)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked fingerprints: exact copies and close ones."""
    return simhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its tokens and the text decoded from them.

    Columns of ``docs`` named n_tokens, token_ids or decoded_text are replaced.
    """
    code = bpe.coded(F.col("text"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    kept = [c for c in docs.columns if c not in ("n_tokens", "token_ids", "decoded_text")]
    return docs.select(F.struct(*kept).alias("row"), code.alias("code")).select(
        "row.*",
        F.col("code.n_tokens").alias("n_tokens"),
        F.col("code.ids").alias("token_ids"),
        F.decode("code.decoded", "UTF-8").alias("decoded_text"),
    )


STAGES = [
    ("language_id", languages),
    ("simhash", near_copies),
    ("decontaminate", decontaminated),
    ("bpe", encoded),
]
# Fingerprints, learned models and merges are no SQL; tests compare the stages with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
