"""From raw documents to packed sequences, in five stages over the whole table.

Each stage works on all that its predecessor kept; its result is written as
Parquet and read again as the next one's documents.  Further columns, whatever
their names, are kept up to the last stage.  Null and blank texts go at the
first stage; an empty table gives no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockline.llm import jaccard, language, packing, quality, secrets
from shockline.llm.shared import shared_dir
from shockline.llm.tokens import vocabulary


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that can be told: those without a letter, or nearest to two codewords, go."""
    return language.keep_told(docs, language.train(docs, held_out=None))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of 50 words and more whose words are mostly on content lines."""
    return quality.keep_quality(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by doc_id, of each group of near copies."""
    return jaccard.keep_first(docs, n=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; credentials that look live are replaced in their text, and n_chars follows."""
    found = secrets.redact(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return found


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The classifiers and the tokenizer can't be expressed in SQL; tests/llm/test_pipeline.py holds run() against plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
