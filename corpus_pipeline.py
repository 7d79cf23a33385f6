"""A training-data pipeline over ``documents``: toxicity, near duplicates, benchmark leaks, secrets, packing.

Each stage reads all rows that the stage before it wrote. Toxic documents, later members of a group of near duplicates
(five words, similarity 0.8) and documents that hold a benchmark item go; secrets are replaced by their kind; what is
left is packed into windows of tokens.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.llm import decontamination, neardup, packing, secrets, toxicity
from gapscope.llm.common import prepare, table
from gapscope.session import shared_dir


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the model learns from the labelled ones among them."""
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    prepare(spark)
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def scrub_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind and ``n_chars`` counted again."""
    prepare(spark)
    scrubbed = secrets.redact_secrets(docs)
    return scrubbed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else scrubbed


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("toxicity", clean_toxicity), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate),
          ("secrets", scrub_secrets), ("packing", pack_windows)]
#: Learned models and tokens cannot be said in SQL; the tests hold near duplicates, secrets and packing against
#: brute force here, decontamination only in its operator's tests, toxicity only against its operator's own score.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole ``documents`` table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/corpus-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
