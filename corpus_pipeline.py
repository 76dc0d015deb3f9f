"""A corpus pipeline of five stages; each works on all that the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, minhash, mixing, sanitise, toxicity
from tickloom.llm.common import discard, named, numbered, stage

#: A document at or above this score is rejected.
REJECT = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not rejected as toxic; the classifier learns from the training fold of ``labels``."""
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return named(toxicity.score_toxicity(numbered(docs, "text"), model).where(F.col("toxicity") < REJECT), docs.columns, "text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest doc_id."""
    return minhash.near_duplicate_kept(docs)


def sanitise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced by marks."""
    return sanitise.sanitised(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (0, 1 or 2 times)."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("sanitise", sanitise_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]
#: Classifier, sampling and codec are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
