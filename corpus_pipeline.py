"""The corpus pipeline: quality rules, quality classifier, near duplicates, personal data,
packing. Every stage gets all that the one before it kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelwise.llm import near_copies, packing, perplexity, pii, quality_model
from parcelwise.session import new_path


def _kept(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id the judged rows (doc_id) hold; null ids match null."""
    name = f"kept_{uuid.uuid4().hex}"  # no column of docs is called so
    ids = judged.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band."""
    return _kept(docs, perplexity.judge(docs).where("kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score at or above the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _kept(docs, quality_model.score_documents(docs, labels).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return _kept(docs, near_copies.near_copies(docs).where("doc_id <=> component_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The model stages can't be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
