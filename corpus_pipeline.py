"""A corpus from raw documents to packed sequences, in five stages.

Each stage is (name, function) and each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents:

  quality_classifier  drops documents that the classifier scores below its threshold
  near_duplicates     keeps one document of each component of texts with a five-word shingle similarity of 0.8 or more
  secret_scan         replaces secrets in texts; keeps every document
  source_mixing       repeats or drops documents so that sources come near their target weights
  packing             one row for each piece of a document, with its token ids, sequence and offset

Defined results: a null text counts as empty, is scored like an empty one, is a copy of other texts without words, stays
null in the secret scan, has size 0 in the mix and is one end id in the packing; null doc_ids count as held out of
training and are kept (of a component with others, one that has an id is); rows that share their doc_id are documents of
their own; equal rows are one document after near_duplicates; an empty table passes through every stage as one; extra
columns, whatever their names, reach the packing stage unchanged, which returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import mil, mixing, packing, secrets, simhash_blocks
from lodestar.llm.common import stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mil.accepted(docs, mil.classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_blocks.representatives(docs, least=0.8, shingle=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redacted(docs, secrets.train(secrets.labelled_findings(spark)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_documents(docs, with_ids=True))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("packing", best_fit_packing),
]

#: SQL can't express the trained stages; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs, _ = stage(function(spark, docs, sf_dir), name)
    return docs
