"""The corpus pipeline: documents go through STAGES in order; every stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.decontamination import decontaminated
from dossier.llm.near_dedup import first_of_each_class
from dossier.llm.packing import packing
from dossier.llm.scratch import bounded_batches, written
from dossier.llm.secret_scan import redacted
from dossier.llm.toxicity import not_toxic


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network predicts to be toxic go."""
    bounded_batches(spark)
    return not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays, one with the smallest doc_id."""
    bounded_batches(spark)
    return first_of_each_class(docs)


def benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bounded_batches(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays, with n_chars counted anew."""
    bounded_batches(spark)
    found = redacted(docs)
    return found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences that the remaining documents fill."""
    bounded_batches(spark)
    return packing(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_documents),
    ("secret_scan", secrets),
    ("packing", packed),
]
#: SQL can't express the networks, the Markov models and the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
