"""A training-data pipeline over `documents`: quality, near-duplicates, benchmark passages, secrets, packing.

Stages decide by texts (and languages and sources), never by ids: null, repeated and missing texts, equal ids, repeated rows, empty tables and further
columns have the results that the operators' docstrings state. A null or empty text fails the base rule of the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import decontaminate, packing, quality, secrets, simhash
from threadlens.llm.shared import remove_folder, remove_tables, shared_folder, tables_so_far


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and the weak candidates linked with others are masked; all documents stay."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The near-duplicate and packing stages have no SQL form; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path, tables = f"{folder}/{number}-{name}", tables_so_far()
        stage(spark, docs, sf_dir).write.parquet(path)
        remove_tables(spark, tables)
        docs = spark.read.parquet(path)
        if before:  # a stage's rows are written: what it read is needed no more
            remove_folder(spark, before)
        before = path
    return docs
