"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame that
is written and read again as the docs of the next one. All but the last return the columns of
``docs``. Empty input gives empty output; null and empty texts pass the quality stage only where
there are no labels, and are never near-duplicates or contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthomark.llm import decontamination, minhash, packing, pii, quality
from orthomark.session import scratch_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier samples; those it rejects go."""
    return quality.keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of near-duplicates: similarity .8 or more."""
    return minhash.keep_one(docs, link=(80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars that of the new text."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else redacted


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Packing depends on a tokenizer and the stages on fitted models, which SQL cannot express.
ORACLE_SQL: str | None = None
