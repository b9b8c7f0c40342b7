"""The corpus pipeline: language ID, near-dedup, secret scans, source mixing, packing.

Each stage takes the documents that its predecessor kept, as a table of the same columns; the
last one returns the packed pieces of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxengine.llm import langid, mixing, packing, secrets, simhash
from ctxengine.llm.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 or more of their five-word shingles one stays."""
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows."""
    columns = docs.columns
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take their target weights; a document may come twice, or not at all."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every piece of a document and its place in a sequence."""
    return packing.report(docs)


STAGES = [("language_id", language_id), ("simhash_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix), ("pack_sequences", pack)]
#: SQL expresses neither the text model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
