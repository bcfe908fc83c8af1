"""Corpus pipeline: stages that each apply one operator of ``veilspark.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns what it keeps with the
columns of ``docs``; its result is written as Parquet and reread as the next
stage's ``docs``.  The last stage returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import jaccard, mixing, packing, pii, quality
from veilspark.llm.common import table, written
from veilspark.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each personal-data span replaced by its kind."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit_copies(mixing.mix(docs, carry=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", good_documents),
    ("near_duplicates", one_of_each_group),
    ("pii", without_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: DuckDB has no tokenizer: tests hold the result against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
