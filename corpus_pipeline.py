"""From raw documents to packed training sequences: STAGES in order, each written and read again as the next's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortwire.llm import decontaminate, exact_dedup, language_id, packing, simhash
from cohortwire.llm.common import dropped, id_remainder, written
from cohortwire.llm.tokens import default_vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language_id.with_known_language(docs, id_remainder(5) == 0)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest id."""
    index = exact_dedup.temporary_index(spark)
    kept = exact_dedup.distinct_documents(docs, index)
    index.drop()
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.one_of_each_group(docs, shingle=5, least_similarity=0.8)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 4096."""
    return packing.pack(docs, default_vocabulary())


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("benchmark_free", benchmark_free),
    ("packed", packed),
]

#: Stages 1, 3, 4 and 5 can't be said in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(docs)  # what the stage before wrote; the given table is none of ours
        docs = kept
    return docs
