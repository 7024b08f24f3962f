"""Queries of license scans (3), language identification (4), near-duplicates (5), quality (8) and neighbours (10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licenses, neighbours, quality, simhash


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels and places of the base phrases in all documents."""
    got = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = {c: F.array_join(F.array_sort(F.array_distinct(c)), ",").alias(c) for c in ("base_labels", "labels")}
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined["base_labels"], joined["labels"], "score")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language.predict(docs, language.fit(docs))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate classes of all documents."""
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, threshold=2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each row whose vec_id is divisible by 20."""
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


QUERIES = {"op3_licenses": op3_licenses, "op4_language": op4_language, "op5_simhash": op5_simhash, "op8_quality": op8_quality, "op10_neighbours": op10_neighbours}
SQL: dict[str, str] = {}
