"""Queries of LM scoring (6) and benchmark decontamination (7)."""

from __future__ import annotations

from math import log10

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_mixing, decontaminate


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents, by unigrams and by the model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = context_mixing.score(docs, context_mixing.fit(docs))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("bits") * -log10(2)).alias("score"), "bits_per_byte")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (document, benchmark item) pairs in which the item is covered."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate.summary(decontaminate.find_leaks(docs, benchmark))


QUERIES = {"op6_context_mixing": op6_context_mixing, "op7_decontamination": op7_decontamination}
SQL: dict[str, str] = {}
