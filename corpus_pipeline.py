"""A training-data pipeline over the documents table: quality, language, near copies, benchmark leaks, packing.

Each stage works on all that the one before kept; its result is written as Parquet and read again. All but the last
return the columns of documents. SQL can't express the stages (learned models, SimHash, string tiling), so ORACLE_SQL
is None and tests hold the stages against brute force.

Defined results: other columns stay to the last stage but one, whatever their names; a null or empty text is in no known language and goes at
the second stage; rows with a null doc_id are rows like any other; of rows that repeat doc_id and text one stays, rows of one doc_id
with different texts all count; without labels of both kinds all documents are good; without a language none is kept; an empty table
or an empty benchmark leaves every stage's table as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm import decontaminate, language, packing, quality, simhash
from wellspring.llm.common import materialize

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good (8)."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language (4)."""
    return language.keep_known(docs, language.fit(docs))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (5): five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (7)."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces in windows of 1024 ids (1)."""
    import public_tokenizers

    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_copies", near_copy_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
