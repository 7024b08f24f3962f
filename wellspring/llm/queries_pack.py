"""Queries of packing (1), sharding (2) and token-id output (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import pack
from .sharding import shard
from .token_store import store_and_read


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents in windows of 1024 ids."""
    got = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer("byte_bpe_50k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law of near-equal bytes; documents of equal text stay together."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as compressed token ids and read back."""
    got = store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer("word_bpe_49k.json"))
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op1_packing": op1_packing, "op2_sharding": op2_sharding, "op9_token_store": op9_token_store}
SQL: dict[str, str] = {}
