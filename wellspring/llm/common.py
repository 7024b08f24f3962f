"""Helpers shared by the training-data operators: scratch tables, ordered scans, byte tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z become a-z; every other byte stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; where that is unset a local one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns only, so that extra columns can't clash; a missing one is null."""
    have = set(docs.columns)
    types = {"doc_id": "long", "text": "string", "lang": "string", "source": "string"}
    return docs.select(*[(docs[c] if c in have else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in ("doc_id", "text", *more)])


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for a repartition that AQE must not coalesce: few small rows that give many."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """`name`, or that with underscores before it, such that df has no such column."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = f"_{name}"
    return name


def crc_mod(n: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo n; a null id gives -1 and so is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(-1)).cast("int")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of about most_bytes of text, so that temporary arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).cast(pa.binary())
        at, total = 0, 0
        for i, n in enumerate(pa.compute.binary_length(sizes).fill_null(0).to_pylist()):
            total += n
            if total >= most_bytes:
                yield batch.slice(at, i + 1 - at)
                at, total = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)


def scan_offsets(df: DataFrame, part: str, total: str) -> DataFrame:
    """(part, base): the sum of `total` over all smaller parts. df has few rows for each part; parts number as many as tasks did."""
    sums = df.groupBy(part).agg(F.sum(total).alias("total")).orderBy(part).collect()
    rows, base = [], 0
    for part_id, n in sums:
        rows.append((part_id, base))
        base += n or 0
    return df.sparkSession.createDataFrame(rows, f"{part} int, base long")


def drawn(df: DataFrame, n: int, *keys: str) -> list:
    """At most n rows on the driver, in the order of a hash of the keys: those under a hash share that should hold half as many
    again, so tasks send about that many rows in all and not n each. Where repeated keys make it more, the first 4 n that are found count."""
    share = min(1.0, (1.5 * n + 50) / max(1, df.count()))
    u = (F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / (1 << 30)).alias("__u")
    rows = df.select("*", u).where(F.col("__u") <= share).limit(4 * n).collect()
    return sorted(rows, key=lambda r: (r["__u"], *[str(r[k]) for k in keys]))[:n]
