"""Incremental refresh as streams: batch operators inside foreachBatch, and de-duplication with a watermark."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.merging import upsert


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """(base, newest): the version that the base holds, -1 for none, and the newest delta's."""
    try:
        row = spark.read.schema("base long, newest long").parquet(f"{path}/state").orderBy(F.desc("newest"), F.desc("base")).first()
    except AnalysisException:  # not begun
        row = None
    return (row.base, row.newest) if row else (-1, -1)


def _set_state(spark: SparkSession, path: str, base: int, newest: int) -> None:
    spark.createDataFrame([(base, newest)], "base long, newest long").coalesce(1).write.mode("append").parquet(f"{path}/state")


def upsert_stream(stream: DataFrame, path: str, key: list[str], checkpoint: str, buckets: int = 16, compact_every: int = 16) -> DataStreamWriter:
    """STR-01: a log-structured catalog: each micro-batch writes its own rows only, as a delta parted by a hash of the key; `catalog` merges base and
    deltas when they are read. Every `compact_every` batches they become a new base, and what it replaces is dropped.
    A batch that is run again writes the same delta again, or nothing if the base holds it, so a replay changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base, newest = _state(spark, path)
        if number <= base:
            return
        rows = upsert(batch.limit(0), batch, key)
        rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/delta/v={number}")
        if number > newest:
            _set_state(spark, path, base, number)
        if number - base >= compact_every:
            compact(spark, path, key)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def catalog(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """STR-01: the newest row of each key in the base and the deltas after it. Rows are merged by key, one shuffle."""
    base, newest = _state(spark, path)
    parts = ([(base, f"{path}/base/v={base}")] if base >= 0 else []) + [(v, f"{path}/delta/v={v}") for v in range(base + 1, newest + 1)]
    if not parts:
        raise ValueError(f"no catalog at {path}")
    rows = None
    for v, folder in parts:
        part = spark.read.parquet(folder).withColumn("__v", F.lit(v))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    names = [c for c in rows.columns if c not in ("__v", "bucket")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), "__v").alias("r")).select("r.*")


def compact(spark: SparkSession, path: str, key: list[str]) -> None:
    """STR-01: base and deltas become the new base; those before it are deleted once it is named."""
    base, newest = _state(spark, path)
    if newest <= base:
        return
    catalog(spark, path, key).write.mode("overwrite").parquet(f"{path}/base/v={newest}")
    _set_state(spark, path, newest, newest)
    jvm = spark.sparkContext._jvm
    for old in [f"{path}/base/v={base}", *[f"{path}/delta/v={v}" for v in range(base + 1, newest + 1)]]:
        folder = jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def binned_counts(stream: DataFrame, time: str, key: str, days: int, late: str = "3 days") -> DataFrame:
    """STR-02: rows for each key and bin of so many days; the watermark plays the part of the overlap days."""
    start = F.date_trunc("year", time)
    index = F.floor(F.datediff(F.col(time).cast("date"), start.cast("date")) / days).cast("int")
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), key, index.alias("bin")).count().select(F.col("window.start").alias("day"), key, "bin", "count")


def first_seen(stream: DataFrame, time: str, key: list[str], late: str = "3 days") -> DataFrame:
    """STR-03: new index rows only: known keys within the watermark are skipped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
