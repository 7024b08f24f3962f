"""Sinks. Spark's committer makes each write all or nothing, also when executors are lost."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    """SNK-01: Parquet or CSV by suffix."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown table suffix: {path}")


def cell_features(df: DataFrame, properties: list[str], digits: int = 3) -> DataFrame:
    """SNK-03: one GeoJSON feature, as text, for each cell with min / max longitude and latitude; numbers rounded, unknown ones null."""
    x0, y0, x1, y1 = (F.round(F.col(c).cast("double"), 6) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    ring = F.array(*[F.array(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    kinds = dict(df.dtypes)

    def value(c: str) -> Column:
        known = F.when(~F.isnan(c), F.round(c, digits)) if kinds[c] in ("double", "float") else F.col(c)
        return known.alias(c)

    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(*[value(c) for c in properties]).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_features(df: DataFrame, properties: list[str], path: str, digits: int = 3) -> None:
    """SNK-03: features as lines of text."""
    cell_features(df, properties, digits).write.mode("overwrite").text(path)


def append_rows(df: DataFrame, path: str) -> None:
    """SNK-04: add rows to an index."""
    df.write.mode("append").parquet(path)


class Conflict(RuntimeError):
    """Another writer has replaced the index since it was read."""


def index_version(spark: SparkSession, path: str) -> int:
    """SNK-04: number of the newest commit of an index; 0 if there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return max([int(n) for n in names if n.isdigit()], default=0)


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """SNK-04: the rows of an index as of a version, the newest if none is given: those of one commit, whatever is being written."""
    number = version or index_version(spark, path)
    return spark.read.parquet(spark.read.text(f"{path}/commits/{number}").first().value)


def replace_index(df: DataFrame, path: str, made_from: int) -> int:
    """SNK-04: replace an index as a whole by a table that was made from its version `made_from`; gives the new version.

    The rows are written to a folder of their own first. The commit is one file, named by the next version, that is created only if it isn't there; so of
    two writers that began alike one wins, and the other gets a Conflict. Readers see the old rows or the new ones. It needs a file
    system whose exclusive creation is atomic, as HDFS and local ones are.
    """
    spark = df.sparkSession
    data = f"{path}/data-{uuid.uuid4().hex}"
    df.write.parquet(data)
    jvm = spark.sparkContext._jvm
    commit = jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{made_from + 1}")
    fs = commit.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # the file appears with its content: it is written beside and renamed, after the name is taken by an exclusive creation of its lock
    lock = jvm.org.apache.hadoop.fs.Path(f"{path}/commits/lock-{made_from + 1}")
    try:
        if fs.exists(commit) or index_version(spark, path) != made_from:
            raise Conflict(path)
        fs.create(lock, False).close()
    except Exception as e:
        fs.delete(jvm.org.apache.hadoop.fs.Path(data), True)
        raise Conflict(f"{path}: version {made_from} is not the newest") from e
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}/commits/new-{made_from + 1}")
    out = fs.create(beside, True)
    out.write(bytearray(data.encode()))
    out.close()
    if not fs.rename(beside, commit):
        raise Conflict(path)
    return made_from + 1


def publish(df: DataFrame, path: str, snapshot: str) -> None:
    """SNK-05: a results table under its snapshot id; earlier ones stay. Publishing an id again replaces it."""
    df.withColumn("snapshot_id", F.lit(snapshot)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """SNK-05: the newest snapshot; ids sort by time."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("snapshot_id")).first()[0]
    return rows.where(F.col("snapshot_id") == newest)
