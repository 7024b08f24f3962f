"""Ranks, numbering, best-of-group and order-dependent duplicates. Every order names its last tie-break.

A rank over a whole table is taken in two steps: rows are range-parted by the order, counted for each part (few numbers
go to the driver), and numbered inside their parts, so no task holds the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _spread(df: DataFrame, order: list[Column]) -> tuple[DataFrame, str]:
    """df with its range part; written down, so that a part is the same on every read."""
    from ..sources.scratch import materialize

    parted = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    return materialize(parted, "ranked"), "__part"


def _before(parted: DataFrame, amount: Column) -> DataFrame:
    sums = parted.groupBy("__part").agg(amount.alias("n")).orderBy("__part").collect()
    rows, base = [], 0
    for part, n in sums:
        rows.append((part, base))
        base += n or 0
    return F.broadcast(parted.sparkSession.createDataFrame(rows, "__part int, __base long"))


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1, 2, 3 ... in the order (NRM-30, WIN-02)."""
    parted, part = _spread(df, order)
    inner = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return parted.withColumn(name, inner).join(_before(parted, F.count("*")), part).withColumn(name, F.col(name) + F.col("__base")).drop("__part", "__base")


def average_rank_percentile(df: DataFrame, value: str, name: str) -> DataFrame:
    """WIN-01: average rank of ties over the count of known values; null stays null. Only distinct values are ranked, which combine before the shuffle."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    parted, part = _spread(counts, [F.col(value)])
    own = F.sum("__n").over(Window.partitionBy(part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    ranks = parted.withColumn("__upto", own).join(_before(parted, F.sum("__n")), part)
    # the tied rows hold ranks upto - n + 1 .. upto
    percentile = (F.col("__base") + F.col("__upto") - (F.col("__n") - 1) / 2) / F.lit(float(total) or 1.0)
    return df.join(ranks.select(value, percentile.alias(name)), value, "left")


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of ties, from 1."""
    total = df.where(F.col(value).isNotNull()).count()
    return average_rank_percentile(df, value, name).withColumn(name, F.col(name) * float(total))


def best_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN-03, WIN-04: the first row of each group in the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """WIN-05: the first k rows of each group, numbered. Spark prunes each partition to k rows of a group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def until_target(df: DataFrame, keys: list[str], order: list[Column], amount: str, target: int) -> DataFrame:
    """WIN-07: rows in the order until their running total reaches the target; the last may overshoot."""
    before = F.coalesce(F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("taken_before", before).where(F.col("taken_before") < target)


def forward_fill(df: DataFrame, keys: list[str], order: list[Column], is_root: Column, is_cycle: Column, root: Column, cycle: Column) -> DataFrame:
    """WIN-08: each record gets the latest root, and the latest cycle since that root."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rooted = df.withColumn("root_no", F.sum(is_root.cast("long")).over(upto)).withColumn("root", F.last(F.when(is_root, root), True).over(upto))
    inner = Window.partitionBy(*keys, "root_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rooted.withColumn("cycle", F.last(F.when(is_cycle, cycle), True).over(inner))


def grid_places(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """WIN-11: row (from the north) and column (from the west) of each cell among the distinct ones of its request, from 0."""
    w = Window.partitionBy(*keys)
    return df.withColumn("row", F.dense_rank().over(w.orderBy(F.desc(y))) - 1).withColumn("col", F.dense_rank().over(w.orderBy(x)) - 1)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """WIN-12: correlation of average ranks over rows where both are known."""
    both = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    ranked = average_rank_percentile(average_rank_percentile(both, "a", "ra"), "b", "rb")
    return ranked.agg(F.corr("ra", "rb").alias("spearman"))
