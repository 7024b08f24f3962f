"""Exact metrics as grouped aggregations over distinct scores: ties are one threshold."""

from __future__ import annotations

from math import ceil, floor, isfinite

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def classification(df: DataFrame, label: str = "y_true", score: str = "score", by: str | None = None) -> DataFrame:
    """ML-09: rows, positives, ROC-AUC (average ranks) and average precision (step sum over distinct thresholds) of each group,
    or of all; null when one class is missing. Rows of equal score are counted together before anything is ordered."""
    keys = [by] if by else []
    per = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    # sums over smaller scores in two steps: range parts, each summed by itself, and the sums of the parts before
    ranged = materialize(per.repartitionByRange(*keys, score).withColumn("__part", F.spark_partition_id()), "scores")
    parts = ranged.groupBy(*keys, "__part").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    before = parts.select(*[F.col(k).alias("__by") for k in keys], F.col("__part").alias("__own"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}0") for c in "np"], *[F.sum(c).over(whole).alias(f"__{c}1") for c in "np"])
    same = F.col("__part") == F.col("__own")
    joined = ranged.join(before, same & F.col(by).eqNullSafe(F.col("__by")) if by else same)
    local = Window.partitionBy(*keys, "__part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below, p_below = (F.coalesce(F.sum(c).over(local), F.lit(0)) + F.col(f"__{c}0") for c in "np")
    rows = joined.withColumns({"below": below, "tp": F.col("__p1") - p_below, "seen": F.col("__n1") - below})
    sums = rows.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.sum("p").alias("n_pos"), F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2)).alias("rank_sum"), F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("ap_sum"))
    pos, neg = F.col("n_pos"), F.col("n_rows") - F.col("n_pos")
    both = (pos > 0) & (neg > 0)
    return sums.select(*keys, "n_rows", "n_pos", F.when(both, (F.col("rank_sum") - pos * (pos + 1) / 2) / (pos * neg)).alias("roc_auc"), F.when(both, F.col("ap_sum") / pos).alias("average_precision"))


def regression(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by: str | None = None) -> DataFrame:
    """ML-10: RMSE, MAE and R^2."""
    keys = [by] if by else []
    e = F.col(true) - F.col(pred)
    rows = df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys) if keys else df.where(F.col(true).isNotNull() & F.col(pred).isNotNull())
    return rows.agg(F.count("*").alias("n_rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop(true) * F.count("*"), F.lit(0.0))).alias("r2"))


def accuracy(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """ML-11."""
    return df.agg(F.avg(((F.col(score) >= threshold).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


def class_balance(df: DataFrame, label: str, by: list[str] = ()) -> DataFrame:
    """ML-12."""
    return df.groupBy(*by, label).count().withColumnRenamed("count", "n_rows")


def iou(pixels: DataFrame, classes: list[int], pred: str = "pred", target: str = "target", valid: str = "valid", eps: float = 1e-8) -> DataFrame:
    """AGG-21: intersection over union of each class over valid pixels, and their mean."""
    rows = pixels.where(F.col(valid))
    aggs = []
    for c in classes:
        both, any_ = (F.col(pred) == c) & (F.col(target) == c), (F.col(pred) == c) | (F.col(target) == c)
        aggs.append((F.count_if(both) / (F.count_if(any_) + eps)).alias(f"iou_{c}"))
    got = rows.agg(*aggs)
    return got.withColumn("mean_iou", sum(F.col(f"iou_{c}") for c in classes) / len(classes))


def order_statistics(df: DataFrame, column: str, ranks: list[int], bins: int = 1024, few: int = 4096) -> dict[int, float]:
    """The values at given ranks (from 0) of a column of doubles without nulls, by distributed selection: a histogram between the least and the
    largest value tells in which bin each rank lies, and only these bins are counted further. A bin of few rows is sorted, one of equal values is done; no buffer holds all distinct values."""
    found: dict[int, float] = {}
    edge = df.agg(F.min(column), F.max(column)).first()
    open_ = {r: (edge[0], edge[1], r) for r in ranks} if edge[0] is not None else {}  # least, largest, rank among the rows between
    found |= {r: lo for r, (lo, hi, _) in open_.items() if lo == hi}
    open_ = {r: x for r, x in open_.items() if r not in found}
    v = F.col(column)
    share = lambda lo, hi: (v - lo) / (hi - lo) if isfinite(hi - lo) else (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    while open_:
        spans = sorted({x[:2] for x in open_.values()})  # as many as ranks, and apart from each other
        span = F.coalesce(*[F.when((v >= lo) & (v <= hi), F.lit(i)) for i, (lo, hi) in enumerate(spans)])
        place_in = F.coalesce(*[F.when((v >= lo) & (v <= hi), F.least(F.floor(share(lo, hi) * bins).cast("int"), F.lit(bins - 1))) for lo, hi in spans])
        counts: dict[tuple, list] = {}
        for i, _, n, least, most in df.groupBy(span.alias("span"), place_in.alias("bin")).agg(F.count("*"), F.min(column), F.max(column)).where("span is not null").orderBy("span", "bin").collect():
            counts.setdefault(spans[i], []).append((n, least, most))
        left = {}
        for r, (lo, hi, place) in open_.items():
            for n, least, most in counts[lo, hi]:
                if place < n:
                    break
                place -= n
            if least == most:
                found[r] = least
            elif n <= few:
                found[r] = df.where((v >= least) & (v <= most)).select(column).orderBy(column).collect()[place][0]
            else:
                left[r] = (least, most, place)
        open_ = left
    return found


def score_distribution(df: DataFrame, score: str) -> DataFrame:
    """AGG-31: least and largest known score, median and 90 % quantile between the two nearest ranks, and how many are known."""
    known = materialize(df.select(F.col(score).cast("double").alias("score")).where("score is not null and not isnan(score)"), "scores")
    n = known.count()
    places = {q: q * (n - 1) for q in (0.5, 0.9)}
    at = order_statistics(known, "score", sorted({f(p) for p in places.values() for f in (floor, ceil)})) if n else {}
    cut = {q: at[floor(p)] + (p - floor(p)) * (at[ceil(p)] - at[floor(p)]) if n else None for q, p in places.items()}
    return known.agg(F.min("score").alias("min_score"), F.lit(cut[0.5]).cast("double").alias("p50"), F.lit(cut[0.9]).cast("double").alias("p90"), F.max("score").alias("max_score"), F.count("score").alias("n_scored"))


def pool_vectors(df: DataFrame, key: str, vector: str, steps: int, normalise: bool) -> DataFrame:
    """AGG-24: a vector of steps x dims becomes the mean over steps; with normalise, divided by its length."""
    size = F.size(vector) / steps
    pooled = F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), lambda d: sum(F.get(F.col(vector), (d + t * size).cast("int")).cast("double") for t in range(steps)) / steps)
    if normalise:
        length = F.sqrt(F.aggregate(pooled, F.lit(0.0), lambda s, x: s + x * x))
        pooled = F.transform(pooled, lambda x: x / F.nullif(length, F.lit(0.0)))
    return df.select(key, pooled.alias("pooled"))


def vector_health(df: DataFrame, vector: str) -> DataFrame:
    """AGG-25: mean length of vectors; mean, smallest and largest population deviation of components; largest absolute value."""
    length = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = df.agg(F.avg(length).alias("mean_norm"))
    dims = df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.stddev_pop(F.col("x").cast("double")).alias("s"), F.max(F.abs(F.col("x").cast("double"))).alias("m"))
    return rows.crossJoin(dims.agg(F.avg("s").alias("mean_std"), F.min("s").alias("min_std"), F.max("s").alias("max_std"), F.max("m").alias("max_abs")))
