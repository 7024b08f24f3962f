"""Splits, quotas and samples. Random choice is a stable hash of the key (ties by key), so a sample is the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import stable_fraction


def split_by_date(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    """SMP-01: before the cutoff is train; raises if a side is empty."""
    out = df.withColumn("split_group", F.when(F.col(date) < F.lit(cutoff).cast("date"), "train").otherwise("test"))
    if out.select("split_group").distinct().count() < 2:
        raise ValueError("the temporal split leaves one side empty")
    return out


def quantile_cutoffs(df: DataFrame, date: str, quantiles: list[float]) -> list[float]:
    """Linear quantiles of the date, in days since 1970."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).cast("double")
    return df.agg(F.percentile(day, F.array(*[F.lit(q) for q in quantiles])).alias("q")).first().q or []


def _days(date: str) -> Column:
    return F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))


def split_by_quantile(df: DataFrame, date: str, q: float) -> DataFrame:
    """SMP-02: up to the quantile of the date (linear) is train."""
    cut = quantile_cutoffs(df, date, [q])
    return df.withColumn("split_group", F.when(_days(date) <= (cut[0] if cut else 0.0), "train").otherwise("test"))


def fallback_quantiles(q: float) -> list[float]:
    """SMP-03: the wished quantile, then ever farther ones to both sides, within [0.5, 0.98)."""
    steps = [q] + [round(q + sign * d / 100, 4) for d in (5, 10, 15, 20) for sign in (-1, 1)]
    return list(dict.fromkeys(x for i, x in enumerate(steps) if i == 0 or 0.5 <= x < 0.98))


def split_with_fallback(df: DataFrame, date: str, q: float, label: str | None = None) -> tuple[float, DataFrame]:
    """SMP-03: the first quantile that leaves rows (and, with a label, two classes) on both sides; else the wished one. All cutoffs are tried in one aggregation."""
    tries = fallback_quantiles(q)
    cuts = quantile_cutoffs(df, date, tries)
    checks = []
    for i, c in enumerate(cuts):
        for side, cond in (("a", _days(date) <= c), ("b", _days(date) > c)):
            what = F.col(label) if label else F.lit(1)
            checks.append(F.countDistinct(F.when(cond, what)).alias(f"{side}{i}"))
    least = 2 if label else 1
    seen = df.agg(*checks).first() if checks else None
    chosen = next((i for i in range(len(cuts)) if seen[f"a{i}"] >= least and seen[f"b{i}"] >= least), 0)
    cut = cuts[chosen] if cuts else 0.0
    return tries[chosen], df.withColumn("split_group", F.when(_days(date) <= cut, "train").otherwise("test"))


def leave_out(df: DataFrame, column: str, value: str) -> DataFrame:
    """SMP-04: rows of one state or basin are the test side."""
    return df.withColumn("split_group", F.when(F.upper(column) == value.upper(), "test").otherwise("train"))


def split_from_cohort(df: DataFrame, date: str, q: float, label: str | None = None) -> DataFrame:
    """SMP-05: a split_group column is honoured if both sides are there; else SMP-03."""
    if "split_group" in df.columns and {r[0] for r in df.select("split_group").distinct().collect()} >= {"train", "test"}:
        return df
    return split_with_fallback(df.drop("split_group"), date, q, label)[1]


def group_split(df: DataFrame, group: str, share: float = 0.2, seed: str = "group") -> DataFrame:
    """SMP-06: whole groups go to test: the first ceil(share) of the groups by stable hash."""
    groups = df.select(group).where(F.col(group).isNotNull()).distinct().withColumn("u", stable_fraction(F.col(group), seed))
    n = groups.count()
    test = groups.orderBy("u", group).limit(-int(-n * share // 1)).select(group, F.lit("test").alias("split_group"))
    return df.join(test, group, "left").fillna("train", ["split_group"])


def hash_split(key: Column, seed: str, train: float, val: float) -> Column:
    """SMP-07."""
    u = stable_fraction(key, seed)
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def binary_quotas(positive: int, negative: int, most: int) -> tuple[int, int]:
    """SMP-08: half each; what one side can't use goes to the side with more left."""
    p, n = min(positive, most // 2), min(negative, most // 2)
    rest = most - p - n
    if rest > 0:
        if positive - p > negative - n:
            p = min(positive, p + rest)
        else:
            n = min(negative, n + rest)
    return p, n


def _ranked(df: DataFrame, keys: list[str], key: str, seed: str) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(stable_fraction(F.col(key), seed), key)))


def balanced_sample(df: DataFrame, label: str, key: str, most: int, seed: str = "sample") -> DataFrame:
    """SMP-08: at most `most` rows, the classes as even as supply allows; one class only: any rows."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total, p, n = sum(counts.values()), counts.get(True, 0), counts.get(False, 0)
    if most <= 0 or total <= most:
        return df
    if not p or not n:
        return df.orderBy(stable_fraction(F.col(key), seed), key).limit(most)
    p, n = binary_quotas(p, n, most)
    # each class is a top-k by hash, which every partition cuts to k rows first
    order = [stable_fraction(F.col(key), seed), F.col(key)]
    return df.where(F.col(label)).orderBy(*order).limit(p).unionByName(df.where(~F.col(label)).orderBy(*order).limit(n))


def cap_per_group(df: DataFrame, group: str, key: str, most: int, seed: str = "cap") -> DataFrame:
    """SMP-09: at most that many rows of each group, by stable hash."""
    return _ranked(df, [group], key, seed).where(F.col("__rank") <= most).drop("__rank")


def distribute_quota(counts: dict[str, int], target: int, equal_share: float) -> dict[str, int]:
    """SMP-10: part of the target is shared out equally over buckets, the rest in proportion to what is left, largest remainders first; never over supply."""
    counts = {k: int(v) for k, v in sorted(counts.items()) if v > 0}
    if target <= 0 or target >= sum(counts.values()):
        return counts
    names = list(counts)
    each, extra = divmod(min(target, round(target * equal_share)), len(names) or 1)
    got = {k: min(counts[k], each + (i < extra)) for i, k in enumerate(names)}
    while (rest := target - sum(got.values())) > 0:
        room = {k: counts[k] - got[k] for k in names if counts[k] > got[k]}
        whole = sum(room.values())
        exact = {k: v * rest / whole for k, v in room.items()}
        for k, x in exact.items():
            got[k] += int(x)
        left = target - sum(got.values())
        for k in sorted(exact, key=lambda k: int(exact[k]) - exact[k]):
            if left and got[k] < counts[k]:
                got[k], left = got[k] + 1, left - 1
    return got


def take_quota(df: DataFrame, bucket: str, key: str, quotas: dict[str, int], seed: str = "quota") -> DataFrame:
    """SMP-11: the first rows of each bucket by stable hash; the quotas, one for each bucket, are broadcast."""
    table = df.sparkSession.createDataFrame(list(quotas.items()), f"{bucket} string, __quota long")
    # the largest quota is a literal, so every task keeps no more rows of a bucket
    ranked = _ranked(df.join(F.broadcast(table), bucket), [bucket], key, seed).where(F.col("__rank") <= max(quotas.values(), default=0))
    return ranked.where("__rank <= __quota").drop("__rank", "__quota")


def bucket_counts(df: DataFrame, bucket: str) -> dict[str, int]:
    return {r[bucket]: r["count"] for r in df.where(F.col(bucket).isNotNull()).groupBy(bucket).count().collect()}


def quota_sample(df: DataFrame, bucket: str, key: str, target: int, equal_share: float, seed: str = "quota") -> DataFrame:
    """SMP-10 and SMP-11 together."""
    return take_quota(df, bucket, key, distribute_quota(bucket_counts(df, bucket), target, equal_share), seed)


def separated(df: DataFrame, key: str, distance: int, seed: str = "anchor") -> DataFrame:
    """SMP-12: the rows that a greedy walk in stable-hash order keeps when each must be farther than `distance` (Chebyshev) from all kept before.

    In each round every open row that comes first among its open neighbours is kept, and its neighbours are closed: the
    same set as the walk's, in as many rounds as the longest chain of ever later neighbours. The first of a neighbourhood is taken along x, then along y;
    a task starts with at most some 2^16 cells, whatever the files of the table.
    """
    from ..sources.scratch import materialize

    dealt = lambda df: df.repartition(max(1, -(-df.count() // 2**16)), "grid_x", "grid_y")

    def first_along(cells: DataFrame, axis: str) -> DataFrame:
        sent = dealt(cells).withColumn("d", F.explode(span)).withColumn(axis, F.col(axis) + F.col("d"))
        return materialize(sent.groupBy("grid_x", "grid_y").agg(F.min("who").alias("who")), "firsts")

    span = F.sequence(F.lit(-distance), F.lit(distance))
    open_ = materialize(df.select(key, "grid_x", "grid_y", stable_fraction(F.col(key), seed).alias("u")), "open")
    kept = None
    while open_.take(1):
        first = first_along(first_along(open_.select("grid_x", "grid_y", F.struct("u", key).alias("who")), "grid_x"), "grid_y").withColumnRenamed("who", "first")
        chosen = materialize(open_.join(first, ["grid_x", "grid_y"]).where(F.col("first") == F.struct("u", key)).select(key, "grid_x", "grid_y"), "chosen")
        kept = chosen if kept is None else kept.unionByName(chosen)
        closed = dealt(chosen).withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span)).select((F.col("grid_x") + F.col("dx")).alias("grid_x"), (F.col("grid_y") + F.col("dy")).alias("grid_y")).distinct()
        open_ = materialize(open_.join(closed, ["grid_x", "grid_y"], "left_anti"), "open")
    return df.limit(0) if kept is None else df.join(kept.select(key), key, "left_semi")


def quota_anchors(df: DataFrame, bucket: str, key: str, target: int, distance: int, equal_share: float, seed: str = "anchor") -> DataFrame:
    """SMP-12: `target` rows, each at least `distance` (Chebyshev) from all others: bucket after bucket, in name order, up to its quota (SMP-10) by
    a greedy walk in stable-hash order; what the quotas leave open is filled from all buckets. Fewer than `target` raise.

    The first n rows of a greedy walk are the first n of all that it would keep, so each walk is `separated` on the cells that are still open."""
    chosen: list[tuple] = []  # at most `target` rows
    span = F.sequence(F.lit(1 - distance), F.lit(distance - 1))

    def walk(rows: DataFrame, most: int) -> None:
        if chosen:
            taken = df.sparkSession.createDataFrame(chosen, "k string, x long, y long").withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span))
            rows = rows.join(taken.select((F.col("x") + F.col("dx")).alias("grid_x"), (F.col("y") + F.col("dy")).alias("grid_y")).distinct(), ["grid_x", "grid_y"], "left_anti")
        kept = separated(rows, key, distance - 1, seed).orderBy(stable_fraction(F.col(key), seed), key).limit(most)
        chosen.extend((str(r[key]), r["grid_x"], r["grid_y"]) for r in kept.collect())

    for name, quota in sorted(distribute_quota(bucket_counts(df, bucket), target, equal_share).items()):
        walk(df.where(F.col(bucket) == name), quota)
    if len(chosen) < target:
        walk(df, target - len(chosen))
    if len(chosen) < target:
        raise ValueError(f"only {len(chosen)} of {target} anchors keep a distance of {distance}")
    return df.join(df.sparkSession.createDataFrame([(k,) for k, _, _ in chosen], f"`{key}` string"), key, "left_semi")


def expand_members(anchors: DataFrame, cells: DataFrame, key: str, radius: int) -> DataFrame:
    """SMP-13: the cells around each anchor with their offsets."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    around = anchors.select(F.col(key).alias("anchor"), F.col("grid_x").alias("ax"), F.col("grid_y").alias("ay")).withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span))
    around = around.select("anchor", "dx", "dy", (F.col("ax") + F.col("dx")).alias("grid_x"), (F.col("ay") + F.col("dy")).alias("grid_y"))
    return around.join(cells.select(key, "grid_x", "grid_y"), ["grid_x", "grid_y"]).select("anchor", key, "dx", "dy")


def isolated_centres(df: DataFrame, bucket: str, key: str, target: int, equal_share: float, seed: str = "isolated") -> DataFrame:
    """SMP-14: by quota, then topped up from the rest by stable hash."""
    got = quota_sample(df, bucket, key, target, equal_share, seed).withColumn("pick", F.lit("quota"))
    short = target - got.count()
    if short <= 0:
        return got
    rest = df.join(got.select(key), key, "left_anti").orderBy(stable_fraction(F.col(key), seed), key).limit(short)
    return got.unionByName(rest.withColumn("pick", F.lit("top_up")))


def balanced_phases(df: DataFrame, phase: str, key: str, limit: int) -> DataFrame:
    """SMP-15: half of the limit from each phase in key order; what one phase lacks the other fills."""
    n = df.groupBy(phase).count().count() or 1
    # a phase never gives more than the limit, so every task keeps no more rows of it
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(phase).orderBy(key))).where(F.col("__rank") <= limit)
    return ranked.withColumn("__extra", F.col("__rank") > limit // n).orderBy("__extra", "__rank", phase, key).limit(limit).drop("__rank", "__extra")


def first_complete(df: DataFrame, key: str, root: str, complete: Column, n_train: int, n_val: int) -> DataFrame:
    """SMP-16: complete samples, the first root of repeated ones, the first n in key order to train, the next m to val."""
    from .ranking import best_of

    one = best_of(df.where(complete), [key], [F.col(root)]).orderBy(key).limit(n_train + n_val)
    return one.withColumn("split_group", F.when(F.row_number().over(Window.orderBy(key)) <= n_train, "train").otherwise("val"))
