"""Unions, upserts, multi-source joins, schema alignment and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import best_of

#: Columns of the unified table by kind.
METADATA = ("well_api", "region_id", "state", "basin", "county_name", "formation", "operator_name", "well_status", "spud_date", "first_prod_date", "context_date")
NUMERIC = ("latitude", "longitude", "elevation_m", "slope_deg", "relief_3px_m", "fault_distance_km", "well_count_2km", "well_count_5km", "nearest_well_km", "permit_count_2km", "permit_count_5km", "nearest_permit_km", "mature_f12_count_5km", "mature_f12_median_gas_5km", "mature_f12_p90_gas_5km", "mature_f12_count_10km", "mature_f12_median_gas_10km", "mature_f12_p90_gas_10km")
CATEGORICAL = ("geology_map_symbol", "geology_age", "geology_lith1")
LABELS = ("f12_gas", "f24_gas", "label_f12_available", "label_f24_available", *[f"label_f12_ge_{t}" for t in (100000, 250000, 500000, 1000000, 2000000)], *[f"label_f24_ge_{t}" for t in (250000, 500000, 1000000, 2000000, 5000000)])
DATES = ("spud_date", "first_prod_date", "context_date")


def unified_type(column: str) -> T.DataType:
    if column in NUMERIC or column in ("f12_gas", "f24_gas"):
        return T.DoubleType()
    if column in LABELS:
        return T.BooleanType()
    return T.DateType() if column in DATES else T.StringType()


def align(df: DataFrame, renames: dict[str, str], **constants: str) -> DataFrame:
    """PRJ-01: rename, add what is missing as null, fix order and types."""
    df = df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns and (b == a or b not in df.columns)})
    have = set(df.columns)

    def column(c: str) -> Column:
        if c in constants:
            return F.lit(constants[c]).cast(unified_type(c)).alias(c)
        return (F.col(c).try_cast(unified_type(c)) if c in have else F.lit(None).cast(unified_type(c))).alias(c)

    return df.select(*[column(c) for c in (*METADATA, *NUMERIC, *CATEGORICAL, *LABELS)])


def ensure_features(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """PRJ-02: named columns exist, as double or string; all others stay."""
    have = set(df.columns)
    cols = {c: (F.col(c) if c in have else F.lit(None)).try_cast("double") for c in numeric}
    cols |= {c: (F.col(c) if c in have else F.lit(None)).try_cast("string") for c in categorical}
    return df.withColumns(cols)


def keep_sorted(df: DataFrame, keep: list[str], order: list[str]) -> DataFrame:
    """PRJ-03."""
    return df.select(*[c for c in keep if c in df.columns]).orderBy(*order)


def fill_for_trees(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """PRJ-04."""
    return df.fillna(-999.0, numeric).fillna("missing", categorical)


def validate(df: DataFrame, region: str) -> DataFrame:
    """VAL-01: one warning row for each thing that is wrong; one aggregation."""
    have = set(df.columns)
    found = [(region, f"missing column: {c}") for c in (*METADATA[:2], *NUMERIC, *CATEGORICAL, *LABELS[:4]) if c not in have]
    aggs = [F.count("*").alias("n")]
    for c in ("latitude", "longitude"):
        if c in have:
            aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    if "well_api" in have:
        aggs.append((F.count("*") - F.countDistinct("well_api") - F.when(F.max(F.col("well_api").isNull()), 1).otherwise(0)).alias("again"))
    r = df.agg(*aggs).first().asDict()
    for c, low, high in (("latitude", 20, 55), ("longitude", -130, -65)):
        if r.get(f"{c}_min") is not None and (r[f"{c}_min"] < low or r[f"{c}_max"] > high):
            found.append((region, f"{c} outside [{low}, {high}]"))
    if r.get("again"):
        found.append((region, f"{r['again']} duplicate well_api values"))
    return df.sparkSession.createDataFrame(found, "region_id string, warning string")


def require(df: DataFrame, columns: list[str], key: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """VAL-02: (usable rows, one for each key, the first in the order; a report of rows, unusable rows and repeats). Missing columns raise."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    kept = best_of(df.where(whole), key, order)
    groups = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(whole).alias("u"))
    sums = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("u"), F.lit(0)).alias("u"), F.count_if(F.col("u") > 0).alias("kept"))
    return kept, sums.select("n_rows", (F.col("n_rows") - F.col("u")).alias("n_unusable"), (F.col("u") - F.col("kept")).alias("n_repeats"))


def union_regions(frames: dict[str, DataFrame | None]) -> tuple[DataFrame, list[str]]:
    """SET-01: union by name; regions without a table are skipped and named."""
    there = [df for df in frames.values() if df is not None]
    if not there:
        raise ValueError("no region has a table")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), there), [k for k, df in frames.items() if df is None]


def upsert(existing: DataFrame, fresh: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """SET-02 .. SET-04: existing and fresh rows by key; fresh wins, and within one side the first in the order. Doing it twice changes nothing."""
    both = existing.withColumn("__fresh", F.lit(0)).unionByName(fresh.withColumn("__fresh", F.lit(1)))
    return best_of(both, key, [F.desc("__fresh"), *(order or [])]).drop("__fresh")


def new_keys(existing: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """SET-02, JN-04: keys that only the fresh side has."""
    return fresh.select(*key).distinct().join(existing.select(*key), key, "left_anti")


def refresh_start(existing: DataFrame, day: str, overlap_days: int, bootstrap: str) -> DataFrame:
    """STR-01: one row: the day from which to ask again: the last seen minus the overlap, or the bootstrap day for an empty catalog."""
    return existing.agg(F.coalesce(F.date_sub(F.max(day), overlap_days), F.lit(bootstrap).cast("date")).alias("start"))


def overlay(base: DataFrame, *later: DataFrame, key: str) -> DataFrame:
    """JN-25: rows by key; each later set's known values override."""
    out = base
    for other in later:
        names = list(dict.fromkeys([*out.columns, *other.columns]))
        a, b = out.select(*[F.col(c).alias(f"a_{c}") if c != key else F.col(c) for c in out.columns]), other.select(*[F.col(c).alias(f"b_{c}") if c != key else F.col(c) for c in other.columns])
        both = a.join(b, key, "full")
        pick = {c: [F.col(f"{s}_{c}") for s, df in (("b", other), ("a", out)) if c in df.columns] for c in names if c != key}
        out = both.select(key, *[F.coalesce(*v).alias(c) for c, v in pick.items()])
    return out


def back_fill(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN-20: left join; a column of both keeps left's value and takes right's where that is null."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    table = right.withColumnsRenamed({c: f"{c}_table" for c in shared})
    joined = left.join(table, key, "left")
    return joined.withColumns({c: F.coalesce(c, f"{c}_table") for c in shared}).drop(*[f"{c}_table" for c in shared])


def merge_sources(sources: dict[str, DataFrame], how: str = "full") -> DataFrame:
    """JN-17: daily values of several sources on (sample_id, date); values are prefixed, and has_<source> tells who has the pair."""
    parts = [df.select("sample_id", "date", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in ("sample_id", "date")], F.lit(True).alias(f"has_{name}")) for name, df in sources.items()]
    out = reduce(lambda a, b: a.join(b, ["sample_id", "date"], how), parts)
    return out.fillna(False, [f"has_{n}" for n in sources])


def future_targets(benchmark: DataFrame, source: DataFrame, column: str, horizons: list[int]) -> DataFrame:
    """JN-18: the source's value that many days later; days without a row stay null."""
    for h in horizons:
        later = source.select("sample_id", F.date_sub("date", h).alias("date"), F.col(column).alias(f"{column}_plus_{h}d"))
        benchmark = benchmark.join(later, ["sample_id", "date"], "left")
    return benchmark


def request_pairs(samples: DataFrame, start: str, end: str, requests: DataFrame | None = None) -> DataFrame:
    """JN-19: distinct (sample_id, date): every day for every sample, or the explicit requests of known samples."""
    if requests is not None:
        return requests.select("sample_id", "date").distinct().join(samples.select("sample_id").distinct(), "sample_id", "left_semi")
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return samples.select("sample_id").distinct().select("sample_id", days.alias("date"))


def differing(left: DataFrame, right: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """SET-05: paths whose values differ, or that one side lacks."""
    both = left.select(path, F.col(value).alias("left_value")).join(right.select(path, F.col(value).alias("right_value")), path, "full")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def flatten_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """SET-05: (key, path, value) for each entry of a JSON object in a text column."""
    return df.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))


def aligned_keys(a: DataFrame, b: DataFrame, shard: str, key: str) -> DataFrame:
    """VAL-03: shards of two modalities side by side: counts, and whether they hold the same keys."""
    sides = [df.groupBy(shard).agg(F.count("*").alias(f"n_{n}"), F.array_sort(F.collect_set(key)).alias(f"keys_{n}")) for n, df in (("a", a), ("b", b))]
    both = sides[0].join(sides[1], shard, "full")
    return both.select(shard, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), F.coalesce(F.col("keys_a") == F.col("keys_b"), F.lit(False)).alias("aligned"))
