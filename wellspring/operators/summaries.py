"""Reports over tables: counts, coverage, logs, map windows and generated grids."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.projections import equal_area_inverse


def units(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-13: distinct combinations."""
    return df.select(*columns).distinct()


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """AGG-14: (column, value, rows) of several columns, all in one pass over the table."""
    sets = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*sets)).alias("s")).groupBy("s.key", "s.value").agg(F.count("*").alias("n_rows"))


def source_coverage(benchmark: DataFrame, sources: list[str]) -> DataFrame:
    """AGG-18: share of rows that have each source, and the rows by number of sources."""
    flags = [F.col(f"has_{s}").cast("int") for s in sources]
    by_count = benchmark.groupBy(reduce(lambda a, b: a + b, flags).alias("n_sources")).agg(F.count("*").alias("n_rows"))
    shares = benchmark.agg(*[F.avg(f).alias(s) for f, s in zip(flags, sources, strict=True)])
    stacked = shares.select(F.explode(F.array(*[F.struct(F.lit(s).alias("what"), F.col(s).alias("share")) for s in sources])).alias("s")).select("s.*")
    return stacked.unionByName(by_count.select(F.concat(F.lit("n="), F.col("n_sources").cast("string")).alias("what"), (F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy())).alias("share")))


def label_positives(df: DataFrame, trainable: Column, labels: list[str]) -> DataFrame:
    """AGG-19: positives of each label among trainable rows."""
    return df.where(trainable).agg(*[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in labels])


def layer_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-20."""
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("layer"), "n_rows") for name, df in tables.items()])


def mask_stats(pixels: DataFrame, keys: list[str], clear: list[int], missing: int = 0) -> DataFrame:
    """AGG-22: share of clear and of valid pixels of each chip, and whether it counts as seen."""
    c = F.col("class")
    got = pixels.groupBy(*keys).agg(F.avg(c.isin(*clear).cast("double")).alias("clear_fraction"), F.avg((c != missing).cast("double")).alias("valid_fraction"), F.count("*").alias("n_pixels"))
    return got.withColumn("seen", F.col("valid_fraction") > 0.5)


def band_features(pixels: DataFrame, key: str, bands: list[str]) -> DataFrame:
    """AGG-23: mean and sample deviation of each band; the bands are named, so no pass is needed to find them."""
    return pixels.groupBy(key).agg(*[f(F.when(F.col("band") == b, F.col("value"))).alias(f"{b}_{n}") for b in bands for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def run_summary(log: DataFrame, baseline: int) -> DataFrame:
    """AGG-26: last and best loss and peak memory of each run, and the change of the best loss against one run in percent."""
    got = log.groupBy("run_id").agg(F.max_by("mean_loss", "epoch").alias("last_loss"), F.min("mean_loss").alias("best_loss"), F.max("peak_mb").alias("peak_mb"), F.max("epoch").alias("last_epoch"))
    base = got.where(F.col("run_id") == baseline).select(F.col("best_loss").alias("base"))
    return got.join(F.broadcast(base)).withColumn("best_change_pct", (F.col("best_loss") - F.col("base")) / F.nullif(F.col("base"), F.lit(0.0)) * 100).drop("base")


def fetch_summary(log: DataFrame, key: str) -> DataFrame:
    """AGG-27: successes, failures, mean seconds (of all, of good ones), failed samples, and whether all are good."""
    good = F.col("status") == 200
    return log.groupBy(key).agg(F.count_if(good).alias("n_ok"), F.count_if(~good).alias("n_failed"), F.avg("seconds").alias("mean_s"), F.avg(F.when(good, F.col("seconds"))).alias("mean_ok_s"), F.array_join(F.array_sort(F.collect_set(F.when(~good, F.col("sample")))), ";").alias("failed"), F.bool_and(good).alias("complete"))


def shard_totals(shards: DataFrame, offset: int, limit: int) -> DataFrame:
    """AGG-28: samples in all, and what is left after an offset and a limit."""
    total = F.coalesce(F.sum("n_samples"), F.lit(0))
    return shards.agg(total.alias("n_samples"), F.least(F.greatest(total - offset, F.lit(0)), F.lit(limit)).alias("n_used"), F.count("*").alias("n_shards"), F.count_if(F.col("n_samples") > 1).alias("n_multi"))


def split_profile(df: DataFrame, date: str, label: str) -> DataFrame:
    """AGG-29: date range, rows and positive rate of each side of a split."""
    return df.groupBy("split_group").agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n_rows"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def source_markers(manifest: DataFrame) -> DataFrame:
    """AGG-30: rows, periods and last seen time of each source."""
    return manifest.groupBy("source").agg(F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set(F.col("period").cast("string"))), ";").alias("periods"), F.max("seen").alias("last_seen"))


def explode_log(df: DataFrame, key: str, column: str) -> DataFrame:
    """AGG-32: a row for each entry of an array of structs."""
    return df.select(key, F.explode(column).alias("e")).select(key, "e.*")


def table_sidecar(df: DataFrame, date: str, labels: list[str]) -> DataFrame:
    """SNK-02: rows, date range, positives and the columns, in one aggregation."""
    return df.agg(F.count("*").alias("n_rows"), F.min(date).cast("string").alias("min_date"), F.max(date).cast("string").alias("max_date"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"positive_{c}") for c in labels]).withColumn("columns", F.lit(",".join(df.columns)))


def window_query(df: DataFrame, west: float, south: float, east: float, north: float, limit: int, order: list[str], boxes: bool = False, layer: bool = False) -> DataFrame:
    """FLT-03 .. FLT-05: points inside a window (inclusive), or boxes that touch it, `limit` at most in the order, with a flag
    whether there were more (layer rule: already when the limit is reached)."""
    if boxes:
        found = df.where(~((F.col("east") < west) | (F.col("west") > east) | (F.col("north") < south) | (F.col("south") > north)))
    else:
        found = df.where(F.col("longitude").between(west, east) & F.col("latitude").between(south, north))
    counted = found.orderBy(*order).limit(limit + 1).withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    seen = F.max("__n").over(Window.partitionBy())
    return counted.withColumn("truncated", seen >= limit if layer else seen > limit).where(F.col("__n") <= limit).drop("__n")


def degree_grid(wells: DataFrame, step: float, pad: float) -> DataFrame:
    """GEN-01: cells over the wells' padded extent; integer indices, so edges don't drift."""
    r = wells.agg(*[f(c) for c in ("latitude", "longitude") for f in (F.min, F.max)]).first()
    if r[0] is None:
        return wells.sparkSession.createDataFrame([], "cx long, cy long, min_lon double, min_lat double, max_lon double, max_lat double")
    ys = (floor((r[0] - pad) / step), ceil((r[1] + pad) / step) - 1)
    xs = (floor((r[2] - pad) / step), ceil((r[3] + pad) / step) - 1)
    rows = wells.sparkSession.range(xs[0], xs[1] + 1).select(F.col("id").alias("cx"), F.explode(F.expr(f"sequence({ys[0]}L, {ys[1]}L)")).alias("cy"))
    return rows.select("cx", "cy", (F.col("cx") * step).alias("min_lon"), (F.col("cy") * step).alias("min_lat"), ((F.col("cx") + 1) * step).alias("max_lon"), ((F.col("cy") + 1) * step).alias("max_lat"))


def occupied_cells(wells: DataFrame, step: float, ring: int = 1) -> DataFrame:
    """GEN-01: only cells within `ring` cells of a well, made from the wells; the whole extent is never built."""
    span = F.sequence(F.lit(-ring), F.lit(ring))
    near = wells.where("latitude is not null and longitude is not null").select(F.floor(F.col("longitude") / step).alias("x"), F.floor(F.col("latitude") / step).alias("y")).distinct()
    near = near.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span))
    return near.select((F.col("x") + F.col("dx")).alias("cx"), (F.col("y") + F.col("dy")).alias("cy")).distinct()


def equal_area_grid(spark: SparkSession, bounds: tuple[float, float, float, float], spacing_m: float, standard: float = 30.0) -> DataFrame:
    """GEN-02: grid points (grid_x, grid_y, longitude, latitude) of a cylindrical equal-area projection on the WGS84 ellipsoid, standard parallel 30 degrees."""
    x0, y0 = floor(bounds[0] / spacing_m), floor(bounds[1] / spacing_m)
    x1, y1 = ceil(bounds[2] / spacing_m), ceil(bounds[3] / spacing_m)
    rows = spark.range(x0, x1 + 1).select(F.col("id").alias("grid_x"), F.explode(F.expr(f"sequence({y0}L, {y1}L)")).alias("grid_y"))
    lat, lon = equal_area_inverse(F.col("grid_x") * spacing_m, F.col("grid_y") * spacing_m, standard)
    return rows.select("grid_x", "grid_y", lon.alias("longitude"), lat.alias("latitude"))


def location_pool(regions: DataFrame, key: str, lat_step: float, lon_step_equator: float, per_region: int) -> DataFrame:
    """GEN-03: points inside region boxes: latitude steps are fixed, longitude steps widen with latitude; at most per_region each."""
    n_lat = F.floor((F.col("north") - F.col("south")) / lat_step).cast("int")
    rows = regions.select(key, "west", "east", "south", "north", F.explode(F.sequence(F.lit(0), n_lat)).alias("i"))
    rows = rows.withColumn("latitude", F.col("south") + F.col("i") * lat_step).withColumn("lon_step", lon_step_equator / F.greatest(F.cos(F.radians("latitude")), F.lit(0.01)))
    n_lon = F.floor((F.col("east") - F.col("west")) / F.col("lon_step")).cast("int")
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), n_lon))).withColumn("longitude", F.col("west") + F.col("j") * F.col("lon_step"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("i", "j"))
    return rows.withColumn("n", rank).where(F.col("n") <= per_region).select(key, "n", "latitude", "longitude")


def raster_tiles(points: DataFrame, tile: Column) -> DataFrame:
    """GEN-10: distinct tile ids that cover the points."""
    return points.select(tile.alias("tile_id")).distinct()
