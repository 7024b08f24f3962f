"""Observation planning: time bins, sequences, scene shortlists, event lists, tiles and training windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import chebyshev, compass_role, offset_lat_lon
from ..sources.scratch import materialize
from .counting import points_in_boxes
from .ranking import top_k

#: The four season windows of a year, as (name, first month, first day, last month, last day).
SEASONS = (("early_spring", 3, 1, 4, 30), ("late_spring", 5, 1, 6, 30), ("summer", 7, 1, 8, 31), ("fall", 9, 1, 10, 31))


def bin_of(day: Column, cadence: int) -> Column:
    """STR-02: index of the bin within the year; bins restart each 1 January."""
    return F.floor((F.dayofyear(day) - 1) / cadence).cast("int")


def year_bins(years: DataFrame, cadence: int) -> DataFrame:
    """GEN-04: bins of each year: index, start, end (not included; the last bin is short) and midpoint day. years: one column, year."""
    first = F.make_date("year", F.lit(1), F.lit(1))
    after = F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))
    rows = years.select("year", F.posexplode(F.expr(f"sequence(make_date(year, 1, 1), make_date(year, 12, 31), interval {cadence} days)")).alias("bin", "bin_start"))
    end = F.least(F.date_add("bin_start", cadence), after)
    return rows.select("year", "bin", "bin_start", end.alias("bin_end"), F.expr(f"date_add(bin_start, cast(floor(datediff(least(date_add(bin_start, {cadence}), make_date(year + 1, 1, 1)), bin_start) / 2) as int))").alias("bin_mid")).where(F.col("bin_start") >= first)


def seasons(years: DataFrame) -> DataFrame:
    """GEN-05."""
    windows = F.array(*[F.struct(F.lit(n).alias("season"), F.make_date("year", F.lit(a), F.lit(b)).alias("season_start"), F.make_date("year", F.lit(c), F.lit(d)).alias("season_end")) for n, a, b, c, d in SEASONS])
    return years.select("year", F.explode(windows).alias("w")).select("year", "w.*")


def location_years(locations: DataFrame, years: list[int] | None = None, date: str | None = None, offset: int = 0) -> DataFrame:
    """GEN-06: a sequence for each location and anchor year: given years, or the year of a date plus an offset."""
    year = F.explode(F.array(*[F.lit(y) for y in years])) if years else F.year(date) + offset
    return locations.withColumn("year", year).where("year is not null").withColumn("sequence_id", F.concat(F.col("sample_id"), F.lit("__year_"), F.col("year").cast("string")))


def search_groups(sequences: DataFrame, size: float, pad: float) -> DataFrame:
    """AGG-15: group of a coarse grid and a year: padded bounding box and members."""
    keys = [F.floor((F.col("latitude") + 90) / size).alias("gy"), F.floor((F.col("longitude") + 180) / size).alias("gx"), F.col("year")]
    return sequences.groupBy(*keys).agg((F.min("longitude") - pad).alias("west"), (F.max("longitude") + pad).alias("east"), (F.min("latitude") - pad).alias("south"), (F.max("latitude") + pad).alias("north"), F.count("*").alias("members"))


def covering(locations: DataFrame, scenes: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """For each location and group of scenes (`keys`) the k first scenes by the order whose box holds the point, with `rank`. The order
    ends with a key and knows the scene only, so most pairs need not be made: of equal boxes the k first of a group count; and in a cell of a grid
    all scenes of a group after the k-th one that holds the whole cell can't be among the k first of any point in it.

    A box lies on the grid whose cell is a sixth to a third of its longer side, so it touches 49 cells at most and, unless it is narrow, holds some whole.
    """
    box = ["west", "east", "south", "north"]
    held = scenes.where("west <= east and south <= north")
    kept = top_k(held.select(*held.columns, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("__o")), [*box, *keys], [F.col("__o")], k).drop("rank")
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")) / 6)), F.lit(-20)).cast("int")
    kept = materialize(kept.withColumn("__level", F.coalesce(level, F.lit(-20))), "scenes")
    step = F.pow(F.lit(2.0), F.col("__level"))
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / step).cast("long"), F.floor(F.col(b) / step).cast("long"))
    group = ["__level", "cx", "cy", *keys]
    dealt = kept.withColumn("cx", F.explode(cells("west", "east"))).withColumn("cy", F.explode(cells("south", "north")))
    whole = (F.col("west") <= F.col("cx") * step) & (F.col("east") >= (F.col("cx") + 1) * step) & (F.col("south") <= F.col("cy") * step) & (F.col("north") >= (F.col("cy") + 1) * step)
    last = top_k(dealt.where(whole).select(*group, "__o"), group, [F.col("__o")], k).where(F.col("rank") == k)
    last = materialize(last.select(*group, F.col("__o").alias("__last")), "whole-cells")  # small, so that joins see its size
    dealt = dealt.join(last, group, "left").where("__last is null or __o <= __last").drop("__last")
    levels = F.broadcast(kept.select("__level").distinct())
    points = locations.where("latitude is not null and longitude is not null").select("sample_id", "latitude", "longitude").join(levels)
    points = points.withColumns({"cx": F.floor(F.col("longitude") / step).cast("long"), "cy": F.floor(F.col("latitude") / step).cast("long")})
    hits = points.join(dealt, ["__level", "cx", "cy"]).where("longitude between west and east and latitude between south and north")
    return top_k(hits, ["sample_id", *keys], [F.col("__o")], k).drop("__o", "__level", "cx", "cy")


def scene_shortlists(locations: DataFrame, scenes: DataFrame, cadence: int, k: int, optical: bool = True) -> DataFrame:
    """JN-15, WIN-05: for each location and time bin the k best scenes whose footprint holds the point: by cloud (optical; null
    last), then distance in time to the bin's middle, then the newest. The interval join becomes an equi join: a scene's bin is
    computed from its time, its footprint is exploded to cells (`covering`). scenes: scene_id, epoch_s, cloud_cover, west, east, south, north."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("epoch_s") / 86400).cast("int"))
    dated = scenes.withColumn("day", day).withColumns({"bin": bin_of(F.col("day"), cadence), "year": F.year("day")})
    start = F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("bin") * cadence)
    middle = F.datediff(start, F.lit("1970-01-01").cast("date")) * 86400 + F.lit(cadence * 43200)
    order = [*([F.col("cloud_cover").isNull(), F.col("cloud_cover")] if optical else []), F.abs(F.col("epoch_s") - middle), -F.col("epoch_s"), F.col("scene_id")]
    slim = dated.select("scene_id", "epoch_s", "cloud_cover", "west", "east", "south", "north", "year", "bin")
    return covering(locations, slim, ["year", "bin"], order, k).select("sample_id", "year", "bin", "rank", "scene_id", "cloud_cover")


def season_scenes(locations: DataFrame, scenes: DataFrame, most_cloud: float = 35, preferred: tuple = ()) -> DataFrame:
    """JN-16: the scene chosen for each year, season window and tile: it is less cloudy than `most_cloud`, and comes first by the
    locations it covers, the place of its collection in `preferred`, its cloud cover, the newest, the smallest scene_id. scenes: scene_id, tile_id, collection, epoch_s, cloud_cover and box."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("epoch_s") / 86400).cast("int"))
    dated = scenes.where(F.col("cloud_cover") < most_cloud).withColumn("day", day).withColumn("year", F.year("day"))
    inside = lambda a, b, c, d: F.col("day").between(F.make_date("year", F.lit(a), F.lit(b)), F.make_date("year", F.lit(c), F.lit(d)))
    season = F.coalesce(*[F.when(inside(*days), F.lit(name)) for name, *days in SEASONS])
    dated = dated.withColumn("season", season).where("season is not null")
    dated = materialize(dated, "dated-scenes")  # asked for three times: boxes, their chunks, and the join
    order = [F.desc("n_points"), preference(preferred), F.col("cloud_cover"), F.desc("epoch_s"), F.col("scene_id")]
    return top_k(covered(locations, dated), ["year", "season", "tile_id"], order, 1).drop("rank")


def preference(preferred: tuple) -> Column:
    """Place of a collection among the preferred ones, 999 for any other."""
    return F.coalesce(*[F.when(F.col("collection") == c, F.lit(k)) for k, c in enumerate(preferred)], F.lit(999))


def season_hits(locations: DataFrame, scenes: DataFrame, most_cloud: float = 35, preferred: tuple = ()) -> DataFrame:
    """JN-16: for each location and season window the best of the chosen scenes (`season_scenes`) whose box holds the point: by
    collection, cloud, the newest, scene_id. A location without a hit in all windows of a year has none in that year."""
    chosen = materialize(season_scenes(locations, scenes, most_cloud, preferred), "season-scenes")
    best = covering(locations, chosen, ["year", "season"], [preference(preferred), F.col("cloud_cover"), -F.col("epoch_s"), F.col("scene_id")], 1)
    whole = F.count("*").over(Window.partitionBy("sample_id", "year"))
    return best.withColumn("n", whole).where(F.col("n") == len(SEASONS)).select("sample_id", "year", "season", "scene_id", "tile_id", "n_points")


def covered(points: DataFrame, scenes: DataFrame) -> DataFrame:
    """scenes with n_points, the number of points in their box."""
    box = ["west", "east", "south", "north"]
    found = points_in_boxes(points, scenes).withColumnsRenamed({c: f"__{c}" for c in box})
    same = [F.col(c).cast("double") == F.col(f"__{c}") for c in box]
    return scenes.join(found, same, "left").withColumn("n_points", F.coalesce("n", F.lit(0).cast("long"))).drop("n", *[f"__{c}" for c in box])


def scene_coverage(points: DataFrame, scenes: DataFrame) -> DataFrame:
    """JN-26: how many points lie in each scene's box; scenes without any have 0."""
    return covered(points, scenes.select("scene_id", "west", "east", "south", "north")).select("scene_id", "n_points")


def recent_clear(scenes: DataFrame, lookback_days: int, most_cloud: float) -> DataFrame:
    """FLT-08: scenes within the lookback from the latest scene, and not too cloudy; an unknown cloud cover passes."""
    latest = scenes.agg(F.max("epoch_s").alias("latest"))
    near = F.col("epoch_s") >= F.col("latest") - lookback_days * 86400
    return scenes.join(F.broadcast(latest)).where(near & (F.col("cloud_cover").isNull() | (F.col("cloud_cover") < most_cloud))).drop("latest")


def coverage(plan: DataFrame, key: str, bins: int) -> DataFrame:
    """AGG-16: bins with optical, radar and both for each sequence, the paired share, and that share rounded to tens (halves to even)."""
    got = plan.groupBy(key).agg(F.count("*").alias("n_bins"), F.count_if("has_s2").alias("n_s2"), F.count_if("has_s1").alias("n_s1"), F.count_if(F.col("has_s2") & F.col("has_s1")).alias("n_paired"))
    return got.withColumn("paired_fraction", F.col("n_paired") / bins).withColumn("decile", F.bround(F.col("paired_fraction") * 100, -1).cast("long"))


def sequence_frame(plan: DataFrame, key: str, order: str, first: list[str], least_paired: int) -> DataFrame:
    """AGG-17: first attributes and found counts of each sequence, those with enough paired bins."""
    got = plan.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in first], F.count_if(F.col("has_s2") & F.col("has_s1")).alias("n_paired"))
    return got.where(F.col("n_paired") >= least_paired)


def trim_plan(plan: DataFrame, key: str, bin_: str, most: int, least: int) -> DataFrame:
    """FLT-11: paired bins only, the first `most` of each sequence, sequences with at least `least` of them."""
    w = Window.partitionBy(key)
    kept = plan.where(F.col("has_s2") & F.col("has_s1")).withColumn("__n", F.row_number().over(w.orderBy(bin_))).where(F.col("__n") <= most)
    return kept.withColumn("__c", F.count("*").over(w)).where(F.col("__c") >= least).drop("__n", "__c")


def rerank(shortlist: DataFrame, quality: DataFrame, keys: list[str], item: str) -> DataFrame:
    """WIN-06: order a shortlist anew by measured clear share (unmeasured last), then cloud, then the old order; the best of each group."""
    joined = shortlist.join(quality.select(item, "clear_fraction"), item, "left")
    return top_k(joined.withColumnRenamed("rank", "old_rank"), keys, [F.col("clear_fraction").desc_nulls_last(), F.col("cloud_cover").asc_nulls_last(), F.col("old_rank"), F.col(item)], 1, "new_rank").drop("new_rank")


def observation_events(index: DataFrame, key: str, lists: dict[str, str], count: str | None = None) -> DataFrame:
    """GEN-07: one row for each frame: parallel arrays are taken by frame index; the number of frames is the column `count`, or the
    longest list. lists: output name -> array column; a list that is too short gives null."""
    longest = F.greatest(F.lit(0), *[F.coalesce(F.size(c), F.lit(0)) for c in lists.values()])
    frames = F.greatest(F.coalesce(F.col(count), longest), F.lit(0)).cast("int") if count else longest
    rows = index.withColumn("frame", F.explode(F.when(frames > 0, F.sequence(F.lit(0), frames - 1))))
    return rows.select(key, "frame", *[F.get(F.col(c), F.col("frame")).alias(n) for n, c in lists.items()])


def quality_gate(events: DataFrame, clear: str, valid: str, least: float) -> DataFrame:
    """FLT-06: quality is the clear share, else the valid share, else 0; rows below the least drop out."""
    return events.withColumn("quality", F.coalesce(F.col(clear), F.col(valid), F.lit(0.0))).where(F.col("quality") >= least)


def tile_manifest(centres: DataFrame, key: str, radius: int, spacing_m: float) -> DataFrame:
    """GEN-08: (2 radius + 1)^2 local tiles around each centre with role, ring and place, and one regional tile."""
    span = range(-radius, radius + 1)
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit("local").alias("kind")) for b in span for a in span], F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit("regional").alias("kind"))))
    rows = centres.withColumn("o", offsets).select(key, "latitude", "longitude", "o.*")
    lat, lon = offset_lat_lon(F.col("latitude"), F.col("longitude"), F.col("dx").cast("double") * spacing_m, F.col("dy").cast("double") * spacing_m)
    name = F.concat_ws("_", F.col(key), F.col("kind"), F.col("dx").cast("string"), F.col("dy").cast("string"))
    return rows.select(key, name.alias("tile_id"), "kind", "dx", "dy", chebyshev(F.col("dx"), F.col("dy")).alias("ring"), compass_role(F.col("dx"), F.col("dy")).alias("role"), lat.alias("tile_lat"), lon.alias("tile_lon"))


def training_windows(manifest: DataFrame, key: str, core: int, support: int) -> DataFrame:
    """GEN-09: for each target tile inside the core ring how many tiles of its centre support it (within `support`), and how many are halo (beyond the core)."""
    local = manifest.where("kind = 'local'")
    targets = local.where(F.col("ring") <= core).select(key, F.col("tile_id").alias("target_id"), F.col("dx").alias("tx"), F.col("dy").alias("ty"))
    near = chebyshev(F.col("dx") - F.col("tx"), F.col("dy") - F.col("ty")) <= support
    return targets.join(local, key).groupBy(key, "target_id").agg(F.count("*").alias("n_members"), F.count_if(near).alias("n_support"), F.count_if(near & (F.col("ring") > core)).alias("n_halo"))
