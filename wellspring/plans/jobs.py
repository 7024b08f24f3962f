"""Compositions: whole tables from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import projections
from ..operators import asof, life, lines, merging, polygons, sampling, spatial, summaries
from ..sources.scratch import materialize

#: Thresholds of the observed-gas labels.
OBSERVED_THRESHOLDS = (1_000, 10_000, 50_000, 100_000, 250_000, 500_000, 1_000_000)


def training_table_v0(wells: DataFrame, permits: DataFrame, production: DataFrame, geology: DataFrame, attributes: list[str]) -> DataFrame:
    """JOB-02: wells with permit and production aggregates, geology, status flags and observed-gas labels (null where not trainable)."""
    joined = wells.join(life.permit_summary(permits), "well_api", "left").join(life.production_summary(production).withColumn("has_production", F.lit(True)), "well_api", "left")
    joined = joined.join(polygons.polygon_attributes(wells, geology, "well_api", "objectid", attributes), "well_api", "left")
    flags = C.status_flags(F.col("well_status"), F.col("has_production"))
    table = joined.fillna(0, ["permit_count", "observed_rows"]).fillna(0.0, ["observed_gas", "observed_gas_avg", "observed_gas_max"]).fillna(False, ["has_production"]).withColumns(flags)
    labels = {"label_obs_gt_0": F.col("observed_gas") > 0} | {f"label_obs_ge_{t}": F.col("observed_gas") >= t for t in OBSERVED_THRESHOLDS}
    return table.withColumns({n: F.when(F.col("trainable_v0"), c) for n, c in labels.items()})


def basin_scope(wells: DataFrame, counties: list[str]) -> DataFrame:
    """FLT-01: unconventional wells with a place in the basin's counties (upper case)."""
    return wells.where(F.col("unconventional") & F.upper(F.trim("county_name")).isin(*counties) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def place_features(wells: DataFrame, terrain: tuple | None, faults: tuple | None) -> DataFrame:
    """well_api with elevation, slope_deg and relief of the raster cell under it (WIN-09, WIN-10), and fault_km (JN-14).
    terrain: (tiles, heights, cell width and height in metres); faults: (segments, x and y of a well in their projection)."""
    out = wells.select("well_api")
    if terrain:
        tiles, heights, dx, dy = terrain
        out = out.join(spatial.raster_at(wells, tiles, spatial.focal_stats(heights, dx, dy), "well_api", ["elevation", "slope_deg", "relief"]), "well_api", "left").drop("tile", "r", "c")
    if faults:
        segments, x, y = faults
        out = out.join(lines.nearest_line_km(wells.select("well_api", x.alias("x"), y.alias("y")), segments, "well_api").withColumnRenamed("line_km", "fault_km"), "well_api", "left")
    return out


def well_targets(wells: DataFrame, permits: DataFrame) -> DataFrame:
    """well_api, latitude, longitude and `at`, the context date: a credible spud date, else the first permit. Written once, since every as-of join asks with it."""
    first = permits.groupBy("well_api").agg(F.min("permit_issued_date").alias("first"))
    at = C.context_date(C.credible_spud(F.col("spud_date")), F.col("first"))
    return materialize(wells.select("well_api", "latitude", "longitude", "spud_date").join(first, "well_api", "left").select("well_api", "latitude", "longitude", at.alias("at")), "well-targets")


def _scoped(wells: DataFrame, permits: DataFrame, counties: list[str] | None) -> tuple[DataFrame, DataFrame]:
    if not counties:
        return wells, permits
    return basin_scope(wells, counties), permits.where(F.upper(F.trim("county_name")).isin(*counties))


def _v1(wells: DataFrame, permits: DataFrame, production: DataFrame, geology: DataFrame, attributes: list[str], targets: DataFrame, terrain: tuple | None, faults: tuple | None) -> DataFrame:
    """v1 of wells and permits in scope, around their targets."""
    table = training_table_v0(wells, permits, production, geology, attributes)
    near_wells = asof.neighbour_stats(targets, targets.withColumnRenamed("at", "since"), "well_api", [2, 5], 20, ("at", "since"))
    near_permits = asof.neighbour_stats(targets, permits.select("latitude", "longitude", "permit_issued_date"), "well_api", [2, 5], 20, ("at", "permit_issued_date"))
    near_wells, near_permits = (df.withColumnsRenamed({c: f"{kind}_{c}" for c in df.columns if c != "well_api"}) for kind, df in (("well", near_wells), ("permit", near_permits)))
    gap = F.datediff("observed_first_prod_date", "spud_date")
    like = F.coalesce(F.col("has_production") & gap.between(0, 180) & (F.col("observed_rows") >= 10), F.lit(False))
    out = table.join(targets.select("well_api", F.col("at").alias("context_date")), "well_api", "left")
    out = out.join(place_features(wells, terrain, faults), "well_api", "left") if terrain or faults else out
    return out.join(near_wells, "well_api", "left").join(near_permits, "well_api", "left").withColumn("label_f12_like_available", like)


def training_table_v1(wells: DataFrame, permits: DataFrame, production: DataFrame, geology: DataFrame, attributes: list[str], counties: list[str] | None = None, terrain: tuple | None = None, faults: tuple | None = None) -> DataFrame:
    """JOB-03: v0 of the basin's wells and permits with terrain, fault distance and as-of neighbour features among them, the newer trainable rule,
    and whether the label is like a first year's: first production 0 to 180 days after spud and at least 10 records."""
    wells, permits = _scoped(wells, permits, counties)
    return _v1(wells, permits, production, geology, attributes, well_targets(wells, permits), terrain, faults)


def training_table_v2(wells: DataFrame, permits: DataFrame, production: DataFrame, geology: DataFrame, attributes: list[str], counties: list[str] | None = None, terrain: tuple | None = None, faults: tuple | None = None) -> DataFrame:
    """JOB-04: v1 and true first-life labels and the value of mature neighbours, those whose first year is known and began before."""
    wells, permits = _scoped(wells, permits, counties)
    targets = well_targets(wells, permits)
    labels = materialize(life.day_prorated_labels(wells, production), "labels")
    mature = targets.select("well_api", "latitude", "longitude").join(labels.where("label_f12_available").select("well_api", F.col("first_prod_date").alias("mature_date"), "f12_gas"), "well_api")
    stats = asof.neighbour_stats(targets, mature, "well_api", [5, 10], 10, ("at", "mature_date"), "f12_gas")
    stats = stats.withColumnsRenamed({c: f"mature_{c}" for c in stats.columns if c != "well_api"})
    out = _v1(wells, permits, production, geology, attributes, targets, terrain, faults).join(labels, "well_api", "left").join(stats, "well_api", "left")
    return out.withColumns(C.threshold_labels(F.col("f12_gas"), F.col("label_f12_available"), "label_f12", C.F12_THRESHOLDS) | C.threshold_labels(F.col("f24_gas"), F.col("label_f24_available"), "label_f24", C.F24_THRESHOLDS))


def _cadence_labels(wells: DataFrame, production: DataFrame) -> DataFrame:
    """Month labels by the reporting cadence. Production is read once for both, and the labels are written once, since targets, sources and the table ask for them."""
    production = materialize(production.select("well_api", "period_start_date", "gas_quantity"), "production")
    need = life.cadence(production).first()
    return materialize(life.month_labels(wells, production, f12_periods=need.f12_periods, f24_periods=need.f24_periods), "labels")


def monthly_table(wells: DataFrame, production: DataFrame) -> DataFrame:
    """JOB-05: month labels with the reporting cadence's thresholds, and producing neighbours as of the first production."""
    labels = _cadence_labels(wells, production)
    producing = wells.select("well_api", "latitude", "longitude").join(labels.where("first_prod_date is not null").select("well_api", "first_prod_date"), "well_api")
    targets = producing.withColumnRenamed("first_prod_date", "at")
    return wells.join(labels, "well_api", "left").join(asof.neighbour_stats(targets, producing, "well_api", [2, 5], 20, ("at", "first_prod_date")), "well_api", "left")


def state_table(wells: DataFrame, permits: DataFrame, production: DataFrame, fallbacks: list[str], permit_date: str) -> DataFrame:
    """JOB-05: wells of a state with month labels by its reporting cadence, a context date (first production, else the first known of the fallback
    columns), as-of counts and nearest distances of wells and permits, and the first-year gas of mature neighbours, those with a label."""
    wells = wells.where("well_api is not null and latitude is not null and longitude is not null").dropDuplicates(["well_api"])
    labels = _cadence_labels(wells, production)
    at = C.context_date(F.col("first_prod_date"), *[F.col(c) for c in fallbacks])
    targets = materialize(wells.join(labels.select("well_api", "first_prod_date"), "well_api", "left").select("well_api", "latitude", "longitude", at.alias("at")), "well-targets")
    since = targets.withColumnRenamed("at", "since")
    mature = since.where("since is not null").join(labels.where("label_f12_available").select("well_api", "f12_gas"), "well_api")
    parts = {
        "well": asof.neighbour_stats(targets, since, "well_api", [2, 5], 20, ("at", "since")),
        "permit": asof.neighbour_stats(targets, permits.select("latitude", "longitude", F.col(permit_date).alias("since")), "well_api", [2, 5], 20, ("at", "since")),
        "mature": asof.neighbour_stats(targets, mature, "well_api", [5, 10], 10, ("at", "since"), "f12_gas"),
    }
    out = wells.join(labels, "well_api", "left").join(targets.select("well_api", F.col("at").alias("context_date")), "well_api", "left")
    for kind, df in parts.items():
        out = out.join(df.withColumnsRenamed({c: f"{kind}_{c}" for c in df.columns if c != "well_api"}), "well_api", "left")
    return out.withColumns(C.threshold_labels(F.col("f12_gas"), F.col("label_f12_available"), "label_f12", C.F12_THRESHOLDS) | C.threshold_labels(F.col("f24_gas"), F.col("label_f24_available"), "label_f24", C.F24_THRESHOLDS))


def prospect_cells(wells: DataFrame, geology: DataFrame, attributes: list[str], step: float, value: str, radius_km: float = 10.0) -> DataFrame:
    """JOB-06: grid cells near wells with current neighbours' values, geology and a percentile and tier by their median."""
    from ..operators.ranking import average_rank_percentile

    cells = summaries.occupied_cells(wells, step).select(F.concat_ws("_", F.col("cx").cast("string"), F.col("cy").cast("string")).alias("cell_id"), ((F.col("cx") + 0.5) * step).alias("longitude"), ((F.col("cy") + 0.5) * step).alias("latitude"))
    stats = asof.neighbour_stats(cells, wells, "cell_id", [radius_km], radius_km, value=value)
    table = cells.join(stats, "cell_id").join(polygons.polygon_attributes(cells, geology, "cell_id", "objectid", attributes), "cell_id", "left")
    scored = average_rank_percentile(table.withColumn("score", F.col(f"median_{radius_km:g}km")), "score", "score_percentile")
    return scored.withColumn("prospect_tier", F.when(F.col("score_percentile").isNotNull(), C.tier(F.col("score_percentile"))))


def prospect_surface(wells: DataFrame, geology: DataFrame, attributes: list[str], step: float, most_km: float, score: Column) -> DataFrame:
    """JOB-06, the surface over the wells' extent: grid cells with a well within `most_km`, the nearest well's place and distance (ties to the
    smaller well_api), geology, and score, percentile and tier; `score` is an expression of these columns."""
    from ..operators.ranking import average_rank_percentile

    cells = summaries.degree_grid(wells, step, 0.0).select(F.concat_ws("_", F.col("cx").cast("string"), F.col("cy").cast("string")).alias("cell_id"), ((F.col("cx") + 0.5) * step).alias("longitude"), ((F.col("cy") + 0.5) * step).alias("latitude"))
    best = spatial.nearest(cells, wells, "cell_id", "well_api", ["county_name"], most_km, most_km).where("near_km is not null")
    near = best.select("cell_id", F.col("near_well_api").alias("nearest_well_api"), F.col("near_county_name").alias("county_name"), F.col("near_km").alias("nearest_well_distance_km"))
    table = cells.join(near, "cell_id").join(polygons.polygon_attributes(cells, geology, "cell_id", "objectid", attributes), "cell_id", "left")
    scored = average_rank_percentile(table.withColumn("score", score), "score", "score_percentile")
    return scored.withColumn("prospect_tier", F.when(F.col("score_percentile").isNotNull(), C.tier(F.col("score_percentile"))))


def feature_surface(wells: DataFrame, permits: DataFrame, geology: DataFrame, attributes: list[str], step: float, most_km: float, pad: float, score, terrain: tuple | None = None, faults: tuple | None = None) -> DataFrame:
    """JOB-06, the surface by features: grid cells with a well within `most_km`, each with bounds, the nearest well's county, geology, terrain, fault
    distance, and current counts and nearest distances of wells and permits; then score, percentile, tier and rank.

    score: takes the table of cells and gives it with a column `score`, as a fitted model's `predict` does. faults: (segments, projection of latitude and longitude).
    """
    from ..operators.ranking import average_rank_percentile, number_rows

    grid = summaries.degree_grid(wells, step, pad)
    cells = grid.select(F.concat_ws("_", F.col("cx").cast("string"), F.col("cy").cast("string")).alias("cell_id"), "min_lon", "min_lat", "max_lon", "max_lat", ((F.col("cx") + 0.5) * step).alias("longitude"), ((F.col("cy") + 0.5) * step).alias("latitude"))
    best = spatial.nearest(cells, wells, "cell_id", "well_api", ["county_name"], most_km, most_km).where("near_km is not null").select("cell_id", F.col("near_county_name").alias("county_name"))
    cells = materialize(cells.join(best, "cell_id"), "cells")
    places = cells.select("cell_id", "latitude", "longitude")
    table = cells.join(polygons.polygon_attributes(places, geology, "cell_id", "objectid", attributes), "cell_id", "left")
    for kind, df in (("well", wells), ("permit", permits)):
        near = asof.neighbour_stats(places, df, "cell_id", [2, 5], 20)
        table = table.join(near.withColumnsRenamed({c: f"{kind}_{c}" for c in near.columns if c != "cell_id"}), "cell_id", "left")
    if terrain or faults:
        segments, projection = faults if faults else (None, None)
        x, y = projection(F.col("latitude"), F.col("longitude")) if faults else (None, None)
        near = place_features(places.withColumnRenamed("cell_id", "well_api"), terrain, (segments, x, y) if faults else None)
        table = table.join(near.withColumnRenamed("well_api", "cell_id"), "cell_id", "left")
    scored = average_rank_percentile(materialize(score(table), "scored"), "score", "score_percentile")
    tiered = scored.withColumn("prospect_tier", F.when(F.col("score_percentile").isNotNull(), C.tier(F.col("score_percentile"))))
    return number_rows(tiered, [F.desc("score"), F.col("well_nearest_km").asc_nulls_last(), F.col("cell_id")], "score_rank")


def unified_table(regions: dict[str, tuple[DataFrame | None, dict[str, str], dict[str, str]]]) -> tuple[DataFrame, list[str]]:
    """JOB-07: region -> (table, renames, constants), aligned and united; regions without a table are named."""
    return merging.union_regions({r: merging.align(df, renames, region_id=r, **constants) if df is not None else None for r, (df, renames, constants) in regions.items()})


def cohort(unified: DataFrame, target: str, available: str, most_per_region: int, cutoff: str) -> DataFrame:
    """JOB-08: rows with place, date and target, capped for each region, split by date."""
    usable = unified.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("context_date").isNotNull() & F.col(target).isNotNull() & F.coalesce(F.col(available), F.lit(False)))
    capped = sampling.cap_per_group(usable, "region_id", "well_api", most_per_region)
    return sampling.split_by_date(capped.withColumn("sample_id", C.sample_key("well", F.col("well_api"))), "context_date", cutoff)


def daily_benchmark(sources: dict[str, DataFrame], required: list[str], column: str, horizons: list[int]) -> DataFrame:
    """JOB-09: merged daily sources with future values of the first one, rows that have all required sources."""
    merged = merging.merge_sources(sources).where(life.all_present([f"has_{s}" for s in required]))
    return merging.future_targets(merged, next(iter(sources.values())), column, horizons)


def centres(regions: DataFrame, anchors: int, isolated: int, separation: int, radius: int, equal_share: float = 0.5) -> DataFrame:
    """JOB-11: `anchors` cells with whole neighbourhoods by bucket quota and minimum separation, then `isolated` centres farther than
    `separation` from them, by quota and top-up."""
    first = sampling.quota_anchors(spatial.full_clusters(regions, "region_id", radius), "bucket_id", "region_id", anchors, separation, equal_share)
    rest = sampling.isolated_centres(spatial.away_from(regions, first, separation), "bucket_id", "region_id", isolated, equal_share)
    return first.select("region_id", "bucket_id", F.lit("anchor").alias("kind")).unionByName(rest.select("region_id", "bucket_id", F.lit("isolated").alias("kind")))


def candidate_regions(land: DataFrame, spacing_m: float, side_m: float, target: int, equal_share: float, band: float, prefix: str, standard: float = 30.0) -> DataFrame:
    """JOB-11: regions drawn by bucket (continent and latitude band) from the equal-area grid points on land, with their boxes.

    land: land_id, continent_bucket, country_bucket and parts in longitude and latitude. Of the polygons on a grid point the first by continent
    and country counts. Grid points are made inside polygons only.
    """
    place = lambda p: F.struct(*[c.alias(n) for c, n in zip(projections.equal_area(p["y"], p["x"], standard), "xy", strict=True)])
    rings = polygons.from_parts(land, "land_id").withColumn("points", F.transform("points", place))
    inside = polygons.grid_points_inside(rings, spacing_m).join(land.select(F.col("land_id").alias("pid"), "continent_bucket", "country_bucket"), "pid")
    first = inside.groupBy("grid_x", "grid_y").agg(F.min(F.struct("continent_bucket", "country_bucket")).alias("b")).select("grid_x", "grid_y", "b.*")
    x, y = F.col("grid_x") * spacing_m, F.col("grid_y") * spacing_m
    lat, lon = projections.equal_area_inverse(x, y, standard)
    centres_ = first.withColumns({"center_latitude": lat, "center_longitude": lon}).withColumn("latitude_band", C.latitude_band(F.col("center_latitude"), band))
    named = centres_.withColumns({"bucket_id": F.concat("continent_bucket", F.lit("__"), "latitude_band"), "region_id": C.region_id(prefix, round(spacing_m / 1000), F.col("grid_x"), F.col("grid_y"))})
    chosen = sampling.quota_sample(materialize(named, "candidates"), "bucket_id", "region_id", target, equal_share, "region")
    (south, west), (north, east) = (projections.equal_area_inverse(x + d, y + d, standard) for d in (-side_m / 2, side_m / 2))
    return chosen.withColumns({"min_lon": west, "min_lat": south, "max_lon": east, "max_lat": north})


def canonical_tables(wells: DataFrame, permits: DataFrame, production: DataFrame) -> dict[str, DataFrame]:
    """JOB-01: typed wells, permits and production from raw columns of one state."""
    clean = wells.select(C.well_id(F.col("well_api")).alias("well_api"), F.initcap(F.trim("county_name")).alias("county_name"), C.number(F.col("latitude")).alias("latitude"), C.number(F.col("longitude")).alias("longitude"), F.trim("well_status").alias("well_status"), C.credible_spud(F.col("spud_date")).alias("spud_date"))
    scoped = production.select(C.well_id(F.col("permit_num")).alias("well_api"), F.col("production_period_start_date").alias("period_start_date"), C.number(F.col("gas_quantity")).alias("gas_quantity"), "production_scope")
    return {"wells": clean.where("well_api is not null"), "permits": permits.where("authorization_id is not null"), "production": scoped.where("well_api is not null")}


#: Columns of two states' well features and of lateral features, by their canonical names; which of them are numbers or days.
WV_FIELDS = {"api": "well_api", "permitid": "permit_id", "respparty": "operator_name", "welltype": "well_type", "welluse": "well_use", "welldepth": "well_depth_class", "wellrig": "well_rig_class", "permittype": "permit_type", "issuedate": "permit_issued_date", "compdate": "completion_date", "wellstatus": "well_status", "farmname": "farm_name", "wellnumber": "well_number", "recdate": "record_date", "formation": "formation_name"}
LATERAL_FIELDS = WV_FIELDS | {"st_length_shape": "shape_length_m"}
OH_FIELDS = {"api_wellno": "well_api", "wl_cnty": "county_name", "wl_twp": "township_name", "slant": "well_type", "wl_status_desc": "well_status", "mapsymbol_desc": "map_symbol", "co_name": "operator_name", "proposedformation": "proposed_formation", "producingformation1": "formation_name", "producingformation2": "formation_name_2", "wh_lat": "wh_latitude", "wh_long": "wh_longitude", "well_nm": "well_name", "well_no": "well_number", "utica_shale": "utica_flag", "marcellus_shale": "marcellus_flag", "status_reas": "status_reason"}
FEATURE_NUMBERS = ("longitude", "latitude", "wellx", "welly", "objectid", "pkey", "surface_x", "surface_y", "landing_x", "landing_y", "bottom_x", "bottom_y", "shape_length_m")
FEATURE_DAYS = ("permit_issued_date", "spud_date", "completion_date", "record_date")
PERMIT_STATUSES = ("Permit Issued", "Permit Application")


def state_features(features: DataFrame, fields: dict[str, str]) -> DataFrame:
    """JOB-01: wells or laterals of a state from its features (`readers.read_features`): canonical names, lenient numbers and days (ISO text); other columns stay."""
    named = features.withColumnsRenamed({k: v for k, v in fields.items() if k in features.columns})
    return named.withColumns({c: C.number(F.col(c)) for c in FEATURE_NUMBERS if c in named.columns} | {c: C.to_day(F.col(c).cast("string")).cast("string") for c in FEATURE_DAYS if c in named.columns})


def state_permits(wells: DataFrame, statuses: tuple[str, ...] | None = PERMIT_STATUSES) -> DataFrame:
    """JOB-01: the wells whose status is one of the given, or names a permit where none are given (case doesn't matter then)."""
    known = F.col("well_status").isin(*statuses) if statuses else F.upper(F.col("well_status").cast("string")).contains("PERMIT")
    return wells.where(F.coalesce(known, F.lit(False)))


def map_view(points: DataFrame, scenes: DataFrame, layers: dict[str, DataFrame], scored: DataFrame, box: tuple[float, float, float, float], limit: int, top: int) -> DataFrame:
    """JOB-13: what a map window shows: (layer, id, place, truncated): points inside it, scenes and layers' boxes that touch it, at most
    `limit` of each by id, and the `top` prospects by score. points, scenes and layers have id; scored has id and score."""
    found = {"points": summaries.window_query(points, *box, limit, ["id"]), "scenes": summaries.window_query(scenes, *box, limit, ["id"], boxes=True)}
    found |= {name: summaries.window_query(df, *box, limit, ["id"], boxes=True, layer=True) for name, df in layers.items()}
    best = scored.orderBy(F.desc("score"), "id").limit(top).withColumn("truncated", F.lit(False))
    rows = [df.select(F.lit(name).alias("layer"), F.col("id").cast("string").alias("id"), "truncated") for name, df in {**found, "prospects": best}.items()]
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out


def observation_plan(locations: DataFrame, optical: DataFrame, radar: DataFrame, cadence: int, k: int, bins: int) -> tuple[DataFrame, DataFrame]:
    """JOB-10: (plan, coverage): for each location and time bin whether it has optical and radar scenes, with the shortlists; and the summary of each location and year."""
    from ..operators import observations

    keys = ["sample_id", "year", "bin"]
    sides = {n: observations.scene_shortlists(locations, s, cadence, k, optical=n == "s2").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "scene_id"))).alias(n)) for n, s in (("s2", optical), ("s1", radar))}
    plan = sides["s2"].join(sides["s1"], keys, "full").withColumns({"has_s2": F.col("s2").isNotNull(), "has_s1": F.col("s1").isNotNull()})
    return plan, observations.coverage(plan.withColumn("sequence_id", F.concat_ws("__year_", "sample_id", F.col("year").cast("string"))), "sequence_id", bins)


def regional_manifest(centres: DataFrame, key: str, radius: int, spacing_m: float, core: int, support: int, seed: str = "tiles") -> tuple[DataFrame, DataFrame]:
    """JOB-12: (tiles with their centre's split, training windows)."""
    from ..operators import observations

    tiles = observations.tile_manifest(centres, key, radius, spacing_m).withColumn("split", sampling.hash_split(F.col(key), seed, 0.8, 0.1))
    return tiles, observations.training_windows(tiles, key, core, support)
