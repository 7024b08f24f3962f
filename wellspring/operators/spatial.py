"""Distance, containment and raster joins as equi joins on grid cells.

A distance join would be a nested loop. Here both sides get a cell key; the probe side is exploded to the cells that
its radius touches, the join is on the cell, and the exact predicate follows. Cells are as wide as the radius at
their band's latitude, cell numbers wrap at 180 degrees, and near the poles all longitudes are one cell.
"""

from __future__ import annotations

from math import degrees, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EARTH_KM, haversine_km


class Cells:
    """A grid for one radius: bands of latitude, each cut into as many columns as its distance from the equator allows."""

    def __init__(self, radius_km: float) -> None:
        self.reach = radius_km / EARTH_KM
        self.lat_step = degrees(self.reach) * 1.01 + 1e-9

    def y(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.lat_step).cast("long")

    def columns(self, y: Column) -> Column:
        """Columns of a band, each as wide as the radius at the latitude farthest from the equator in the band and the bands beside it; near the poles one."""
        farthest = F.least(F.greatest(F.abs((y - 1) * self.lat_step - 90), F.abs((y + 2) * self.lat_step - 90)), F.lit(90.0))
        room = F.lit(sin(self.reach)) / F.cos(F.radians(farthest))
        return F.when(room < 1, F.greatest(F.floor(360 / (F.degrees(F.asin(room)) * 1.01 + 1e-9)), F.lit(1))).otherwise(1).cast("long")

    def x(self, lon: Column, columns: Column) -> Column:
        return F.pmod(F.floor(F.pmod(lon + 180, F.lit(360.0)) * columns / 360), columns).cast("long")

    def around(self, df: DataFrame, lat: str, lon: str) -> DataFrame:
        """A row for each cell (cx, cy) that may hold neighbours; band and columns are computed once for each band."""
        steps = F.array(*[F.lit(e) for e in (-1, 0, 1)])
        bands = df.withColumn("__d", F.explode(steps)).withColumn("cy", self.y(F.col(lat)) + F.col("__d")).withColumn("__n", self.columns(F.col("cy"))).withColumn("__x", self.x(F.col(lon), F.col("__n")))
        return bands.withColumn("cx", F.explode(F.array_distinct(F.transform(steps, lambda e: F.pmod(F.col("__x") + e, F.col("__n")))))).drop("__d", "__n", "__x")


def within(targets: DataFrame, sources: DataFrame, key: str, radius_km: float, take: list[str], as_of: tuple[str, str] | None = None) -> DataFrame:
    """(key, km, s_<column> ...) for each target and each source within the radius (inclusive). Both have latitude, longitude.

    as_of: (target date, source date): only sources dated strictly before; a null on either side matches nothing.
    """
    cells = Cells(radius_km)
    dates = [F.col(as_of[0]).alias("t_date")] if as_of else []
    probe = cells.around(targets.where("latitude is not null and longitude is not null").select(F.col(key), F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"), *dates), "t_lat", "t_lon")
    names = list(dict.fromkeys([*take, *([as_of[1]] if as_of else [])]))
    build = sources.where("latitude is not null and longitude is not null").select(F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon"), *[F.col(c).alias(f"s_{c}") for c in names], cells.x(F.col("longitude"), cells.columns(cells.y(F.col("latitude")))).alias("cx"), cells.y(F.col("latitude")).alias("cy"))
    km = haversine_km(F.col("t_lat"), F.col("t_lon"), F.col("s_lat"), F.col("s_lon"))
    joined = probe.join(build, ["cx", "cy"]).withColumn("km", km).where(F.col("km") <= radius_km)
    if as_of:
        joined = joined.where(F.col(f"s_{as_of[1]}") < F.col("t_date"))
    return joined.select(key, "km", *[f"s_{c}" for c in names])


def first_reach(sources: DataFrame, start_km: float, most: int = 64, least_km: float = 1e-3) -> float:
    """start_km, or so small a quarter, sixteenth ... of it that no cell of that radius holds more than `most` sources (not below least_km)."""
    while start_km > least_km:
        cells = Cells(start_km)
        cy = cells.y(F.col("latitude"))
        if not sources.groupBy(cy.alias("cy"), cells.x(F.col("longitude"), cells.columns(cy)).alias("cx")).count().where(F.col("count") > most).take(1):
            break
        start_km /= 4
    return start_km


def nearest(targets: DataFrame, sources: DataFrame, key: str, source_key: str, attributes: list[str] = (), start_km: float = 5.0, most_km: float = 20_100.0) -> DataFrame:
    """JN-10: for each target its nearest source within most_km (ties to the smaller key) and its attributes. Rings are searched for the targets
    not yet resolved only, each four times as wide as the last; the first is so small that few sources lie in a cell of it. Of sources in one place
    the one with the smallest key counts. No ring needs more than half the globe."""
    from ..sources.scratch import materialize

    known, place = "latitude is not null and longitude is not null", ["latitude", "longitude"]
    left, done = targets.select(key, *place).where(known), None
    names = list(dict.fromkeys([source_key, *attributes]))
    sources = materialize(sources.where(known).groupBy(*place).agg(F.min_by(F.struct(*names), F.struct(source_key)).alias("b")).select(*place, "b.*"), "places")
    if not sources.take(1):
        empty = sources.limit(0).select(F.col(source_key).alias(f"near_{source_key}"), *[F.col(a).alias(f"near_{a}") for a in attributes], F.lit(None).cast("double").alias("near_km"))
        return targets.select(key).join(empty, F.lit(False), "left")
    radius = first_reach(sources, min(start_km, most_km))
    while True:
        found = within(left, sources, key, min(radius, most_km), names)
        best = found.groupBy(key).agg(F.min(F.struct("km", f"s_{source_key}", *[f"s_{c}" for c in names if c != source_key])).alias("b"))
        best = materialize(best.select(key, *[F.col(f"b.s_{c}").alias(f"near_{c}") for c in (source_key, *attributes)], F.col("b.km").alias("near_km")), "nearest")
        done = best if done is None else done.unionByName(best)
        left = materialize(left.join(best, key, "left_anti"), "unresolved")
        if radius >= most_km or not left.take(1):
            return targets.select(key).join(done, key, "left")
        radius *= 4


def repair_keys(foreign: DataFrame, official: DataFrame, key: str, official_key: str, cap_km: float = 2.0) -> DataFrame:
    """JN-11: (key, official key, km) of each foreign key whose nearest official well is within the cap; the rest drop out."""
    got = nearest(foreign, official, key, official_key, start_km=cap_km, most_km=cap_km).where("near_km is not null")
    return got.select(key, F.col(f"near_{official_key}").alias("official_key"), F.col("near_km").alias("km"))


def focal_stats(dem: DataFrame, dx_m: float, dy_m: float) -> DataFrame:
    """WIN-09: Horn slope (degrees; null if a neighbour is missing) and relief (largest minus smallest known height) of each
    3 x 3 neighbourhood. dem: tile, r, c, z. Each cell is sent to its nine neighbourhoods, then one grouped aggregation."""
    offsets = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    # a cell at (r, c) is the (dr, dc) neighbour of the centre (r - dr, c - dc)
    sent = dem.withColumn("o", F.explode(offsets)).select("tile", (F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), "o.dr", "o.dc", "z")
    at = lambda a, b: F.max(F.when((F.col("dr") == a) & (F.col("dc") == b), F.col("z")))
    z = {(a, b): at(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)}
    east = (z[-1, 1] + 2 * z[0, 1] + z[1, 1]) - (z[-1, -1] + 2 * z[0, -1] + z[1, -1])
    south = (z[1, -1] + 2 * z[1, 0] + z[1, 1]) - (z[-1, -1] + 2 * z[-1, 0] + z[-1, 1])
    got = sent.groupBy("tile", "r", "c").agg(z[0, 0].alias("elevation"), (east / (8 * dx_m)).alias("gx"), (south / (8 * dy_m)).alias("gy"), (F.max("z") - F.min("z")).alias("relief"))
    return got.where("elevation is not null").select("tile", "r", "c", "elevation", F.degrees(F.atan(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))).alias("slope_deg"), "relief")


def raster_at(points: DataFrame, tiles: DataFrame, raster: DataFrame, key: str, values: list[str], step: float = 1.0) -> DataFrame:
    """WIN-10: values of the raster cell under each point, from the first tile (by name) that holds it. tiles: tile, west, north,
    step_x, step_y, n_rows, n_cols: one row for each raster file, dealt to the cells of `step` degrees that it touches, so the join is on the cell."""
    cells = lambda a, b: F.sequence(F.floor(a / step).cast("long"), F.floor(b / step).cast("long"))
    east, south = F.col("west") + F.col("n_cols") * F.col("step_x"), F.col("north") - F.col("n_rows") * F.col("step_y")
    dealt = tiles.withColumn("cx", F.explode(cells(F.col("west"), east))).withColumn("cy", F.explode(cells(south, F.col("north"))))
    x = F.floor((F.col("longitude") - F.col("west")) / F.col("step_x")).cast("long")
    y = F.floor((F.col("north") - F.col("latitude")) / F.col("step_y")).cast("long")
    probe = points.select(key, "latitude", "longitude", F.floor(F.col("longitude") / step).cast("long").alias("cx"), F.floor(F.col("latitude") / step).cast("long").alias("cy"))
    inside = (F.col("longitude") >= F.col("west")) & (F.col("longitude") < east) & (F.col("latitude") <= F.col("north")) & (F.col("latitude") > south)
    placed = probe.join(dealt, ["cx", "cy"]).where(inside)
    first = placed.groupBy(key).agg(F.min_by(F.struct("tile", y.alias("r"), x.alias("c")), "tile").alias("t")).select(key, "t.*")
    return points.select(key).join(first.join(raster.select("tile", "r", "c", *values), ["tile", "r", "c"], "left"), key, "left")


def full_clusters(cells: DataFrame, key: str, radius: int) -> DataFrame:
    """JN-22: cells (grid_x, grid_y) whose whole (2 radius + 1)^2 neighbourhood exists."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    sent = cells.select("grid_x", "grid_y").distinct().withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span))
    counts = sent.groupBy((F.col("grid_x") + F.col("dx")).alias("grid_x"), (F.col("grid_y") + F.col("dy")).alias("grid_y")).count()
    full = counts.where(F.col("count") == (2 * radius + 1) ** 2).select("grid_x", "grid_y")
    return cells.join(full, ["grid_x", "grid_y"], "left_semi")


def away_from(cells: DataFrame, anchors: DataFrame, distance: int) -> DataFrame:
    """JN-23: cells farther than `distance` (Chebyshev) from every anchor."""
    span = F.sequence(F.lit(-distance), F.lit(distance))
    taken = anchors.select("grid_x", "grid_y").withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span)).select((F.col("grid_x") + F.col("dx")).alias("grid_x"), (F.col("grid_y") + F.col("dy")).alias("grid_y")).distinct()
    return cells.join(taken, ["grid_x", "grid_y"], "left_anti")


def first_per_cell(joined: DataFrame, order: list[str]) -> DataFrame:
    """JN-24: one row for each grid cell, the smallest by the order."""
    rank = F.row_number().over(Window.partitionBy("grid_x", "grid_y").orderBy(*order))
    return joined.withColumn("__r", rank).where("__r = 1").drop("__r")
