"""Polygon joins (JN-12, JN-13, JN-24) and the grid points inside polygons (GEN-02), ring by ring.

A polygon is a set of parts, a part an outer ring and its holes, so parts may overlap. Rings are the unit: their boxes are dealt to a grid of
several levels, each ring to the level at which it covers four cells at most, and points ask at each level that occurs. A ring's edges
lie in as many slabs of equal height as keep an edge in three of them on average, and a point meets the edges of its own slab only,
so no task holds a whole outline. Slabs are salted, since one ring may hold most points.

Rows of rings: pid, part, ring (0 is the outer one), points (array of struct<x,y>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

EPS = 1e-9
BASE = 1 / 64


def from_parts(polygons: DataFrame, polygon_id: str, column: str = "parts") -> DataFrame:
    """Rings of a column of parts: an array of arrays of rings."""
    parts = polygons.select(F.col(polygon_id).alias("pid"), F.posexplode(column).alias("part", "rings"))
    return parts.select("pid", F.col("part").cast("string").alias("part"), F.posexplode("rings").alias("ring", "points"))


def from_geojson(polygons: DataFrame, polygon_id: str, geometry: str = "geometry", box: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Rings of geometries as JSON text: Polygon, MultiPolygon and collections of them at any depth; other kinds have none. Where the
    geometry is missing (null, empty or not an object), the box (west, south, east, north) counts, if it is given and known."""
    parsed = polygons.select(F.col(polygon_id).alias("pid"), F.try_parse_json(F.col(geometry).cast("string")).alias("v"), *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(box or ())])
    shape = F.coalesce(F.schema_of_variant("v"), F.lit(""))
    there = shape.startswith("OBJECT") & (shape != "OBJECT<>")
    level, found = parsed.where(there).select("pid", F.lit("").alias("path"), "v"), []
    while True:
        kind = F.try_variant_get("v", "$.type", "string")
        one = F.array(F.try_variant_get("v", "$.coordinates", "array<array<array<double>>>"))
        many = F.try_variant_get("v", "$.coordinates", "array<array<array<array<double>>>>")
        parts = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
        found.append(level.withColumn("parts", parts).select("pid", "path", F.posexplode("parts").alias("n", "rings")).select("pid", F.concat("path", F.lit("."), "n").alias("part"), F.posexplode("rings").alias("ring", "places")))
        inner = level.where(kind == "GeometryCollection").select("pid", "path", F.posexplode(F.try_variant_get("v", "$.geometries", "array<variant>")).alias("n", "v"))
        level = inner.select("pid", F.concat("path", F.lit("/"), "n").alias("path"), "v")
        if not level.take(1):
            break
    places = found[0]
    for df in found[1:]:
        places = places.union(df)
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    whole = F.filter("places", lambda p: F.coalesce(F.size(p) >= 2, F.lit(False)) & F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull())
    out = places.select("pid", "part", "ring", F.transform(whole, point).alias("points"))
    if box:
        corner = lambda x, y: F.struct(F.col(f"__{x}").alias("x"), F.col(f"__{y}").alias("y"))
        boxes = parsed.where(~F.coalesce(there, F.lit(False)) & F.col("__0").isNotNull() & F.col("__1").isNotNull() & F.col("__2").isNotNull() & F.col("__3").isNotNull())
        out = out.union(boxes.select("pid", F.lit("box").alias("part"), F.lit(0).alias("ring"), F.array(corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3), corner(0, 1)).alias("points")))
    return out


def edges_of(points: Column) -> Column:
    """A ring's edges as array<struct<x1,y1,x2,y2>>; it need not repeat its first point."""
    turned = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, F.lit(1), F.lit(1)))
    return F.zip_with(points, turned, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def on_edge(x: Column, y: Column, edges: Column, eps: float = EPS) -> Column:
    def near(e: Column) -> Column:
        cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        inside = (x >= F.least(e["x1"], e["x2"]) - eps) & (x <= F.greatest(e["x1"], e["x2"]) + eps) & (y >= F.least(e["y1"], e["y2"]) - eps) & (y <= F.greatest(e["y1"], e["y2"]) + eps)
        return (F.abs(cross) <= eps) & inside

    return F.exists(edges, near)


def odd_crossings(x: Column, y: Column, edges: Column) -> Column:
    """Ray casting: whether a ray to larger x crosses an odd number of edges."""

    def crossing(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return F.when(straddles & (x < at), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda n, e: n + crossing(e)) % 2 == 1


def _indexed(rings: DataFrame, least_points: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """(boxes, slabs): rid, pid, part, ring, box, level, cell and slab height; edges by (rid, slab, salt)."""
    flat = rings.where(F.size("points") >= least_points).withColumn("edges", edges_of(F.col("points")))
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    boxed = flat.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    rise = F.aggregate("edges", F.lit(0.0), lambda n, e: n + F.abs(e["y2"] - e["y1"]))
    room = F.size("edges") * 2 * (F.col("y1") - F.col("y0")) / F.nullif(rise, F.lit(0.0))
    boxed = boxed.withColumn("slabs", F.greatest(F.lit(1), F.least(F.floor(F.size("edges") / 8), F.floor(F.coalesce(room, F.lit(1.0))))).cast("int"))
    boxed = boxed.withColumn("height", F.greatest((F.col("y1") - F.col("y0")) / F.col("slabs"), F.lit(EPS))).withColumn("rid", F.monotonically_increasing_id())
    boxed = materialize(boxed.drop("points"), "rings")
    slab = lambda y: F.least(F.greatest(F.floor((y - F.col("y0")) / F.col("height")).cast("int"), F.lit(0)), F.col("slabs") - 1)
    edges = boxed.select("rid", "y0", "height", "slabs", F.explode("edges").alias("e"))
    low, high = F.least("e.y1", "e.y2") - EPS, F.greatest("e.y1", "e.y2") + EPS
    slabs = edges.select("rid", F.explode(F.sequence(slab(low), slab(high))).alias("slab"), "e").groupBy("rid", "slab").agg(F.collect_list("e").alias("edges"))
    slabs = slabs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return boxed.drop("edges"), slabs


def points_in_polygons(points: DataFrame, rings: DataFrame, key: str, strict: bool = False, salts: int = 8) -> DataFrame:
    """(key, pid) for each point (longitude, latitude) and each polygon that covers it; points on an outer edge are inside.

    strict (JN-13): a point on a hole's edge is in the hole, and rings of fewer than four points don't count. Else (JN-12) holes
    are open, and three points make a ring.
    """
    boxes, slabs = _indexed(rings, 4 if strict else 3, salts)
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(BASE))
    boxes = boxes.withColumn("level", F.ceil(F.log2(size / BASE)).cast("int"))
    levels = sorted(r[0] for r in boxes.select("level").distinct().collect())  # exponents of two: some dozens at most
    if not levels:
        return points.select(key, F.lit(None).alias("pid")).limit(0)
    wide = F.pow(F.lit(2.0), F.col("level")) * BASE
    spans = lambda a, b: F.sequence(F.floor((F.col(a) - EPS) / wide).cast("long"), F.floor((F.col(b) + EPS) / wide).cast("long"))
    dealt = boxes.withColumn("cx", F.explode(spans("x0", "x1"))).withColumn("cy", F.explode(spans("y0", "y1")))
    probe = points.where("longitude is not null and latitude is not null").select(F.col(key), F.col("longitude").cast("double").alias("px"), F.col("latitude").cast("double").alias("py"), F.explode(F.array(*[F.lit(n) for n in levels])).alias("level"))
    probe = probe.withColumns({"cx": F.floor(F.col("px") / wide).cast("long"), "cy": F.floor(F.col("py") / wide).cast("long")})
    near = (F.col("px") >= F.col("x0") - EPS) & (F.col("px") <= F.col("x1") + EPS) & (F.col("py") >= F.col("y0") - EPS) & (F.col("py") <= F.col("y1") + EPS)
    slab = F.least(F.greatest(F.floor((F.col("py") - F.col("y0")) / F.col("height")).cast("int"), F.lit(0)), F.col("slabs") - 1)
    met = probe.join(dealt, ["level", "cx", "cy"]).where(near).select(key, "px", "py", "rid", "pid", "part", "ring", slab.alias("slab"), F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt"))
    told = met.join(slabs, ["rid", "slab", "salt"]).select(key, "pid", "part", "ring", odd_crossings(F.col("px"), F.col("py"), F.col("edges")).alias("odd"), on_edge(F.col("px"), F.col("py"), F.col("edges")).alias("edge"))
    hole = F.col("odd") | F.col("edge") if strict else F.col("odd") & ~F.col("edge")
    parts = told.groupBy(key, "pid", "part").agg(F.max((F.col("ring") == 0) & (F.col("odd") | F.col("edge"))).alias("outer"), F.max((F.col("ring") > 0) & hole).alias("hole"))
    return parts.where("outer and not hole").select(key, "pid").distinct()


def polygon_attributes(points: DataFrame, polygons: DataFrame, key: str, polygon_id: str, attributes: list[str]) -> DataFrame:
    """JN-12: attributes of the polygon (smallest id) that covers each point; nulls for none. polygons: id, attributes, parts."""
    hits = points_in_polygons(points, from_parts(polygons, polygon_id), key)
    first = hits.groupBy(key).agg(F.min("pid").alias(polygon_id)).join(polygons.select(polygon_id, *attributes), polygon_id)
    return points.select(key).join(first.select(key, polygon_id, *attributes), key, "left")


def grid_points_inside(rings: DataFrame, spacing: float) -> DataFrame:
    """(pid, grid_x, grid_y): points of the grid of `spacing` inside or on each polygon, by scanlines: each edge crosses the grid rows between
    its ends, a row's crossings in order are the ends of its spans, and spans are exploded to columns. Nothing outside is made."""
    edges = rings.where(F.size("points") >= 3).select("pid", "part", F.explode(edges_of(F.col("points"))).alias("e")).select("pid", "part", "e.*")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    row = lambda y: F.ceil(y / spacing).cast("long")
    crossed = edges.where(row(high) > row(low)).withColumn("grid_y", F.explode(F.sequence(row(low), row(high) - 1)))
    x = F.col("x1") + (F.col("grid_y") * spacing - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    ordered = crossed.groupBy("pid", "part", "grid_y").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    spans = ordered.select("pid", "grid_y", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("a"), F.get("xs", 2 * i + 1).alias("b")))).alias("s")).select("pid", "grid_y", "s.*")
    # flat edges and tips on a grid row
    flat = F.round(F.col("y1") / spacing)
    level = edges.where((F.abs(F.col("y1") / spacing - flat) < EPS)).select("pid", flat.cast("long").alias("grid_y"), F.when(F.col("y1") == F.col("y2"), F.least("x1", "x2")).otherwise(F.col("x1")).alias("a"), F.when(F.col("y1") == F.col("y2"), F.greatest("x1", "x2")).otherwise(F.col("x1")).alias("b"))
    first, last = F.ceil(F.col("a") / spacing - EPS).cast("long"), F.floor(F.col("b") / spacing + EPS).cast("long")
    return spans.union(level).where(first <= last).withColumn("grid_x", F.explode(F.sequence(first, last))).select("pid", "grid_x", "grid_y").distinct()
