"""Nearest polyline in a projected plane (JN-14), whatever its distance."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

def segments_of(lines: DataFrame, column: str = "points") -> DataFrame:
    """x1, y1, x2, y2 of each pair of neighbours in an array of struct<x,y>; a line of one point is a segment of no length."""
    pairs = F.when(F.size(column) > 1, F.arrays_zip(F.slice(column, F.lit(1), F.size(column) - 1).alias("a"), F.slice(column, F.lit(2), F.size(column) - 1).alias("b"))).otherwise(F.arrays_zip(F.col(column).alias("a"), F.col(column).alias("b")))
    return lines.select(F.explode(pairs).alias("s")).select(F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point and a segment in the plane."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, ((x - x1) * dx + (y - y1) * dy) / F.nullif(size, F.lit(0.0))).otherwise(0.0)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def cells_along(segments: DataFrame, size: float) -> DataFrame:
    """Each segment once for each cell (cx, cy) that it touches: row by row the columns between its crossings, not its whole box."""
    cell = lambda v: F.floor(v / size).cast("long")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = segments.withColumn("cy", F.explode(F.sequence(cell(low), cell(high))))
    slope = (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    at = lambda y: F.col("x1") + slope * (F.least(F.greatest(y, low), high) - F.col("y1"))
    a, b = F.coalesce(at(F.col("cy") * size), F.col("x1")), F.coalesce(at((F.col("cy") + 1) * size), F.col("x2"))
    # rounding may put a crossing into the next cell
    return rows.withColumn("cx", F.explode(F.sequence(cell(F.least(a, b) - size * 1e-9), cell(F.greatest(a, b) + size * 1e-9))))


def nearest_line_km(points: DataFrame, segments: DataFrame, key: str, start_m: float | None = None) -> DataFrame:
    """JN-14: (key, line_km): distance in km of each point (x, y in metres) to the nearest segment (x1, y1, x2, y2), however far; null
    without a place or without segments.

    Segments lie in the cells along them of a grid; a point asks the 3 x 3 cells around it, and what is found within a cell's width is nearest.
    Points without such a hit ask again on a grid four times as wide, until the grid spans all. The first grid has about as many cells as there
    are segments, unless start_m says otherwise.
    """
    known = materialize(segments.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null").select("x1", "y1", "x2", "y2"), "segments")
    left = materialize(points.where("x is not null and y is not null").select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    box = lambda df, xs, ys: df.select(F.least(*xs).alias("a"), F.greatest(*xs).alias("b"), F.least(*ys).alias("c"), F.greatest(*ys).alias("d"))
    extent = lambda df: df.agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d"), F.count("*").alias("n"))
    (ends,), (places,) = (extent(box(df, xs, ys)).collect() for df, xs, ys in ((known, ("x1", "x2"), ("y1", "y2")), (left, ("x", "x"), ("y", "y"))))
    if not ends.n or not places.n:
        return points.select(key, F.lit(None).cast("double").alias("line_km"))
    span = max(max(ends.b, places.b) - min(ends.a, places.a), max(ends.d, places.d) - min(ends.c, places.c))
    size, done = start_m or max(span / sqrt(ends.n), 1.0), None
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    metres = segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    while True:
        around = left.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
        probe = around.withColumns({"cx": F.floor(F.col("x") / size) + F.col("dx"), "cy": F.floor(F.col("y") / size) + F.col("dy")})
        found = probe.join(cells_along(known, size), ["cx", "cy"]).groupBy(key).agg(F.min(metres).alias("m"))
        last = size >= 2 * span + 1
        met = found if last else found.where(F.col("m") <= size)
        left = materialize(left.join(met.select(key, (F.col("m") / 1000).alias("line_km")), key, "left"), "lines")
        told = left.where("line_km is not null").select(key, "line_km")
        done = told if done is None else done.unionByName(told)
        left = left.where("line_km is null").drop("line_km")
        if last or not left.take(1):
            return points.select(key).join(done, key, "left")
        size *= 4
