"""Operators on tiny tables: nulls, ties, borders, and equality with brute force."""

import json
import random
from datetime import date
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from wellspring.functions import columns as C
from wellspring.functions import projections
from wellspring.plans import jobs
from wellspring.operators import asof, counting, life, lines, merging, metrics, models, observations, polygons, ranking, sampling, spatial, summaries


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def haversine(a, b):
    x, y = sin(radians(b[0] - a[0]) / 2), sin(radians(b[1] - a[1]) / 2)
    return 2 * C.EARTH_KM * asin(min(1, sqrt(x * x + cos(radians(a[0])) * cos(radians(b[0])) * y * y)))


def test_snake_name():
    assert [C.snake_name(x) for x in (" WellAPI Number ", "SurfLat/Lon", "a__B", "Year 1")] == ["well_api_number", "surf_lat_lon", "a_b", "year_1"]


def test_lenient_columns(spark):
    df = spark.createDataFrame([("Yes", "2020-02-30", "x", "7"), (None, "7/4/2019", "12.5", "1234"), (" 0", "2020-01-02", "", "007")], "a string, d string, n string, c string")
    got = df.select(C.to_bool(F.col("a")), C.to_day(F.col("d")).cast("string"), C.number(F.col("n")), C.county_code(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(True, None, None, "007"), (None, "2019-07-04", 12.5, "1234"), (False, "2020-01-02", None, "007")]


def test_threshold_label_is_null_when_unavailable(spark):
    df = spark.createDataFrame([(5.0, True), (None, True), (500.0, False), (500.0, None)], "v double, a boolean")
    got = df.select(*[c.alias(n) for n, c in C.threshold_labels(F.col("v"), F.col("a"), "f", [10]).items()]).collect()
    assert [r[0] for r in got] == [False, False, None, None]


@pytest.mark.parametrize(("lat0", "lon0", "spread"), [(40, -80, 0.3), (0, 179.95, 0.4), (84, 10, 3), (-60, -179.9, 0.5)])
def test_radius_join_equals_brute_force(spark, lat0, lon0, spread):
    rng = random.Random(lat0)
    points = [(i, lat0 + rng.uniform(-spread, spread), (lon0 + rng.uniform(-spread, spread) + 180) % 360 - 180, date(2000, 1, 1 + rng.randint(0, 20))) for i in range(150)]
    df = spark.createDataFrame([*points, (900, None, 1.0, None)], "k long, latitude double, longitude double, day date")
    got = {r.k: r for r in asof.neighbour_stats(df, df, "k", [5, 20], 20, ("day", "day"), "k").collect()}
    for k, lat, lon, day in points:
        near = sorted((haversine((lat, lon), p[1:3]), p[0]) for p in points if p[3] < day)
        within = [x for x in near if x[0] <= 20]
        assert got[k]["count_5km"] == sum(d <= 5 for d, _ in near)
        assert got[k]["count_20km"] == len(within)
        assert got[k]["nearest_km"] == (pytest.approx(within[0][0]) if within else None)
    assert (got[900]["count_5km"], got[900]["nearest_km"], got[900]["median_5km"]) == (0, None, None)
    plan = asof.neighbour_stats(df, df, "k", [5], 20)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("lat0", "lon0", "as_of", "gap", "radii"), [(0, 179.99, ("day", "day"), None, [2, 20]), (83, 10, None, 1e-6, [5])])
def test_dense_places_equal_brute_force(spark, monkeypatch, lat0, lon0, as_of, gap, radii):
    """Half of all points in one spot, others around it: time tables, halved tiles and widening searches, with small limits."""
    rng = random.Random(7)
    spreads = [0.002] * 90 + [0.02] * 40 + [0.3] * 60
    points = [(i, lat0 + rng.gauss(0, s), (lon0 + rng.gauss(0, s) + 180) % 360 - 180, date(2000, 1, rng.randint(1, 28)) if i % 17 else None) for i, s in enumerate(spreads)] + [(500, lat0 * 1.0, lon0 * 1.0, date(2000, 1, 15))] * 1 + [(501, lat0 * 1.0, lon0 * 1.0, date(2000, 1, 20))]
    df = spark.createDataFrame([*points, (900, None, 1.0, None)], "k long, latitude double, longitude double, day date")
    monkeypatch.setattr(asof, "MOST_LEVELS", 3)
    got = {r.k: r for r in asof.neighbour_stats(df, df, "k", radii, 20, as_of, self_gap=gap, dense=30, chunk=40).collect()}
    assert len(got) == len(points) + 1
    for k, lat, lon, day in points:
        near = [haversine((lat, lon), p[1:3]) for p in points if as_of is None or (p[3] is not None and day is not None and p[3] < day)]
        near = sorted(x for x in near if gap is None or x > gap)
        assert [got[k][f"count_{r}km"] for r in radii] == [sum(x <= r for x in near) for r in radii]
        assert got[k]["nearest_km"] == (pytest.approx(near[0]) if near and near[0] <= 20 else None)


def test_no_task_of_a_dense_spot_stands_out(spark):
    """Rows that each group gets: targets in chunks, sources of a tile's border only, whole tiles as time tables."""
    df = spark.range(4000).selectExpr("id as k", "40 + pmod(id * 7919, 1000) / 1e5 * (case when id % 2 = 0 then 1 else 300 end) as latitude", "-80 + pmod(id * 104729, 1000) / 1e5 * (case when id % 2 = 0 then 1 else 300 end) as longitude", "date_add(date'2000-01-01', cast(id % 365 as int)) as day")
    sent = []
    real = asof._met

    def spied(targets, there, function, chunk):
        sent.append((targets.groupBy("band", "column").count().agg(F.max("count")).first()[0], there.groupBy("band", "column").count().agg(F.max("count")).first()[0]))
        return real(targets, there, function, chunk)

    asof._met = spied
    try:
        got = asof.neighbour_stats(df, df, "k", [20], 20, ("day", "day"), dense=500, chunk=200)
        total = got.agg(F.sum("count_20km")).first()[0]
    finally:
        asof._met = real
    assert total > 2_000_000  # pairs within reach, none of them a row
    assert max(s[1] or 0 for s in sent) < 2500


def test_raster_values_by_cell(spark):
    tiles = spark.createDataFrame([("a", -81.0, 41.0, 0.5, 0.5, 4, 4), ("b", -80.0, 41.0, 0.5, 0.5, 4, 4)], "tile string, west double, north double, step_x double, step_y double, n_rows int, n_cols int")
    raster = spark.createDataFrame([(t, r, c, float(10 * r + c + (100 if t == "b" else 0))) for t in "ab" for r in range(4) for c in range(4)], "tile string, r long, c long, z double")
    points = spark.createDataFrame([(1, 40.9, -80.9), (2, 40.9, -79.9), (3, 40.1, -78.6), (4, 50.0, 0.0), (5, 41.0, -81.0), (6, None, None)], "k long, latitude double, longitude double")
    got = spatial.raster_at(points, tiles, raster, "k", ["z"])
    # where tiles overlap the first by name counts
    assert {r.k: r.z for r in got.collect()} == {1: 0.0, 2: 2.0, 3: 112.0, 4: None, 5: 0.0, 6: None}
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_is_unbounded_and_breaks_ties(spark):
    targets = spark.createDataFrame([(1, 40.0, -80.0), (2, -30.0, 120.0), (3, None, 5.0)], "k long, latitude double, longitude double")
    sources = spark.createDataFrame([(7, 40.0, -79.9, "b"), (6, 40.0, -80.1, "a"), (8, 10.0, 10.0, "c")], "s long, latitude double, longitude double, name string")
    got = {r.k: r.near_s for r in spatial.nearest(targets, sources, "k", "s", ["name"]).collect()}
    assert got[1] == 6 and got[2] == 8 and got[3] is None
    assert spatial.nearest(targets, sources.limit(0), "k", "s").count() == 3


def test_polygons_edges_holes_parts(spark):
    def ring(*p):
        return [{"x": float(x), "y": float(y)} for x, y in p]

    outer, hole, part = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (3, 1), (3, 3), (1, 3)), ring((10, 0), (11, 0), (11, 1))
    shapes = spark.createDataFrame([(2, "big", [[outer, hole], [part]]), (1, "first", [[ring((3.5, 3.5), (6, 3.5), (6, 6), (3.5, 6))]])], "id long, name string, parts array<array<array<struct<x:double,y:double>>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 0.0, 2.0), (4, 4.0, 4.0), (5, 10.5, 0.4), (6, 9.0, 9.0), (7, 1.0, 2.0)], "k long, longitude double, latitude double")
    got = {r.k: r.name for r in polygons.polygon_attributes(points, shapes, "k", "id", ["name"]).collect()}
    assert got == {1: "big", 2: None, 3: "big", 4: "first", 5: "big", 6: None, 7: "big"}


def test_line_distance(spark):
    points = spark.createDataFrame([(1, 0.0, 3.0), (2, -4.0, -3.0), (3, 500.0, 0.0), (4, None, 1.0)], "k long, x double, y double")
    ends = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0), (2.0, 2.0, 2.0, 2.0)], "x1 double, y1 double, x2 double, y2 double")
    got = {r.k: r.line_km for r in lines.nearest_line_km(points, ends, "k", 50.0).collect()}
    assert got[1] == pytest.approx(sqrt(5) / 1000) and got[2] == pytest.approx(0.005) and got[3] == pytest.approx(0.49) and got[4] is None
    assert [r.line_km for r in lines.nearest_line_km(points, ends.limit(0), "k").collect()] == [None] * 4


def test_nearest_lines_equal_brute_force(spark):
    rng = random.Random(5)
    ends = [tuple(rng.uniform(-1e5, 1e5) for _ in range(4)) for _ in range(30)] + [(0.0, 0.0, 2e5, 0.0), (5e4, -1e5, 5e4, 1e5)]
    places = [(i, rng.uniform(-4e5, 4e5), rng.uniform(-4e5, 4e5)) for i in range(60)]

    def distance(x, y, x1, y1, x2, y2):
        t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2)

    segments = spark.createDataFrame(ends, "x1 double, y1 double, x2 double, y2 double")
    got = {r.k: r.line_km for r in lines.nearest_line_km(spark.createDataFrame(places, "k long, x double, y double"), segments, "k", 3000.0).collect()}
    for k, x, y in places:
        assert got[k] == pytest.approx(min(distance(x, y, *e) for e in ends) / 1000)
    # a long diagonal lies in the cells along it, not in those of its box
    assert lines.cells_along(spark.createDataFrame([(0.0, 0.0, 1e5, 9e4)], "x1 double, y1 double, x2 double, y2 double"), 1000.0).count() < 300


def test_projections(spark):
    """Known coordinates: Clarke 1866, parallels 33 and 45, origin 23 N 96 W; and the equal-area projection's inverse."""
    df = spark.createDataFrame([(35.0, -75.0)], "lat double, lon double")
    x, y = df.select(*projections.lambert_conic(F.col("lat"), F.col("lon"), 33, 45, 23, -96, "clarke1866")).first()
    assert (x, y) == (pytest.approx(1894410.9, abs=0.1), pytest.approx(1564649.5, abs=0.1))
    east, north = projections.equal_area(F.col("lat"), F.col("lon"))
    assert tuple(df.select(*projections.equal_area_inverse(east, north)).first()) == (pytest.approx(35.0), pytest.approx(-75.0))


def contains(geometry, x, y, box):
    """Membership by the rules of scene footprints, in plain Python."""

    def ring(points):
        if len(points) < 4:
            return False
        odd = False
        for (x1, y1), (x2, y2) in zip(points, points[1:], strict=False):
            if abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) <= 1e-9 and min(x1, x2) - 1e-9 <= x <= max(x1, x2) + 1e-9 and min(y1, y2) - 1e-9 <= y <= max(y1, y2) + 1e-9:
                return True
            odd ^= (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        return odd

    def part(rings):
        return bool(rings) and ring(rings[0]) and not any(ring(h) for h in rings[1:])

    if not geometry:
        return box is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3]
    kind = geometry.get("type")
    if kind == "Polygon":
        return part(geometry["coordinates"])
    if kind == "MultiPolygon":
        return any(part(p) for p in geometry["coordinates"])
    return kind == "GeometryCollection" and any(contains(g, x, y, None) for g in geometry["geometries"] if g)


def test_footprints_equal_plain_rules(spark):
    rng = random.Random(11)

    def star(cx, cy, r, n):
        points = [[cx + r * rng.uniform(0.3, 1) * cos(2 * 3.14159265 * i / n), cy + r * rng.uniform(0.3, 1) * sin(2 * 3.14159265 * i / n)] for i in range(n)]
        return [*points, points[0]]

    square = lambda a, b, s: [[a, b], [a + s, b], [a + s, b + s], [a, b + s], [a, b]]
    shapes = [
        {"type": "Polygon", "coordinates": [square(0, 0, 8), square(2, 2, 4), square(3, 3, 4)]},  # overlapping holes
        {"type": "MultiPolygon", "coordinates": [[square(0, 0, 5)], [square(3, 3, 5)], [square(1, 1, 1), square(1.2, 1.2, 0.2)]]},  # overlapping parts
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [square(-3, -3, 4)]}, {"type": "MultiPolygon", "coordinates": [[star(5, 5, 3, 200)]]}]}]},
        {"type": "Polygon", "coordinates": [star(4, 4, 6, 400), star(4, 4, 1, 50)]}, {"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [0, 0]]]}, {"type": "Polygon", "coordinates": []}, {"type": "LineString", "coordinates": [[0, 0], [9, 9]]}, {}, None, None,
        {"type": "Polygon", "coordinates": [[[x, (9 if x % 2 else 0)] for x in range(9)] + [[9, -1], [0, -1], [0, 0]]]},  # a comb
    ]
    boxes = [None if i == 9 else (-1.0, -1.0, 3.0, 3.5) for i in range(len(shapes))]
    rows_ = [(i, None if g is None else json.dumps(g), *(b or (None,) * 4)) for i, (g, b) in enumerate(zip(shapes, boxes, strict=True))] + [(99, "not json", -1.0, -1.0, 3.0, 3.5)]
    places = [(i, rng.choice([rng.uniform(-4, 10), float(rng.randint(-4, 10))]), rng.choice([rng.uniform(-4, 10), float(rng.randint(-4, 10))])) for i in range(400)] + [(900, None, 1.0)]
    given = spark.createDataFrame(rows_, "id long, geometry string, w double, s double, e double, n double")
    rings = polygons.from_geojson(given, "id", box=("w", "s", "e", "n"))
    got = {tuple(r) for r in polygons.points_in_polygons(spark.createDataFrame(places, "k long, longitude double, latitude double"), rings, "k", strict=True).collect()}
    want = {(k, i) for k, x, y in places if x is not None for i, (g, b) in enumerate(zip([*shapes, None], [*boxes, (-1.0, -1.0, 3.0, 3.5)], strict=True)) if contains(g, x, y, b)}
    assert got == {(k, 99 if i == len(shapes) else i) for k, i in want}


def test_grid_points_inside_equal_ray_casting(spark):
    rng = random.Random(2)
    shape = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    star = shape(*[(10 + 9 * rng.uniform(0.4, 1) * cos(i / 10), 10 + 9 * rng.uniform(0.4, 1) * sin(i / 10)) for i in range(62)])
    parts = [[[shape((0, 0), (6, 0), (6, 6), (0, 6)), shape((2, 2), (4, 2), (4, 4), (2, 4))]], [[star]], [[shape((0, 8), (3, 8), (1.5, 11))], [shape((1, 8), (5, 8), (5, 9))]], [[shape((30, 30), (30.2, 30), (30.1, 30.2))]]]
    rings = polygons.from_parts(spark.createDataFrame(list(enumerate(parts)), "id long, parts array<array<array<struct<x:double,y:double>>>>"), "id")
    got = {tuple(r) for r in polygons.grid_points_inside(rings, 0.5).collect()}
    grid = spark.range(-10, 80).select(F.col("id").alias("gx"), F.explode(F.sequence(F.lit(-10), F.lit(80)).cast("array<long>")).alias("gy")).select(F.struct("gx", "gy").alias("k"), (F.col("gx") * 0.5).alias("longitude"), (F.col("gy") * 0.5).alias("latitude"))
    want = {(r.pid, r.k.gx, r.k.gy) for r in polygons.points_in_polygons(grid, rings, "k").collect()}
    assert got == want and len(got) > 300


def test_prorated_labels_count_overlaps_twice(spark):
    wells = spark.createDataFrame([("a",), ("b",)], "well_api string")
    prod = spark.createDataFrame([("a", date(2020, 1, 1), date(2020, 12, 31), 366.0, "u"), ("a", date(2020, 1, 1), date(2020, 1, 10), None, "u"), ("a", date(2021, 1, 1), date(2021, 1, 1), 5.0, "other")], "permit_num string, production_period_start_date date, production_period_end_date date, gas_quantity double, production_scope string")
    got = {r.well_api: r for r in life.day_prorated_labels(wells, prod, "u").collect()}
    assert got["a"].f12_gas == pytest.approx(365) and got["a"].covered_days_f12 == 375 and got["a"].label_f12_available and not got["a"].label_f24_available
    assert got["b"].f12_gas is None and got["b"].label_f12_available is False
    with pytest.raises(ValueError, match="unknown label method"):
        life.first_life(wells, prod, "x")


def test_average_rank_percentile(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None), (5, 9.0)], "k long, v double")
    got = {r.k: r.p for r in ranking.average_rank_percentile(df, "v", "p").collect()}
    assert got == {1: 0.625, 2: 0.625, 3: 0.25, 4: None, 5: 1.0}


def test_number_rows_over_parts(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert rows(ranking.number_rows(df, [F.col("k")], "n").where("n <> k + 1")) == []


def test_forward_fill_root_resets_cycle(spark):
    df = spark.createDataFrame([(1, "root", 1), (2, "cycle", 2), (3, "x", 3), (4, "root", 4), (5, "x", 5)], "p long, kind string, v long").withColumn("f", F.lit(0))
    got = ranking.forward_fill(df, ["f"], [F.col("p")], F.col("kind") == "root", F.col("kind") == "cycle", F.col("v"), F.col("v")).where("kind = 'x'")
    assert rows(got.select("p", "root", "cycle")) == [(3, 1, 2), (5, 4, None)]


def test_upsert_is_idempotent(spark):
    old, new = (spark.createDataFrame(r, "id long, v string") for r in ([(1, "a"), (2, "b"), (2, "c")], [(2, "z"), (3, "y")]))
    once = merging.upsert(old, new, ["id"], [F.col("v")])
    assert rows(once) == [(1, "a"), (2, "z"), (3, "y")]
    assert rows(merging.upsert(once, new, ["id"], [F.col("v")])) == rows(once)


def test_unified_schema(spark):
    got = merging.align(spark.createDataFrame([("1", "x", 2.0)], "well_api string, latitude string, nearest_well_distance_km double"), {"nearest_well_distance_km": "nearest_well_km"}, region_id="r")
    assert len(got.columns) == 46 and got.first().latitude is None and got.first().nearest_well_km == 2.0
    assert merging.validate(got, "r").count() == 0
    assert merging.validate(got.drop("latitude"), "r").count() == 1


def test_quota_properties():
    rng = random.Random(1)
    for _ in range(200):
        counts = {f"b{i}": rng.randint(0, 40) for i in range(rng.randint(1, 8))}
        target, share = rng.randint(0, 150), rng.random()
        got = sampling.distribute_quota(counts, target, share)
        supply = sum(counts.values())
        assert sum(got.values()) == (supply if target <= 0 else min(target, supply))
        assert all(v <= counts[k] for k, v in got.items())
    assert sampling.binary_quotas(100, 3, 50) == (47, 3)


def test_separated_equals_the_greedy_walk(spark):
    cells = [(f"c{i}", i % 15, i // 15) for i in range(150)]
    df = spark.createDataFrame(cells, "k string, grid_x long, grid_y long")
    order = [(r.u, r.k, r.grid_x, r.grid_y) for r in df.select("*", C.stable_fraction(F.col("k"), "anchor").alias("u")).collect()]
    kept = []
    for _, k, x, y in sorted(order):
        if all(max(abs(x - a), abs(y - b)) > 2 for _, a, b in kept):
            kept.append((k, x, y))
    assert sorted(r.k for r in sampling.separated(df, "k", 2).collect()) == sorted(k for k, _, _ in kept)


def test_anchors_by_quota_equal_the_walk_by_bucket(spark):
    cells = [(f"c{i}", i % 15, i // 15, "ab"[i % 3 == 0]) for i in range(150)]
    df = spark.createDataFrame(cells, "k string, grid_x long, grid_y long, b string")
    order = sorted((r.u, r.k, r.grid_x, r.grid_y, r.b) for r in df.select("*", C.stable_fraction(F.col("k"), "anchor").alias("u")).collect())
    quotas = sampling.distribute_quota(sampling.bucket_counts(df, "b"), 14, 0.5)
    kept: list = []

    def walk(rows, most):
        n = 0
        for _, k, x, y, _ in rows:
            if n < most and all(max(abs(x - a), abs(y - b)) >= 3 for _, a, b in kept):
                kept.append((k, x, y))
                n += 1

    for b in sorted(quotas):
        walk([r for r in order if r[4] == b], quotas[b])
    walk(order, 14 - len(kept))
    assert sorted(r.k for r in sampling.quota_anchors(df, "b", "k", 14, 3, 0.5).collect()) == sorted(k for k, _, _ in kept)
    with pytest.raises(ValueError, match="of 100 anchors"):
        sampling.quota_anchors(df, "b", "k", 100, 3, 0.5)


def test_splits(spark):
    df = spark.createDataFrame([(i, date(2000, 1, 1 + i), i < 9) for i in range(10)], "k long, day date, y boolean")
    q, got = sampling.split_with_fallback(df, "day", 0.9, "y")
    assert q in sampling.fallback_quantiles(0.9) and {r[0] for r in got.select("split_group").collect()} == {"train", "test"}
    with pytest.raises(ValueError, match="one side empty"):
        sampling.split_by_date(df, "day", "1990-01-01")


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y_true int, score double")
    got = metrics.classification(df).first()
    assert got.roc_auc == pytest.approx(0.625) and got.average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert metrics.classification(df.where("y_true = 1")).first().roc_auc is None


def test_consolidate_orders_nulls_last(spark):
    df = spark.createDataFrame([("w", None, 1, "late"), ("w", 5, 2, None), ("w", 3, 3, "early"), (None, 1, 1, "x")], "k string, o long, id long, v string")
    assert rows(life.consolidate(df, "k", ["o", "id"], ["v"])) == [("w", "late")]


def test_events_and_bins(spark):
    index = spark.createDataFrame([("a", ["x", "y"], [1]), ("b", None, [])], "k string, l array<string>, n array<int>")
    assert rows(observations.observation_events(index, "k", {"l": "l", "n": "n"})) == [("a", 0, "x", 1), ("a", 1, "y", None)]
    bins = observations.year_bins(spark.createDataFrame([(2020,)], "year int"), 10).orderBy("bin").collect()
    assert len(bins) == 37 and bins[-1].bin_end == date(2021, 1, 1) and bins[0].bin_mid == date(2020, 1, 6)


def test_equal_area_grid(spark):
    got = {(r.grid_x, r.grid_y): r for r in summaries.equal_area_grid(spark, (-100_000, -100_000, 100_000, 5_000_000), 100_000).collect()}
    assert got[0, 0].latitude == pytest.approx(0) and got[0, 0].longitude == pytest.approx(0)
    assert got[1, 0].longitude == pytest.approx(1.0364, abs=1e-3) and 38.8 < got[0, 46].latitude < 39.0


def test_window_flags(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0) for i in range(5)], "k long, latitude double, longitude double")
    flags = lambda limit, layer: {r.truncated for r in summaries.window_query(df, 0, 0, 1, 1, limit, ["k"], layer=layer).collect()}
    assert (flags(5, False), flags(5, True), flags(4, False), flags(6, True)) == ({False}, {True}, {True}, {False})


def _labelled(spark):
    rows = [(i, float(i % 37) / 37, float(i * 7 % 41) / 41, "ab"[i % 2], int((i % 37) / 37 + (i * 7 % 41) / 82 > 0.7), "train" if i % 4 else "test") for i in range(400)]
    return spark.createDataFrame(rows, "id long, x double, y double, c string, label int, split_group string")


def test_models_report_what_their_predictions_give(spark):
    df = _labelled(spark)
    model, report = models.evaluate_and_refit(df, "label", ["x", "y"], ["c"])
    got = report.first()
    first = models.classifier(df.where("split_group = 'train'"), "label", ["x", "y"], ["c"])
    scored = [(r.label, r.score) for r in models.predict(first, df.where("split_group = 'test'")).collect()]
    ones, zeros = [s for y, s in scored if y], [s for y, s in scored if not y]
    auc = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert got.roc_auc == pytest.approx(auc) and auc > 0.95 and got.n_rows == len(scored)
    cells = models.score_cells(model, df.select("id", "x", "y", "c")).toPandas()
    assert cells.score_percentile.tolist() == pytest.approx((cells.score.rank(method="average") / len(cells)).tolist())
    assert all(t == next(name for least, name in C.PROSPECT_TIERS if p >= (least or 0)) for p, t in zip(cells.score_percentile, cells.prospect_tier, strict=True))


def test_trees_learn_and_rank_their_features(spark):
    df = _labelled(spark).withColumn("value", F.col("x") * 100)
    model = models.classifier(df, "label", ["x", "y"], [], "trees", 10)
    names = models.importances(model, ["x", "y"])
    assert [n for n, _ in names] == ["x", "y"] and names[0][1] > names[1][1] > 0 and sum(v for _, v in names) == pytest.approx(1)
    right = models.predict(model, df).where("(score >= 0.5) = (label = 1)").count()
    assert right > 380
    got = models.predict(models.regressor(df, "value", ["x", "y"], [], trees=20), df, "y_pred", "log1p").toPandas()
    assert ((got.y_pred - got["value"]).abs() < 12).mean() > 0.9


@pytest.mark.parametrize("fit", ["classifier", "regressor"])
def test_no_part_of_the_trees_rows_is_large(spark, monkeypatch, fit):
    rows = spark.range(0, 2000, 1, 1).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 100).cast("double").alias("x"))
    sizes, plain, bounded = [], models.Pipeline.fit, models.spread
    monkeypatch.setattr(models, "spread", lambda df, n: bounded(df, n, 300))
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: sizes.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()) or plain(self, df))
    (models.classifier(rows, "y", ["x"], [], "trees", 1) if fit == "classifier" else models.regressor(rows, "y", ["x"], [], trees=1))
    assert sum(sizes) == 2000 and max(sizes) <= 310


def test_fused_metrics_are_those_of_both_models(spark):
    df = _labelled(spark).withColumn("v", F.array("y", F.col("x") * F.col("y"))).withColumn("target", F.col("x") * 10 + F.col("y") * 40 + 1)
    got = {r.features: r for r in models.compare_fused(df, "target", ["x"], [], "v").collect()}
    assert set(got) == {"tabular", "fused"} and got["fused"].rmse < got["tabular"].rmse and got["fused"].n_rows == 100


def test_ridge_probe_is_the_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) * [1, 2, 3, 4]
    y = x @ [1.0, -2, 0, 0.5] + rng.normal(size=60) * 3
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, y double")
    got = models.probe_scores(models.probe(df, "v", "y", "ridge", 5.0), df, "v").orderBy("id").toPandas().score
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.linalg.solve(z.T @ z + 5 * np.eye(4), z.T @ (y - y.mean()))
    assert got.tolist() == pytest.approx((y.mean() + z @ w).tolist(), abs=1e-6)


@pytest.mark.parametrize("values", [[3.0, 1.0, 2.0, 2.0], [1e308, -1e308, 0.0, 5e-324, 1.0] * 3, [float(i % 7) for i in range(5000)], [i * 1e-9 for i in range(3000)] + [1e9]])
def test_order_statistics_by_selection(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    ranks = [0, len(values) // 3, len(values) // 2, len(values) - 1]
    assert metrics.order_statistics(df, "v", ranks, bins=8, few=2) == {r: sorted(values)[r] for r in ranks}
    assert metrics.order_statistics(df.limit(0), "v", [0]) == {}


def test_deployed_model_is_the_refit_and_replaces_an_earlier_one(spark, tmp_path):
    rows = [(i, "abc"[i % 3], int(i % 3 == 0 or i % 7 == 0), "test" if i % 4 == 0 else "train") for i in range(240)]
    df = spark.createDataFrame(rows, "id int, c string, y int, split_group string")
    for part in (df.where("id % 2 = 0"), df):
        report = models.deploy(part, "y", [], ["c"], f"{tmp_path}/m").first()
    assert (report.n_rows, report.n_pos) == (60, sum(y for i, _, y, s in rows if s == "test"))
    weight = sum(1 - y for _, _, y, _ in rows) / sum(y for _, _, y, _ in rows)
    got = {r.c: r.score for r in models.predict(models.deployed(f"{tmp_path}/m"), df).select("c", "score").distinct().collect()}
    for c in "abc":
        pos, n = sum(y for _, k, y, _ in rows if k == c), 80
        want = weight * pos / (weight * pos + n - pos)
        assert abs(got[c] - want) < 2e-3


def test_boosted_cells_follow_the_closed_form(spark):
    from math import exp

    rows = [(i, float(i % 4), int((i * 7) % 10 < 2 + i % 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y int")
    got = {r.x: r.score for r in models.predict(models.classifier(df, "y", ["x"], [], "trees", 6, subsample=1.0), df).select("x", "score").distinct().collect()}
    heavy = sum(1 - y for *_, y in rows) / sum(y for *_, y in rows)
    for x in range(4):
        pos, neg = heavy * sum(y for _, k, y in rows if k == x), sum(1 - y for _, k, y in rows if k == x)
        f = (pos - neg) / (pos + neg)
        for _ in range(5):
            f += 0.1 * (4 * pos / (1 + exp(2 * f)) - 4 * neg / (1 + exp(-2 * f))) / (pos + neg)
        assert abs(got[x] - 1 / (1 + exp(-2 * f))) < 1e-9


def planted_scenes(spark, n, m, seed=4):
    """n scenes with boxes of several sizes, some of them the same, and m points, some of them on borders."""
    rng = random.Random(seed)
    boxes = [(x, x + w, y, y + h) for x, y, w, h in ((rng.randint(-8, 8) / 4, rng.randint(-8, 8) / 4, rng.choice([0.0, 0.25, 1.0, 3.0]), rng.choice([0.0, 0.5, 1.0])) for _ in range(n // 3))] + [(1.0, -1.0, 0.0, 1.0), (None, 1.0, 0.0, 1.0)]
    scenes = [(i, "view" if i % 3 else "click", f"T{i % 5}", rng.randint(340, 390) * 86400, rng.choice([None, *map(float, range(50))]), *rng.choice(boxes)) for i in range(n)]
    points = [(str(i), rng.choice([rng.uniform(-2, 2), rng.randint(-8, 8) / 4]), rng.choice([rng.uniform(-2, 2), rng.randint(-8, 8) / 4])) for i in range(m)] + [("none", None, 1.0)]
    return scenes, points, spark.createDataFrame(scenes, "scene_id long, collection string, tile_id string, epoch_s long, cloud_cover double, west double, east double, south double, north double"), spark.createDataFrame(points, "sample_id string, latitude double, longitude double")


def in_box(s, p):
    return None not in (*s[5:], p[1], p[2]) and s[5] <= p[2] <= s[6] and s[7] <= p[1] <= s[8]


def test_shortlists_equal_brute_force_without_all_pairs(spark, monkeypatch):
    scenes, points, given, places = planted_scenes(spark, 1200, 60)
    pairs, plain = [], observations.top_k
    monkeypatch.setattr(observations, "top_k", lambda df, keys, *more: pairs.append(df.count() if "sample_id" in keys else 0) or plain(df, keys, *more))
    got = {(r.sample_id, r.year, r.bin, r["rank"]): r.scene_id for r in observations.scene_shortlists(places, given, 100, 2).collect()}
    want, hits = {}, 0
    for p in points:
        groups = {}
        for s in scenes:
            if in_box(s, p):
                day = date.fromordinal(date(1970, 1, 1).toordinal() + s[3] // 86400)
                bin_ = (day.timetuple().tm_yday - 1) // 100
                middle = (date(day.year, 1, 1).toordinal() - date(1970, 1, 1).toordinal() + bin_ * 100) * 86400 + 100 * 43200
                groups.setdefault((p[0], day.year, bin_), []).append((s[4] is None, s[4] or 0, abs(s[3] - middle), -s[3], s[0]))
                hits += 1
        want |= {(*g, k): o[-1] for g, found in groups.items() for k, o in enumerate(sorted(found)[:2], 1)}
    assert got == want and sum(pairs) < hits / 2


def test_observation_plan_without_all_pairs(spark, monkeypatch):
    scenes, points, given, places = planted_scenes(spark, 1800, 40, 5)
    pairs, plain = [], observations.top_k
    monkeypatch.setattr(observations, "top_k", lambda df, keys, *more: pairs.append(df.count() if "sample_id" in keys else 0) or plain(df, keys, *more))
    plan, coverage = jobs.observation_plan(places, given.where("collection = 'view'"), given.where("collection = 'click'"), 100, 1, 4)
    day = lambda s: date.fromordinal(date(1970, 1, 1).toordinal() + s[3] // 86400)
    hits = [(p[0], day(s).year, (day(s).timetuple().tm_yday - 1) // 100, s[1]) for p in points for s in scenes if in_box(s, p)]
    got = {(r.sample_id, r.year, r.bin, c) for r in plan.collect() for c, has in (("view", r.has_s2), ("click", r.has_s1)) if has}
    assert got == set(hits) and sum(pairs) < len(hits) / 2
    assert {r.sequence_id: r.n_paired for r in coverage.collect()} == {f"{a}__year_{y}": len({h[:3] for h in got if h[:2] == (a, y) and h[3] == "view"} & {h[:3] for h in got if h[:2] == (a, y) and h[3] == "click"}) for a, y, *_ in got}


def test_points_in_boxes_equal_brute_force(spark):
    scenes, points, given, places = planted_scenes(spark, 300, 400, 6)
    for most in (1 << 17, 50):  # 50: several slabs, parts of equal longitudes and chunks of boxes
        got = {tuple(r)[:4]: r.n for r in counting.points_in_boxes(places, given, most, most).collect()}
        want = {s[5:]: n for s in scenes if (n := sum(in_box(s, p) for p in points))}
        assert got == want and len(got) > 20
    assert counting.points_in_boxes(places.limit(0), given).count() == 0
    covered = {r.scene_id: r.n_points for r in observations.scene_coverage(places, given).collect()}
    assert covered == {s[0]: want.get(s[5:], 0) for s in scenes}


def test_season_hits_equal_brute_force_without_all_pairs(spark, monkeypatch):
    scenes, points, given, places = planted_scenes(spark, 1500, 60, 7)
    shifted = given.withColumn("epoch_s", F.lit(5097600 + 86400 * 31) + F.col("scene_id") % 4 * 61 * 86400)  # a day of each season of 1970
    pairs, plain = [], observations.top_k
    monkeypatch.setattr(observations, "top_k", lambda df, keys, *more: pairs.append(df.count() if "sample_id" in keys else 0) or plain(df, keys, *more))
    got = {(r.sample_id, r.season): r.scene_id for r in observations.season_hits(places, shifted.withColumn("tile_id", F.col("scene_id").cast("string")), preferred=("click",)).collect()}
    clear = [s for s in scenes if s[4] is not None and s[4] < 35]
    want = {}
    for p in points:
        best = {}
        for s in clear:
            if in_box(s, p):
                best.setdefault(s[0] % 4, []).append((0 if s[1] == "click" else 999, s[4], s[0]))
        if len(best) == 4:
            want |= {(p[0], ("early_spring", "late_spring", "summer", "fall")[k]): min(found)[-1] for k, found in best.items()}
    assert got == want and len(got) > 20 and sum(pairs) < sum(in_box(s, p) for p in points for s in clear) / 2


def test_epoch_days_beyond_four_digit_years_equal_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__

    spark.createDataFrame([(i,) for i in (0, 1, 9, 365, 2932895, 2932897, 2932898, 2932899, 2932900, 2932933, 6000001)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = rows(__spark_entry__.queries()["nrm04_epoch_ms"](spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["nrm04_epoch_ms"]).fetchall(), key=str)
    assert any(day and day.startswith("+10000-") for _, day in got)


def test_nearest_in_dense_places_without_all_pairs(spark, monkeypatch):
    """Crowds around two towns, many wells in one place, targets far away; pairs stay few."""
    rng = random.Random(8)
    place = lambda: rng.choice([(40 + rng.gauss(0, 0.01), -80 + rng.gauss(0, 0.01)), (41.0, -79.0), (39 + rng.uniform(0, 2), -81 + rng.uniform(0, 2))])
    sources, targets = [(i, *place()) for i in range(3000)], [(f"t{i}", *place()) for i in range(150)] + [("far", -30.0, 100.0), ("none", None, 1.0)]
    pairs, plain = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a, **kw: pairs.append(plain(*a, **kw).count()) or plain(*a, **kw))
    s, t = spark.createDataFrame(sources, "k long, latitude double, longitude double"), spark.createDataFrame(targets, "id string, latitude double, longitude double")
    got = {r.id: (r.near_k, r.near_km) for r in spatial.nearest(t, s, "id", "k").collect()}
    want = {t[0]: min((haversine(t[1:], x[1:]), x[0]) for x in sources) for t in targets if t[1] is not None}
    assert {i: (k, pytest.approx(km, abs=1e-7)) for i, (km, k) in want.items()} == {i: x for i, x in got.items() if i != "none"} and got["none"] == (None, None)
    assert sum(pairs) < sum(haversine(t[1:], x[1:]) <= 5 for t in targets if t[1] is not None for x in sources) / 5
    pairs.clear()
    repaired = {r.id: r.official_key for r in spatial.repair_keys(t, s, "id", "k").collect()}
    assert repaired == {i: k for i, (km, k) in want.items() if km <= 2} and sum(pairs) < sum(haversine(t[1:], x[1:]) <= 2 for t in targets if t[1] is not None for x in sources) / 5


@pytest.mark.parametrize("mid", [(40, -80), (89.99, 10), (-60, -179.99)])
def test_counts_and_nearest_by_ranges_equal_brute_force(mid, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    draw = lambda n: (np.round(mid[0] + rng.uniform(-0.3, 0.3, n), 3).clip(-90, 90), np.round(mid[1] + rng.uniform(-0.3, 0.3, n) * (30 if mid[0] > 80 else 1), 3), rng.integers(0, 50, n))
    t, s, compared, plain = draw(300), draw(4000), [], asof.Rows.pairs
    t = tuple(np.concatenate([a, b[:100]]) for a, b in zip(t, s, strict=True))
    monkeypatch.setattr(asof.Rows, "pairs", lambda *a: (compared.append(len(x[0])) or x for x in plain(*a)))
    km = asof._km(t[0][:, None], t[1][:, None], s[0][None], s[1][None])
    for as_of in (True, False):
        before = s[2][None] < t[2][:, None] if as_of else np.ones_like(km, bool)
        for radius in (1e-6, 2, 20):
            compared.clear()
            assert (asof._count_within(t, s, radius, as_of) == ((km <= radius) & before).sum(axis=1)).all()
            assert radius < 20 or sum(compared) < (km <= radius).sum() / 4
        for gap in (None, 1e-6, 3.0):
            want = np.where(before & (km > (-1 if gap is None else gap)) & (km <= 20), km, np.inf).min(axis=1)
            assert asof._nearest_within(t, s, 20, as_of, gap) == pytest.approx(want, abs=1e-9)


def test_quantiles_of_dense_places_without_all_pairs(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from wellspring.operators import asof

    rng, compared, plain, apart = np.random.default_rng(8), [], asof.Rows.pairs, asof._km
    m, n = 100, 60_000
    left = pa.table({"id": np.arange(m), "lat": 40 + rng.random(m) / 10, "lon": -80 + rng.random(m) / 10, "at": pa.array(rng.integers(0, 50, m), mask=np.arange(m) == 7)})
    value = np.where(rng.random(n) < 0.3, 5.0, rng.normal(size=n))
    right = pa.table({"lat": 40 + rng.random(n) / 10, "lon": -80 + rng.random(n) / 10, "at": rng.integers(0, 50, n), "value": pa.array(value, mask=rng.random(n) < 0.1), "n": pa.nulls(n, pa.int64())})
    km = apart(*(left.column(c).to_numpy()[:, None] for c in ("lat", "lon")), *(right.column(c).to_numpy()[None] for c in ("lat", "lon")))
    known, t_at = ~np.isnan(right.column("value").to_numpy()), left.column("at").fill_null(-1).to_numpy()
    before = right.column("at").to_numpy()[None] < t_at[:, None]
    monkeypatch.setattr(asof.Rows, "pairs", lambda *a: (compared.append(len(x[0])) or x for x in plain(*a)))
    monkeypatch.setattr(asof, "_km", lambda *a: compared.append(np.broadcast(*a).size) or apart(*a))
    for as_of, gap in ((True, None), (False, 0.5)):
        compared.clear()
        got = asof._count((0.2, 4.0), None, as_of, gap, True)(left, right)
        assert sum(compared) < m * n / 5
        for row in got.to_pylist():
            i, radius = row["id"], (0.2, 4.0)[row["radius"]]
            near = (km[i] <= radius) & (before[i] if as_of else km[i] > gap)
            v = right.column("value").to_numpy()[near & known]
            assert (row["n"], row["value_n"]) == (near.sum(), len(v))
            assert (row["median"], row["p90"]) == (pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.9)), abs=1e-12) if len(v) else (None, None))


def test_separated_deals_its_cells(spark, monkeypatch):
    from wellspring.sources import scratch

    plans, plain = [], scratch.materialize
    monkeypatch.setattr(scratch, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or plain(df, name))
    cells = spark.createDataFrame([(f"r{x}_{y}", x, y) for x in range(7) for y in range(7) if (x * y) % 5 != 1], "region_id string, grid_x long, grid_y long").coalesce(1)
    got = {(r.grid_x, r.grid_y) for r in sampling.separated(cells, "region_id", 2).collect()}
    walk = sampling.stable_fraction(F.col("region_id"), "anchor")
    kept = []
    for r in cells.orderBy(walk, "region_id").collect():
        if all(max(abs(r.grid_x - x), abs(r.grid_y - y)) > 2 for x, y in kept):
            kept.append((r.grid_x, r.grid_y))
    assert got == set(kept)
    # a step sends a cell to the places along one axis, from parts whose number follows the table and not its files
    assert all(p.split("== Physical")[0].split("== Optimized")[1].count("Generate explode") <= 1 and "REPARTITION" in p for n, p in plans if n == "firsts") and any(n == "firsts" for n, _ in plans)


def test_life_sums_without_distinct_aggregates(spark):
    rows = [("a", "2020-01-01", 0.0), ("a", "2020-02-01", 5.0), ("a", "2020-02-01", -7.0), ("a", "2021-01-01", 1.0), ("a", "2021-02-01", 2.0), ("a", None, 9.0), ("b", "2020-01-01", 0.0), (None, "2020-01-01", 1.0)]
    months = spark.createDataFrame(rows, "well_api string, d string, gas_quantity double").selectExpr("well_api", "date(d) period_start_date", "gas_quantity")
    got = life.life_summary(months, ("gas",))
    assert "Expand" not in got._jdf.queryExecution().toString()  # a distinct aggregate sends every row several times
    r = got.collect()
    assert [(x.well_api, str(x.first_prod_date), x.observed_months_all, x.observed_gas_all, x.f12_gas, x.covered_months_f12, x.f24_gas, x.covered_months_f24) for x in r] == [("a", "2020-02-01", 4, 10.0, -1.0, 2, 1.0, 3)]


def test_month_labels_of_a_job_read_production_once(spark):
    read = spark.sparkContext.accumulator(0)
    wells = spark.createDataFrame([("a", 40.0, -80.0), ("b", 40.01, -80.0)], "well_api string, latitude double, longitude double")
    rows = spark.createDataFrame([(w, f"2020-{m:02}-01") for w in "ab" for m in range(1, 13)], "well_api string, d string").coalesce(1)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b.assign(gas_quantity=1.0)

    production = rows.mapInPandas(counted, "well_api string, d string, gas_quantity double").selectExpr("well_api", "date(d) period_start_date", "gas_quantity")
    got = {r.well_api: (r.f12_gas, r.count_2km) for r in jobs.monthly_table(wells, production).collect()}
    assert got == {"a": (12.0, 0), "b": (12.0, 0)} and read.value == 24


def test_prospect_surface_without_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    wells = [(f"w{i}", "c", 40 + rng.random() * 0.2, -80 + rng.random() * 0.2) for i in range(3000)]
    geology = spark.createDataFrame([(1, "M")], "objectid long, map_symbol string")
    pairs, plain = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a, **k: (lambda df: pairs.append(df.count()) or df)(plain(*a, **k)))
    monkeypatch.setattr(jobs.polygons, "polygon_attributes", lambda cells, *a: cells.select("cell_id").limit(0).join(geology.limit(0)))
    df = spark.createDataFrame(wells, "well_api string, county_name string, latitude double, longitude double")
    got = jobs.prospect_surface(df, geology, ["map_symbol"], 0.05, 4.0, -F.col("nearest_well_distance_km")).select("latitude", "longitude", "nearest_well_api").collect()
    near = lambda r: min((haversine((r.latitude, r.longitude), w[2:]), w[0]) for w in wells)[1]
    assert len(got) == 16 and all(r.nearest_well_api == near(r) for r in got)
    assert sum(pairs) < sum(haversine((r.latitude, r.longitude), w[2:]) <= 4 for r in got for w in wells) / 5


def test_tiles_receive_what_is_near_and_days_make_few_levels(spark):
    """A tile as wide as twice the reach gets some four times its share of the sources, not nine; ranks of instants have as many levels as distinct days need."""
    import numpy as np

    from wellspring.operators.counting import RangeCounts

    days = np.random.default_rng(2).integers(0, 90, 5000) * 86_400_000_000
    counts = RangeCounts(days)
    assert len(counts.levels) == 7
    first, end, bound = np.array([0, 10, 4000, 7]), np.array([5000, 10, 4999, 8]), np.array([45, 3, 200, -1]) * 86_400_000_000
    for side in ("left", "right"):
        want = [int((days[a:b] < c).sum() if side == "left" else (days[a:b] <= c).sum()) for a, b, c in zip(first, end, bound, strict=True)]
        assert counts.below(first, end, counts.rank(bound, side)).tolist() == want
    points = spark.range(4000).selectExpr("id", "40 + pmod(id * 7919, 4001) / 4001 as lat", "pmod(-179.5 + pmod(id * 104729, 4001) / 4001 - 0.9 + 180, 360) - 180 as lon", "id as at", "cast(null as double) as value")
    grid = asof.Tiles(10)
    placed = grid.placed(points).cache()
    tiles = grid.around(placed.select("band", "column").distinct(), 5)
    sent = asof._sent(tiles, placed.drop("id"))
    assert sent.count() < 5 * 4000
    got = {(r.band, r.column): r.n for r in sent.groupBy("band", "column").agg(F.countDistinct("at").alias("n")).collect()}
    rows = points.collect()
    km = asof._km(*(np.array([getattr(r, c) for r in rows])[:, None] for c in ("lat", "lon")), *(np.array([getattr(r, c) for r in rows])[None] for c in ("lat", "lon")))
    index = {}
    for r in placed.collect():
        index.setdefault((r.band, r.column), []).append(r.id)
    assert all(got[k] >= (km[ids] <= 5).any(axis=0).sum() for k, ids in index.items())


def test_season_hits_read_scenes_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.range(8).selectExpr("id as scene_id", "concat('t', id) as tile_id", "'view' as collection", "(90 + id % 4 * 61) * 86400 as epoch_s", "1.0D as cloud_cover", "0.0D as west", "1.0D as east", "0.0D as south", "1.0D as north").coalesce(1)
    places = spark.createDataFrame([("a", 0.5, 0.5), ("b", 5.0, 5.0)], "sample_id string, latitude double, longitude double")
    got = observations.season_hits(places, rows.mapInPandas(counted, rows.schema), preferred=("view",)).collect()
    assert sorted((r.sample_id, r.scene_id) for r in got) == [("a", k) for k in range(4)] and read.value == 8
