"""Queries of sources, sinks, models, jobs and streams. Files that they read are first written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models, sampling, summaries
from ..sources import readers, sinks
from ..sources.scratch import scratch
from ..streaming import refresh
from . import jobs
from .core_queries import _AGG02, _PRORATED, _SINCE, _TILES, _WINDOWS, MO, P, S, W, _frac, _hav, _out, _polygons, _box_text, _quota, fault_segments, faults_sql, well_places
from .core_queries import SQL as CORE
from .fixtures import load, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def q(name: str, oracle: str | None = None):
    """Register a function of (load, spark, folder) and its SQL."""

    def wrap(f):
        QUERIES[name] = lambda spark, folder: f(lambda t: load(spark, folder, t), spark, folder)
        if oracle:
            SQL[name] = oracle
        return f

    return wrap


@q("src01_read_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(t, spark, folder):
    return readers.read_table(spark, f"{folder}/customer.parquet").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@q("src02_raw_csv", "SELECT CAST(c_custkey AS VARCHAR) AS cust_key, concat(c_name, ' é') AS full_name FROM customer")
def _(t, spark, folder):
    """Files in UTF-8 with a byte-order mark, and files in latin-1, in one folder."""
    path, rows = scratch(spark, "csv"), t("customer").select(F.col("c_custkey").cast("string").alias("k"), F.concat("c_name", F.lit(" é")).alias("name"))
    for encoding, mark, part in (("UTF-8", "\ufeff", rows.where("k % 2 = 0")), ("ISO-8859-1", "", rows.where("k % 2 = 1"))):
        part.toDF(f"{mark}Cust Key", "fullName").write.mode("append").option("header", True).option("encoding", encoding).csv(path)
    return readers.read_raw_csv(spark, path)


def _collection(df: DataFrame, feature, chunk, path: str) -> None:
    """Feature collections, one line and so one document for each chunk of rows."""
    lines = df.select(chunk.alias("chunk"), F.to_json(feature).alias("f")).groupBy("chunk").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    lines.select("value", "chunk").write.partitionBy("chunk").text(path)


@q("src03_features", f"SELECT well_api, county_name, round(longitude, 9) AS longitude, round(latitude, 9) AS latitude FROM {W} w")
def _(t, spark, folder):
    path = scratch(spark, "geojson")
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("well_api").alias("WellAPI"), F.col("county_name").alias("County Name")).alias("properties"), point.alias("geometry"))
    _collection(t("wells"), feature, F.floor(F.col("k") / 500), path)
    got = readers.read_features(spark, [path])
    return got.select(F.col("well_api"), F.col("county_name"), F.round("longitude", 9).alias("longitude"), F.round("latitude", 9).alias("latitude"))


@q("src04_catalog", f"SELECT CAST(scene_id AS VARCHAR) AS scene_id, collection, cloud_cover, round(west, 9) AS bbox_west, round(north, 9) AS bbox_north, 'msi;sar' AS instruments, 'B1;B2' AS assets FROM {S} s")
def _(t, spark, folder):
    path = scratch(spark, "stac")
    href = F.struct(F.lit("x").alias("href"))
    properties = F.create_map(F.lit("eo:cloud_cover"), F.col("cloud_cover").cast("string"), F.lit("instruments"), F.lit('["msi","sar"]'))
    feature = F.struct(F.col("scene_id").cast("string").alias("id"), "collection", F.array("west", "south", "east", "north").alias("bbox"), properties.alias("properties"), F.create_map(F.lit("B2"), href, F.lit("B1"), href).alias("assets"))
    _collection(t("scenes"), feature, F.floor(F.col("scene_id") / 500), path)
    got = readers.read_catalog(spark, path)
    return got.select("scene_id", "collection", "cloud_cover", F.round("bbox_west", 9).alias("bbox_west"), F.round("bbox_north", 9).alias("bbox_north"), "instruments", "assets")


@q("src05_polygon_bbox", f"SELECT concat('s', CAST(objectid AS VARCHAR)) AS scene_id, CASE WHEN objectid % 4 = 1 THEN NULL ELSE objectid * 1.0::DOUBLE END AS cloud_cover, concat('2021-03-', lpad(CAST(1 + objectid AS VARCHAR), 2, '0')) AS acquired, concat('t', CAST(objectid AS VARCHAR)) AS thumbnail_href, CASE WHEN objectid % 5 < 3 THEN x0 END AS bbox_west, CASE WHEN objectid % 5 < 3 THEN y0 END AS bbox_south, CASE WHEN objectid % 5 = 1 THEN x1 + 1 WHEN objectid % 5 < 3 THEN x1 END AS bbox_east, CASE WHEN objectid % 5 < 3 THEN y1 END AS bbox_north FROM {sql('geology')} g")
def _(t, spark, folder):
    """One collection of polygons, multi-polygons and missing geometries, with braces and quotes in its texts."""
    path = scratch(spark, "polygon-scenes")
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    ring, kind = _box_text(x0, x1, y0, y1), F.col("objectid") % 5
    polygon = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}"))
    many = F.concat(F.lit('{"type": "MultiPolygon", "coordinates": [['), ring, F.lit("],["), _box_text(x0 + 1, x1 + 1, y0, y1), F.lit("]]}"))
    geometry = F.when(kind == 0, polygon).when(kind == 1, many).when(kind == 2, polygon).when(kind == 3, "null").otherwise('{"type": "GeometryCollection"}')
    feature = F.concat(F.lit('{"id": "s'), F.col("objectid"), F.lit('", "_links": {"thumbnail": "t'), F.col("objectid"), F.lit('"}, "properties": {"note": "}] \\" {\\\\", "cloud_cover": '), F.when(F.col("objectid") % 4 == 1, F.lit('"none"')).otherwise(F.col("objectid").cast("string")), F.lit(', "acquired": "2021-03-'), F.lpad((F.col("objectid") + 1).cast("string"), 2, "0"), F.lit('T01:02:03Z"}, "geometry": '), geometry, F.lit(',\n "type": "Feature"}'))
    # one document over many lines, made by one task, as a catalog's file is
    lines = t("geology").select(F.col("objectid").alias("n"), F.concat(feature, F.when(F.col("objectid") < F.lit(24), ",").otherwise("]}")).alias("value"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("n"), F.lit('{"type": "FeatureCollection", "crs": {"name": "features"}, "features": [').alias("value"))
    head.unionByName(lines.withColumn("n", F.col("n").cast("long"))).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    got = readers.read_polygon_catalog(spark, path, "polygon_scenes")
    return _out(got.select("scene_id", "cloud_cover", "acquired", "thumbnail_href", "bbox_west", "bbox_south", "bbox_east", "bbox_north"), 9)


SQL["src05_polygon_bbox"] = "SELECT scene_id, round(cloud_cover, 9) AS cloud_cover, acquired, thumbnail_href, round(bbox_west::DOUBLE, 9) AS bbox_west, round(bbox_south::DOUBLE, 9) AS bbox_south, round(bbox_east::DOUBLE, 9) AS bbox_east, round(bbox_north::DOUBLE, 9) AS bbox_north FROM (" + SQL["src05_polygon_bbox"] + ") z"


@q("src08_json_lines", "SELECT doc_id, n_chars FROM documents")
def _(t, spark, folder):
    path = scratch(spark, "jsonl")
    t("documents").select("doc_id", "n_chars").write.json(path)
    return readers.read_json_lines(spark, path, "doc_id long, n_chars long")


@q("src09_shards", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(t, spark, folder):
    path = scratch(spark, "shards")
    t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3).alias("s")).write.partitionBy("s").parquet(path)
    return readers.read_shards(spark, [f"{path}/s={i}" for i in range(3)], ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@q("src12_asset_status", "SELECT DISTINCT 'orders' AS manifest, o_orderpriority AS dataset, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS raw_path FROM orders UNION SELECT DISTINCT 'parts', p_brand, NULL, p_name FROM part")
def _(t, spark, folder):
    a = t("orders").select("o_orderpriority", F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("output_path"), F.col("o_custkey").cast("string").alias("tif_path"))
    return readers.asset_status(("orders", a, "o_orderpriority"), ("parts", t("part").select("p_brand", F.col("p_name").alias("local_path")), "p_brand"))


@q("src07_manifested", "SELECT o_orderkey AS order_key, year(o_orderdate) AS period_id, concat('year ', CAST(year(o_orderdate) AS VARCHAR)) AS label FROM orders")
def _(t, spark, folder):
    """A folder of CSV files for each year; the manifest lists them all."""
    path = scratch(spark, "periods")
    orders = t("orders").select(F.col("o_orderkey").cast("string").alias("Order Key"), F.year("o_orderdate").alias("year"))
    years = [r.year for r in orders.select("year").distinct().orderBy("year").collect()]
    for year in years:
        orders.where(F.col("year") == year).select("Order Key").write.option("header", True).csv(f"{path}/{year}")
    found = spark.read.text([f"{path}/{y}" for y in years]).select("_metadata.file_path").distinct().withColumn("parts", F.split("file_path", "/"))
    year = F.element_at("parts", -2)
    manifest = found.select(F.concat_ws("/", year, F.element_at("parts", -1)).alias("file"), year.cast("long").alias("period_id"), F.concat(F.lit("year "), year).alias("label"))
    return readers.read_manifested(spark, manifest, path).select(F.col("order_key").cast("long").alias("order_key"), "period_id", "label")


def _digits(c, n: int):
    """A number as EBCDIC digits, in hex."""
    return F.regexp_replace(F.lpad(c.cast("string"), n, "0"), "(.)", "F$1")


_WHOLE = [f"CAST(floor({c}_quantity) AS BIGINT) AS {n}" for c, n in (("gas", "gas_mcf"), ("oil", "gas_lift_mcf"), ("water", "condensate_bbl"))]


@q("src10_mainframe", f"SELECT lpad(CAST(CAST(well_api AS BIGINT) % 13 AS VARCHAR), 2, '0') AS district, lpad(well_api, 6, '0') AS rrc_id, strftime(period_start_date, '%y%m') AS cycle_key, year(period_start_date) AS production_year, month(period_start_date) AS production_month, {', '.join(_WHOLE)} FROM {MO} m")
def _(t, spark, folder):
    """A root for each well, a cycle and a production record for each of its months, in records of 102 bytes, the last one a line end."""
    path, key = scratch(spark, "mainframe"), F.col("well_api").cast("long")
    months = t("monthly")
    packed = lambda c: F.concat(F.lpad(F.floor(f"{c}_quantity").cast("long").cast("string"), 9, "0"), F.lit("C"))
    root = months.select(key.alias("well"), F.lit("").alias("month"), F.lit(0).alias("n"), F.concat(F.lit("F0F1C7"), _digits(key % 13, 2), _digits(key, 6)).alias("hex")).distinct()
    month = F.date_format("period_start_date", "yyyyMM").alias("month")
    cycle = months.select(key, month, F.lit(1), F.concat(F.lit("F1F4"), _digits(F.date_format("period_start_date", "yyMM"), 4)))
    amounts = months.select(key, month, F.lit(2), F.concat(F.lit("F1F5"), packed("gas"), packed("oil"), packed("water")))
    records = root.union(cycle).union(amounts).repartitionByRange("well").sortWithinPartitions("well", "month", "n")
    records.select(F.unhex(F.rpad("hex", 202, "40")).cast("string").alias("value")).write.text(path)
    return _out(readers.mainframe_production(readers.read_mainframe(spark, path)).drop("file", "part", "position"))


def _archives(t, path: str) -> None:
    """A ZIP archive for each region: a table of its nations and a note."""

    def pack(rows):
        import io
        import zipfile

        import pandas as pd

        box = io.BytesIO()
        with zipfile.ZipFile(box, "w") as z:
            z.writestr("Nation Table.csv", "Nation Key,n name\n" + "".join(f"{k},{n}\n" for k, n in zip(rows.n_nationkey, rows.n_name, strict=True)))
            z.writestr("note.txt", "note")
        return pd.DataFrame({"r": [rows.n_regionkey.iloc[0]], "box": [box.getvalue()]})

    boxes = t("nation").select("n_regionkey", "n_nationkey", "n_name").groupBy("n_regionkey").applyInPandas(pack, "r int, box binary")
    # Spark's text sink writes the bytes as they are, and a line end that no reader of ZIP minds
    boxes.select(F.col("box").cast("string").alias("value"), "r").repartition("r").write.partitionBy("r").text(path)


@q("src11_archive_inventory", "SELECT CAST(n_regionkey AS VARCHAR) AS region, 'Nation Table.csv' AS member, 18 + sum(length(CAST(n_nationkey AS VARCHAR)) + length(n_name) + 2) AS size FROM nation GROUP BY 1 UNION ALL SELECT DISTINCT CAST(n_regionkey AS VARCHAR), 'note.txt', 4 FROM nation")
def _(t, spark, folder):
    path = scratch(spark, "archives")
    _archives(t, path)
    got = readers.archive_inventory(spark, f"{path}/r=*")
    return got.select(F.regexp_extract("archive", "r=(\\d+)", 1).alias("region"), "member", "size")


@q("src13_reference_tables", "SELECT 'nation_table' AS dataset, CAST(n_nationkey AS VARCHAR) AS nation_key, n_name FROM nation")
def _(t, spark, folder):
    path = scratch(spark, "archives")
    _archives(t, path)
    tables = readers.archive_tables(spark, f"{path}/r=*", scratch(spark, "members"))
    return tables["nation_table"].where("nation_key <> 'Nation Key'").select(F.lit("nation_table").alias("dataset"), "nation_key", "n_name")


_SCENE_TEXT = "CAST(scene_id AS VARCHAR)"


@q("src14_raster_assets", f"SELECT concat('source ', CAST(scene_id % 20 AS VARCHAR)) AS source_id, {_SCENE_TEXT} AS scene_id, collection, cloud_cover, CASE WHEN scene_id % 3 = 0 THEN NULL ELSE CAST(scene_id * 10 AS DOUBLE) END AS file_size_bytes, round(west, 6) AS bbox_west, '2024-05-01' AS checked_at_utc FROM {S} s")
def _(t, spark, folder):
    path = scratch(spark, "manifests")
    size = F.when(F.col("scene_id") % 3 == 0, "unknown").otherwise((F.col("scene_id") * 10).cast("string"))
    item = F.struct(F.col("scene_id").cast("string").alias("scene_id"), "collection", F.col("cloud_cover").cast("string").alias("cloud_cover"), size.alias("file_size_bytes"), F.col("west").cast("string").alias("bbox_west"))
    t("scenes").groupBy(F.concat(F.lit("source "), (F.col("scene_id") % 20).cast("string")).alias("source_id")).agg(F.collect_list(item).alias("downloads")).withColumn("checked_at_utc", F.lit("2024-05-01")).write.json(path)
    return _out(readers.raster_assets(readers.read_raster_manifests(spark, path)).select("source_id", "scene_id", "collection", "cloud_cover", "file_size_bytes", "bbox_west", "checked_at_utc"))


@q("src14_raster_composites", f"SELECT concat('source ', CAST(g % 5 AS VARCHAR)) AS source_id, concat('c', CAST(g AS VARCHAR)) AS composite_id, string_agg({_SCENE_TEXT}, ';' ORDER BY scene_id) AS scene_ids, CAST(count(*) AS DOUBLE) AS scene_count FROM (SELECT *, grid_code % 200 AS g FROM {S} s) x GROUP BY g")
def _(t, spark, folder):
    path = scratch(spark, "manifests")
    g = t("scenes").groupBy((F.col("grid_code") % 200).alias("g")).agg(F.transform(F.array_sort(F.collect_list("scene_id")), lambda x: x.cast("string")).alias("scene_ids"), F.count("*").cast("string").alias("scene_count"))
    item = F.struct(F.concat(F.lit("c"), F.col("g").cast("string")).alias("composite_id"), "scene_ids", "scene_count")
    g.groupBy(F.concat(F.lit("source "), (F.col("g") % 5).cast("string")).alias("source_id")).agg(F.collect_list(item).alias("composites")).write.json(path)
    return readers.raster_composites(readers.read_raster_manifests(spark, path)).select("source_id", "composite_id", "scene_ids", "scene_count")


@q("src14_order_drafts", "SELECT concat('draft ', CAST(o_custkey AS VARCHAR)) AS draft_name, 'scenes' AS source_type, min(o_orderstatus) AS item_type, count(*) AS item_count FROM orders GROUP BY o_custkey")
def _(t, spark, folder):
    path = scratch(spark, "drafts")
    product = F.struct(F.min("o_orderstatus").alias("item_type"), F.collect_list(F.col("o_orderkey").cast("string")).alias("item_ids"))
    t("orders").groupBy("o_custkey").agg(product.alias("p")).select(F.concat(F.lit("draft "), F.col("o_custkey").cast("string")).alias("name"), F.lit("scenes").alias("source_type"), F.array("p").alias("products")).write.json(path)
    return _out(readers.order_drafts(spark, path).select("draft_name", "source_type", "item_type", "item_count"))


@q("snk03_cell_features", f"SELECT CAST(objectid AS BIGINT) AS objectid, 'Polygon' AS kind, round(x0, 5) AS west, round(y1, 5) AS north, CAST(5 AS BIGINT) AS corners FROM {sql('geology')} g")
def _(t, spark, folder):
    cells = t("geology").select(F.col("x0").alias("min_lon"), F.col("y0").alias("min_lat"), F.col("x1").alias("max_lon"), F.col("y1").alias("max_lat"), "objectid")
    path = scratch(spark, "features")
    sinks.write_features(cells, ["objectid"], path)
    back = readers.read_json_lines(spark, path)
    ring = F.col("geometry.coordinates")[0]
    return _out(back.select(F.col("properties.objectid").cast("long").alias("objectid"), F.col("geometry.type").alias("kind"), F.round(F.array_min(F.transform(ring, lambda p: p[0])), 5).alias("west"), F.round(F.array_max(F.transform(ring, lambda p: p[1])), 5).alias("north"), F.size(ring).alias("corners")))


@q("snk04_append", "SELECT p_partkey, p_name FROM part UNION ALL SELECT p_partkey + 1000000, p_name FROM part")
def _(t, spark, folder):
    path = scratch(spark, "append")
    for more in (0, 1_000_000):
        sinks.append_rows(t("part").select((F.col("p_partkey") + more).alias("p_partkey"), "p_name"), path)
    return spark.read.parquet(path)


@q("snk04_replace", "SELECT p_partkey, p_size + 1 AS p_size FROM part")
def _(t, spark, folder):
    """Two writers begin from one version: the first wins, the second gets a conflict and leaves the index as it is."""
    path, parts = scratch(spark, "index"), t("part").select("p_partkey", "p_size")
    first = sinks.replace_index(parts, path, 0)
    sinks.replace_index(sinks.read_index(spark, path).withColumn("p_size", F.col("p_size") + 1), path, first)
    try:
        sinks.replace_index(parts.limit(1), path, first)
    except sinks.Conflict:
        return sinks.read_index(spark, path)
    raise AssertionError("two writers replaced one version")


@q("snk05_publish", "SELECT p_brand, count(*) AS n, '2024-02' AS snapshot_id FROM part GROUP BY 1")
def _(t, spark, folder):
    path = scratch(spark, "snapshots")
    counts = t("part").groupBy("p_brand").agg(F.count("*").alias("n"))
    for s in ("2024-01", "2024-02", "2024-02"):
        sinks.publish(counts, path, s)
    return sinks.latest(spark, path).select("p_brand", "n", F.col("snapshot_id").cast("string").alias("snapshot_id"))


_TRAINABLE = "(w.well_status IN ('Active','Plugged OG Well','Abandoned') OR y.well_api IS NOT NULL)"
_AT = f"SELECT w.*, coalesce(CASE WHEN w.spud_date >= DATE '1950-01-01' THEN w.spud_date END, x.d) AS at FROM {W} w LEFT JOIN (SELECT well_api, min(permit_issued_date) AS d FROM {P} p GROUP BY 1) x ON w.well_api = x.well_api"


_BASIN = "county_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 4 = 0)"
_SCOPED = f"(SELECT * FROM ({_AT}) s WHERE unconventional AND {_BASIN})"


def _neighbours(source: str, date: str, condition: str = "", value: str = "NULL") -> str:
    """Rows of a table before each well's context date: km and value."""
    return f"SELECT a.well_api, {_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS km, {value} AS v FROM {_SCOPED} a JOIN {source} b ON abs(a.latitude - b.latitude) < 0.2 AND b.{date} < a.at {condition}"


_COUNTS = "round(min(km) FILTER (WHERE km <= 20), 6) AS nearest, count(*) FILTER (WHERE km <= 2) AS n2, count(*) FILTER (WHERE km <= 5) AS n5"
SQL_FOCAL = CORE["win09_focal"]
_FAULTS = faults_sql(W)
_V1 = f"""SELECT w.well_api, CAST(w.at AS VARCHAR) AS context_date, coalesce(permit_count, 0) AS permit_count, CAST({_TRAINABLE} AND w.well_status NOT IN ('Duplicate','Proposed But Never Materialized') AS VARCHAR) AS trainable_v1,
CAST(coalesce(y.well_api IS NOT NULL AND date_diff('day', w.spud_date, observed_first_prod_date) BETWEEN 0 AND 180 AND observed_rows >= 10, false) AS VARCHAR) AS label_f12_like_available,
b.nearest AS well_nearest_km, coalesce(b.n2, 0) AS well_count_2km, coalesce(b.n5, 0) AS well_count_5km, c.nearest AS permit_nearest_km, coalesce(c.n2, 0) AS permit_count_2km, coalesce(c.n5, 0) AS permit_count_5km, h.elevation, h.slope_deg, h.relief, l.fault_km
FROM ({_AT}) w LEFT JOIN (SELECT well_api, count(*) AS permit_count FROM {P} p GROUP BY 1) x ON w.well_api = x.well_api LEFT JOIN ({_AGG02}) y ON w.well_api = y.well_api
LEFT JOIN ({SQL_FOCAL}) h ON h.r = CAST(floor((41 - w.latitude) / 0.1::DOUBLE) AS BIGINT) AND h.c = CAST(floor((w.longitude + 81) / 0.1::DOUBLE) AS BIGINT) LEFT JOIN ({_FAULTS}) l ON w.well_api = l.well_api
LEFT JOIN (SELECT well_api, {_COUNTS} FROM ({_neighbours(_SCOPED, 'at')}) n WHERE km <= 20 GROUP BY 1) b ON w.well_api = b.well_api LEFT JOIN (SELECT well_api, {_COUNTS} FROM ({_neighbours(f'(SELECT * FROM {P} p WHERE {_BASIN})', 'permit_issued_date')}) n WHERE km <= 20 GROUP BY 1) c ON w.well_api = c.well_api
WHERE w.unconventional AND w.{_BASIN}"""
_MATURE = f"(SELECT w.latitude, w.longitude, CAST(l.first_prod_date AS DATE) AS first_prod_date, l.f12_gas FROM ({_PRORATED}) l JOIN {_SCOPED} w ON w.well_api = l.well_api WHERE label_f12_available = 'true')"
_V2 = f"""SELECT v.*, l.first_prod_date, l.f12_gas, l.label_f12_available, round(m.nearest, 6) AS mature_nearest_km, coalesce(m.n5, 0) AS mature_count_5km, round(m.m5, 6) AS mature_median_5km, round(m.q10, 6) AS mature_p90_10km
FROM ({_V1}) v JOIN ({_PRORATED}) l ON v.well_api = l.well_api LEFT JOIN (SELECT well_api, min(km) AS nearest, count(*) FILTER (WHERE km <= 5) AS n5, quantile_cont(v, 0.5) FILTER (WHERE km <= 5) AS m5, quantile_cont(v, 0.9) FILTER (WHERE km <= 10) AS q10 FROM ({_neighbours(_MATURE, 'first_prod_date', value='b.f12_gas')}) n WHERE km <= 10 GROUP BY 1) m ON v.well_api = m.well_api"""
_V1_COLUMNS = ("well_api", "context_date", "permit_count", "trainable_v1", "label_f12_like_available", "well_nearest_km", "well_count_2km", "well_count_5km", "permit_nearest_km", "permit_count_2km", "permit_count_5km", "elevation", "slope_deg", "relief", "fault_km")


def _places(t) -> dict:
    """Basin, terrain and faults of the training tables."""
    tiles = t("dem").groupBy("tile").agg(F.lit(-81.0).alias("west"), F.lit(41.0).alias("north"), F.lit(0.1).alias("step_x"), F.lit(0.1).alias("step_y"), (F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"))
    counties = [r[0] for r in t("nation").where("n_nationkey % 4 <> 0").select(F.upper("n_name")).collect()]
    return {"counties": counties, "terrain": (tiles, t("dem"), 30.0, 30.0), "faults": (fault_segments(t), *well_places())}


@q("job03_training_table_v1", _V1)
def _(t, spark, folder):
    return _out(jobs.training_table_v1(t("wells"), t("permits"), t("production"), _polygons(t), ["map_symbol"], **_places(t)).select(*_V1_COLUMNS))


@q("job04_training_table_v2", _V2)
def _(t, spark, folder):
    got = jobs.training_table_v2(t("wells"), t("permits"), t("production"), _polygons(t), ["map_symbol"], **_places(t))
    return _out(got.select(*_V1_COLUMNS, "first_prod_date", "f12_gas", "label_f12_available", "mature_nearest_km", "mature_count_5km", "mature_median_5km", "mature_p90_10km"))


_FIRST = f"SELECT well_api, min(s) AS s, sum(CASE WHEN k BETWEEN 0 AND 11 THEN gas_quantity END) AS g, count(DISTINCT CASE WHEN k BETWEEN 0 AND 11 THEN period_start_date END) AS n FROM ({_SINCE}) x GROUP BY 1"
_PLACED = f"SELECT w.well_api, latitude, longitude, s FROM {W} w JOIN (SELECT well_api, min(period_start_date) AS s FROM {MO} m WHERE gas_quantity > 0 GROUP BY 1) f ON w.well_api = f.well_api"


@q("job05_monthly_table", f"""WITH need AS (SELECT CASE WHEN max(n) <= 40 THEN 4 ELSE 12 END AS m FROM (SELECT count(DISTINCT period_start_date) AS n FROM {MO} m GROUP BY well_api) c),
near AS (SELECT a.well_api, {_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS km FROM ({_PLACED}) a JOIN ({_PLACED}) b ON abs(a.latitude - b.latitude) < 0.2 AND b.s < a.s),
stats AS (SELECT p.well_api, coalesce(n2, 0) AS n2, coalesce(n5, 0) AS n5, d FROM ({_PLACED}) p LEFT JOIN (SELECT well_api, count(*) FILTER (WHERE km <= 2) AS n2, count(*) FILTER (WHERE km <= 5) AS n5, min(km) AS d FROM near WHERE km <= 20 GROUP BY 1) x ON p.well_api = x.well_api)
SELECT w.well_api, f12_gas, label_f12_available, n2 AS count_2km, n5 AS count_5km, round(d, 6) AS nearest_km FROM {W} w LEFT JOIN (SELECT well_api, round(a.g, 6) AS f12_gas FROM ({_FIRST}) a) l ON w.well_api = l.well_api
LEFT JOIN (SELECT w.well_api, CAST(coalesce(a.n, 0) >= (SELECT m FROM need) AS VARCHAR) AS label_f12_available FROM {W} w LEFT JOIN ({_FIRST}) a ON w.well_api = a.well_api) v ON w.well_api = v.well_api LEFT JOIN stats ON w.well_api = stats.well_api""")
def _(t, spark, folder):
    return _out(jobs.monthly_table(t("wells"), t("monthly")).select("well_api", "f12_gas", "label_f12_available", "count_2km", "count_5km", "nearest_km"))


_AT_FIRST = f"(SELECT w.well_api, w.latitude, w.longitude, coalesce(f.s, w.spud_date) AS at, CASE WHEN coalesce(f.n, 0) >= (SELECT CASE WHEN max(n) <= 40 THEN 4 ELSE 12 END FROM (SELECT count(DISTINCT period_start_date) AS n FROM {MO} m GROUP BY well_api) c) THEN f.g END AS mature FROM {W} w LEFT JOIN ({_FIRST}) f ON w.well_api = f.well_api)"


def _asof_sql(source: str, at: str, condition: str = "true") -> str:
    return f"SELECT a.well_api, {_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS km, b.* FROM {_AT_FIRST} a JOIN {source} b ON abs(a.latitude - b.latitude) < 0.2 AND b.{at} < a.at AND {condition}"


@q("job05_state_table", f"""SELECT w.well_api, CAST(w.at AS VARCHAR) AS context_date, coalesce(n.n2, 0) AS well_count_2km, coalesce(n.n5, 0) AS well_count_5km, round(n.d, 6) AS well_nearest_km, coalesce(p.n2, 0) AS permit_count_2km, round(p.d, 6) AS permit_nearest_km,
coalesce(m.n5, 0) AS mature_value_count_5km, round(m.m5, 6) AS mature_median_5km, coalesce(m.n10, 0) AS mature_value_count_10km, round(m.q10, 6) AS mature_p90_10km FROM {_AT_FIRST} w
LEFT JOIN (SELECT well_api, count(*) FILTER (WHERE km <= 2) AS n2, count(*) FILTER (WHERE km <= 5) AS n5, min(km) AS d FROM ({_asof_sql(_AT_FIRST.replace('w.well_api, w.lat', 'w.lat', 1), 'at')}) x WHERE km <= 20 GROUP BY 1) n ON w.well_api = n.well_api
LEFT JOIN (SELECT well_api, count(*) FILTER (WHERE km <= 2) AS n2, min(km) AS d FROM ({_asof_sql(f'(SELECT latitude, longitude, permit_issued_date FROM {P} p)', 'permit_issued_date')}) x WHERE km <= 20 GROUP BY 1) p ON w.well_api = p.well_api
LEFT JOIN (SELECT well_api, count(*) FILTER (WHERE km <= 5) AS n5, quantile_cont(mature, 0.5) FILTER (WHERE km <= 5) AS m5, count(*) FILTER (WHERE km <= 10) AS n10, quantile_cont(mature, 0.9) FILTER (WHERE km <= 10) AS q10 FROM ({_asof_sql(_AT_FIRST.replace('w.well_api, w.lat', 'w.lat', 1), 'at', 'b.mature IS NOT NULL')}) x WHERE km <= 10 GROUP BY 1) m ON w.well_api = m.well_api""")
def _(t, spark, folder):
    """Context dates fall back to the spud date."""
    got = jobs.state_table(t("wells"), t("permits"), t("monthly"), ["spud_date"], "permit_issued_date")
    return _out(got.select("well_api", "context_date", "well_count_2km", "well_count_5km", "well_nearest_km", "permit_count_2km", "permit_nearest_km", "mature_value_count_5km", "mature_median_5km", "mature_value_count_10km", "mature_p90_10km"))


_STATUS = "CASE WHEN k % 4 = 0 THEN 'Permit Issued' WHEN k % 4 = 1 THEN 'Final permit' ELSE well_status END"


@q("job01_states", f"""WITH w AS (SELECT well_api, county_name, longitude, {_STATUS} AS status, CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(spud_date AS VARCHAR) END AS day, k FROM {W} w)
SELECT 'wv' AS state, 'wells' AS tab, well_api, status, day, round(longitude, 6) AS x FROM w UNION ALL SELECT 'wv', 'permits', well_api, status, day, round(longitude, 6) FROM w WHERE status = 'Permit Issued'
UNION ALL SELECT 'wv', 'laterals', well_api, status, day, k * 1.5::DOUBLE FROM w WHERE k % 3 = 0 UNION ALL SELECT 'oh', 'wells', well_api, status, day, round(longitude, 6) FROM w UNION ALL SELECT 'oh', 'permits', well_api, status, day, round(longitude, 6) FROM w WHERE lower(status) LIKE '%permit%'""")
def _(t, spark, folder):
    """Wells, permits and laterals of two states whose features differ in names; days as text, some of them bad."""
    status, day = F.expr(_STATUS), F.when(F.col("k") % 7 == 0, F.lit("unknown")).otherwise(F.col("spud_date").cast("string"))
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    wells = t("wells").select("k", point.alias("geometry"), F.col("well_api"), "county_name", status.alias("status"), day.alias("day"))
    shapes = {
        "wv": (wells, F.struct(F.col("well_api").alias("api"), F.col("status").alias("wellstatus"), F.col("day").alias("issuedate"), F.col("county_name").alias("respparty")), jobs.WV_FIELDS, "permit_issued_date"),
        "laterals": (wells.where("k % 3 = 0"), F.struct(F.col("well_api").alias("api"), F.col("status").alias("wellstatus"), F.col("day").alias("compdate"), (F.col("k") * 1.5).cast("string").alias("st_length_shape")), jobs.LATERAL_FIELDS, "completion_date"),
        "oh": (wells, F.struct(F.col("well_api").alias("API_WELLNO"), F.col("status").alias("WL_STATUS_DESC"), F.col("day").alias("Spud Date"), F.col("county_name").alias("WL_CNTY")), jobs.OH_FIELDS, "spud_date"),
    }
    tables = {}
    for name, (df, properties, fields, at) in shapes.items():
        path = scratch(spark, name)
        _collection(df, F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), "geometry"), F.floor(F.col("k") / 1000), path)
        got = jobs.state_features(readers.read_features(spark, path), fields)
        tables[name] = got.select("well_api", F.col("well_status").alias("status"), F.col(at).alias("day"), (F.col("shape_length_m") if name == "laterals" else F.col("longitude")).alias("x"))
    rows = [("wv", "wells", tables["wv"]), ("wv", "laterals", tables["laterals"]), ("oh", "wells", tables["oh"])]
    rows += [(s, "permits", jobs.state_permits(tables[s].withColumnRenamed("status", "well_status"), kinds).withColumnRenamed("well_status", "status")) for s, kinds in (("wv", jobs.PERMIT_STATUSES), ("oh", None))]
    out = [df.select(F.lit(s).alias("state"), F.lit(tab).alias("tab"), "well_api", "status", "day", "x") for s, tab, df in rows]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return _out(out[0])


_CELLS = f"SELECT concat(CAST(cx AS VARCHAR), '_', CAST(cy AS VARCHAR)) AS cell_id, (cx + 0.5) * 0.05::DOUBLE AS longitude, (cy + 0.5) * 0.05::DOUBLE AS latitude FROM (SELECT DISTINCT CAST(floor(longitude / 0.05::DOUBLE) AS BIGINT) + dx AS cx, CAST(floor(latitude / 0.05::DOUBLE) AS BIGINT) + dy AS cy FROM {W} w, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) c"


@q("job06_prospect_cells", f"""WITH n AS (SELECT cell_id, k, {_hav('c.latitude', 'c.longitude', 'w.latitude', 'w.longitude')} AS km FROM ({_CELLS}) c JOIN {W} w ON abs(c.latitude - w.latitude) < 0.1),
s AS (SELECT c.cell_id, m FROM ({_CELLS}) c LEFT JOIN (SELECT cell_id, quantile_cont(k, 0.5) AS m FROM n WHERE km <= 10 GROUP BY 1) x ON c.cell_id = x.cell_id),
p AS (SELECT cell_id, m, CASE WHEN m IS NOT NULL THEN (rank() OVER (ORDER BY m ASC NULLS LAST) + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE) / (SELECT count(m) FROM s) END AS pct FROM s)
SELECT cell_id, round(m, 6) AS score, round(pct, 6) AS score_percentile, CASE WHEN pct IS NULL THEN NULL WHEN pct >= 0.9 THEN 'very_high' WHEN pct >= 0.7 THEN 'high' WHEN pct >= 0.4 THEN 'medium' ELSE 'background' END AS prospect_tier FROM p""")
def _(t, spark, folder):
    return _out(jobs.prospect_cells(t("wells"), _polygons(t), ["map_symbol"], 0.05, "k").select("cell_id", "score", "score_percentile", "prospect_tier"))


_EXTENT = f"SELECT concat(CAST(cx AS VARCHAR), '_', CAST(cy AS VARCHAR)) AS cell_id, (cx + 0.5) * 0.05::DOUBLE AS longitude, (cy + 0.5) * 0.05::DOUBLE AS latitude FROM (SELECT unnest(range(CAST(floor(min(longitude) / 0.05::DOUBLE) AS BIGINT), CAST(ceil(max(longitude) / 0.05::DOUBLE) AS BIGINT))) AS cx FROM {W} w) a, (SELECT unnest(range(CAST(floor(min(latitude) / 0.05::DOUBLE) AS BIGINT), CAST(ceil(max(latitude) / 0.05::DOUBLE) AS BIGINT))) AS cy FROM {W} w) b"


@q("job06_prospect_surface", f"""WITH n AS (SELECT cell_id, well_api, county_name, {_hav('c.latitude', 'c.longitude', 'w.latitude', 'w.longitude')} AS km FROM ({_EXTENT}) c JOIN {W} w ON abs(c.latitude - w.latitude) < 0.1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY km, well_api) AS r FROM n WHERE km <= 4) x WHERE r = 1),
g AS (SELECT c.cell_id, min(g.objectid) AS objectid FROM ({_EXTENT}) c JOIN {sql('geology')} g ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1 AND NOT (objectid % 3 = 0 AND longitude > x0 + 0.1 AND longitude < x0 + 0.3 AND latitude > y0 + 0.1 AND latitude < y0 + 0.3) GROUP BY 1),
s AS (SELECT b.*, g.objectid, coalesce(g.objectid, 0) - km AS score FROM b LEFT JOIN g ON b.cell_id = g.cell_id), p AS (SELECT *, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pct FROM s)
SELECT cell_id, well_api AS nearest_well_api, county_name, round(km, 6) AS nearest_well_distance_km, CAST(objectid AS BIGINT) AS objectid, round(pct, 6) AS score_percentile, CASE WHEN pct >= 0.9 THEN 'very_high' WHEN pct >= 0.7 THEN 'high' WHEN pct >= 0.4 THEN 'medium' ELSE 'background' END AS prospect_tier FROM p""")
def _(t, spark, folder):
    """Scored by geology and nearness, for want of a model that SQL can repeat."""
    got = jobs.prospect_surface(t("wells"), _polygons(t), ["map_symbol"], 0.05, 4.0, F.coalesce("objectid", F.lit(0)) - F.col("nearest_well_distance_km"))
    return _out(got.select("cell_id", "nearest_well_api", "county_name", "nearest_well_distance_km", "objectid", "score_percentile", "prospect_tier"))


_PADDED = f"SELECT concat(CAST(cx AS VARCHAR), '_', CAST(cy AS VARCHAR)) AS cell_id, cx, cy, (cx + 0.5) * 0.05::DOUBLE AS longitude, (cy + 0.5) * 0.05::DOUBLE AS latitude FROM (SELECT unnest(range(CAST(floor((min(longitude) - 0.05) / 0.05::DOUBLE) AS BIGINT), CAST(ceil((max(longitude) + 0.05) / 0.05::DOUBLE) AS BIGINT))) AS cx FROM {W} w) a, (SELECT unnest(range(CAST(floor((min(latitude) - 0.05) / 0.05::DOUBLE) AS BIGINT), CAST(ceil((max(latitude) + 0.05) / 0.05::DOUBLE) AS BIGINT))) AS cy FROM {W} w) b"


def _near_cells(source: str) -> str:
    return f"SELECT cell_id, min(km) FILTER (WHERE km <= 20) AS d, count(*) FILTER (WHERE km <= 2) AS n2, count(*) FILTER (WHERE km <= 5) AS n5 FROM (SELECT cell_id, {_hav('c.latitude', 'c.longitude', 'w.latitude', 'w.longitude')} AS km FROM ({_PADDED}) c JOIN {source} w ON abs(c.latitude - w.latitude) < 0.2) x GROUP BY 1"


@q("job06_feature_surface", f"""WITH s AS (SELECT c.cell_id, c.cx, c.cy, n.d, coalesce(n.n5, 0) AS n5, coalesce(p.n5, 0) AS p5, f.fault_km, h.elevation, 2 * coalesce(n.n5, 0) + coalesce(p.n2, 0) - f.fault_km / 7 AS score FROM ({_PADDED}) c JOIN ({_near_cells(W)}) n ON c.cell_id = n.cell_id AND n.d <= 4 LEFT JOIN ({_near_cells(P)}) p ON c.cell_id = p.cell_id
JOIN ({faults_sql(f'(SELECT cell_id AS well_api, latitude, longitude FROM ({_PADDED}) z)')}) f ON c.cell_id = f.well_api LEFT JOIN ({SQL_FOCAL}) h ON h.r = CAST(floor((41 - c.latitude) / 0.1::DOUBLE) AS BIGINT) AND h.c = CAST(floor((c.longitude + 81) / 0.1::DOUBLE) AS BIGINT)),
p AS (SELECT *, (rank() OVER (ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY round(score, 9)) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pct FROM s)
SELECT cell_id, round(score, 6) AS score, round(pct, 6) AS score_percentile, CASE WHEN pct >= 0.9 THEN 'very_high' WHEN pct >= 0.7 THEN 'high' WHEN pct >= 0.4 THEN 'medium' ELSE 'background' END AS prospect_tier, n5 AS well_count_5km, p5 AS permit_count_5km, fault_km, round(elevation, 6) AS elevation, round(cx * 0.05::DOUBLE, 6) AS west, round((cy + 1) * 0.05::DOUBLE, 6) AS north FROM p""")
def _(t, spark, folder):
    """Cells with all features, scored, exported as GeoJSON lines and read back. A sum of features stands for the model, so that SQL can repeat it."""
    sum_of = lambda df: df.withColumn("score", F.round(2 * F.col("well_count_5km") + F.col("permit_count_2km") - F.round("fault_km", 6) / 7, 9))
    got = jobs.feature_surface(t("wells"), t("permits"), _polygons(t), ["map_symbol"], 0.05, 4.0, 0.05, sum_of, _places(t)["terrain"], (fault_segments(t), well_places))
    path = scratch(spark, "surface")
    sinks.write_features(got, ["cell_id", "score", "score_percentile", "prospect_tier", "well_count_5km", "permit_count_5km", "fault_km", "elevation"], path, 6)
    rows = spark.read.schema("properties struct<cell_id:string,score:double,score_percentile:double,prospect_tier:string,well_count_5km:long,permit_count_5km:long,fault_km:double,elevation:double>, geometry struct<coordinates:array<array<array<double>>>>").json(path)
    ring = F.col("geometry.coordinates")[0]
    return rows.select("properties.*", ring[0][0].alias("west"), ring[2][1].alias("north"))


def _unified(t):
    w = t("wells").withColumn("context_date", F.col("spud_date")).withColumn("f12_gas", F.col("k") * 1.0).withColumn("label_f12_available", F.col("k") % 4 != 0)
    return jobs.unified_table({"a": (w.where("unconventional"), {}, {"state": "PA"}), "b": (w.where("not unconventional"), {}, {"state": "WV"}), "c": (None, {}, {})})[0]


@q("job07_unified_table", f"SELECT CASE WHEN unconventional THEN 'a' ELSE 'b' END AS region_id, CASE WHEN unconventional THEN 'PA' ELSE 'WV' END AS state, well_api, CAST(spud_date AS VARCHAR) AS context_date, round(latitude, 6) AS latitude, k * 1.0e0 AS f12_gas, CAST(k % 4 <> 0 AS VARCHAR) AS label_f12_available FROM {W} w")
def _(t, spark, folder):
    return _out(_unified(t).select("region_id", "state", "well_api", "context_date", "latitude", "f12_gas", "label_f12_available"))


@q("job08_cohort", f"SELECT region_id, concat('well::', well_api) AS sample_id, CASE WHEN spud_date < DATE '1998-01-01' THEN 'train' ELSE 'test' END AS split_group FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY {_frac('cap', 'well_api')}, well_api) AS r FROM (SELECT *, CASE WHEN unconventional THEN 'a' ELSE 'b' END AS region_id FROM {W} w WHERE k % 4 <> 0) x) y WHERE r <= 50")
def _(t, spark, folder):
    return jobs.cohort(_unified(t), "f12_gas", "label_f12_available", 50, "1998-01-01").select("region_id", "sample_id", "split_group")


@q("job09_daily_benchmark", f"SELECT a.sample_id, CAST(a.date AS VARCHAR) AS date, round(a.value, 6) AS a_value, round(x.value, 6) AS value_plus_1d FROM {sql('daily_a')} a JOIN {sql('daily_b')} b ON a.sample_id = b.sample_id AND a.date = b.date LEFT JOIN {sql('daily_a')} x ON a.sample_id = x.sample_id AND x.date = a.date + 1")
def _(t, spark, folder):
    got = jobs.daily_benchmark({"a": t("daily_a"), "b": t("daily_b")}, ["a", "b"], "value", [1])
    return _out(got.select("sample_id", "date", "a_value", "value_plus_1d"))


@q("job13_layers", f"SELECT 'wells' AS layer, count(*) AS n_rows FROM {W} w UNION ALL SELECT 'scenes', count(*) FROM {S} s UNION ALL SELECT 'geology', count(*) FROM {sql('geology')} g")
def _(t, spark, folder):
    return summaries.layer_counts({n: t(n) for n in ("wells", "scenes", "geology")})


_IN_VIEW = "NOT (east < -80.5 OR west > -80 OR north < 39.5 OR south > 40)"
_VIEW = f"SELECT 'points' AS layer, CAST(k AS BIGINT) AS id, row_number() OVER (ORDER BY k) AS r, count(*) OVER () > 60 AS truncated, 60 AS most FROM {W} w WHERE longitude BETWEEN -80.5 AND -80 AND latitude BETWEEN 39.5 AND 40 UNION ALL SELECT 'scenes', scene_id, row_number() OVER (ORDER BY scene_id), count(*) OVER () > 60, 60 FROM {S} s WHERE {_IN_VIEW} UNION ALL SELECT 'geology', objectid, row_number() OVER (ORDER BY objectid), count(*) OVER () >= 60, 60 FROM (SELECT *, x0 AS west, x1 AS east, y0 AS south, y1 AS north FROM {sql('geology')} g) g WHERE {_IN_VIEW} UNION ALL SELECT 'prospects', k, row_number() OVER (ORDER BY latitude DESC, k), false, 25 FROM {W} w"


@q("job13_map_view", f"SELECT layer, CAST(id AS VARCHAR) AS id, CAST(truncated AS VARCHAR) AS truncated FROM ({_VIEW}) v WHERE r <= most")
def _(t, spark, folder):
    wells = t("wells").withColumn("id", F.col("k"))
    geology = t("geology").select(F.col("objectid").alias("id"), F.col("x0").alias("west"), F.col("x1").alias("east"), F.col("y0").alias("south"), F.col("y1").alias("north"))
    return _out(jobs.map_view(wells, t("scenes").withColumn("id", F.col("scene_id")), {"geology": geology}, wells.select("id", F.col("latitude").alias("score")), (-80.5, 39.5, -80.0, 40.0), 60, 25))


def _features(t):
    df = t("wells").withColumn("y", (F.col("latitude") + F.col("longitude") / 3 > 13.3).cast("int"))
    return sampling.split_by_date(df, "spud_date", "1998-06-01")


@q("ml02_logistic")
def _(t, spark, folder):
    return models.evaluate_and_refit(_features(t), "y", ["latitude", "longitude"], ["county_name"])[1]


@q("ml03_boosted_trees")
def _(t, spark, folder):
    rows = _features(t)
    model = models.classifier(rows.where("split_group = 'train'"), "y", ["latitude", "longitude"], ["county_name"], "trees", 5)
    return models.predict(model, rows.where("split_group = 'test'")).select("well_api", "score")


@q("ml06_score_cells")
def _(t, spark, folder):
    rows = _features(t)
    model = models.classifier(rows, "y", ["latitude", "longitude"], [])
    return models.score_cells(model, rows.select("well_api", "latitude", "longitude")).select("well_api", "score", "score_percentile", "prospect_tier")


@q("ml07_fused")
def _(t, spark, folder):
    """The label's number times ten from a number that tells nothing, and with the whole vector besides."""
    e = t("embeddings").where("label IS NOT NULL").select("vec_id", F.col("embedding").alias("v"), (F.col("label") * 10.0).alias("target"), (F.col("vec_id") % 7).cast("double").alias("x"))
    return models.compare_fused(e.withColumn("split_group", F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train")), "target", ["x"], [], "v")


@q("ml08_probe")
def _(t, spark, folder):
    e = t("embeddings").select("vec_id", "embedding", (F.get("embedding", F.lit(0)) > 0).cast("int").alias("y"))
    return models.probe_scores(models.probe(e, "embedding", "y"), e, "embedding").select("vec_id", "score")


_PROBED = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) + 2 * CAST(embedding[1] AS DOUBLE) AS y FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) >= 3"


@q(
    "ml08_ridge_probe",
    f"""WITH e AS ({_PROBED}), z AS (SELECT vec_id, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS p, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS q, y, avg(y) OVER () AS m FROM e),
    s AS (SELECT sum(p * p) + 1 AS pp, sum(q * q) + 1 AS qq, sum(p * q) AS pq, sum(p * (y - m)) AS py, sum(q * (y - m)) AS qy FROM z)
    SELECT vec_id, round(m + p * (py * qq - qy * pq) / (pp * qq - pq * pq) + q * (qy * pp - py * pq) / (pp * qq - pq * pq), 6) AS score FROM z, s""",
)
def _(t, spark, folder):
    """A ridge probe (alpha 1) on two scaled components; SQL solves its normal equations."""
    e = t("embeddings").where("size(embedding) >= 3").select("vec_id", F.slice("embedding", 1, 2).alias("v"), (F.get("embedding", F.lit(2)).cast("double") + 2 * F.get("embedding", F.lit(0)).cast("double")).alias("y"))
    return _out(models.probe_scores(models.probe(e, "v", "y", "ridge", 1.0), e, "v").select("vec_id", "score"))


@q("str01_upsert_stream", f"SELECT id, CAST(day AS VARCHAR) AS day, round(value, 6) AS value FROM (SELECT id, day, value FROM {sql('catalog_new')} n UNION ALL SELECT id, day, value FROM {sql('catalog_old')} o WHERE id NOT IN (SELECT id FROM {sql('catalog_new')} n)) u")
def _(t, spark, folder):
    """Old rows come first, fresh ones in a second micro-batch; base and delta are merged when they are read."""
    path, source = scratch(spark, "catalog"), scratch(spark, "source")
    for name in ("catalog_old", "catalog_new"):
        df = t(name)
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        refresh.upsert_stream(stream, path, ["id"], f"{path}_progress", compact_every=1 if name == "catalog_old" else 16).trigger(availableNow=True).start().awaitTermination()
    return _out(refresh.catalog(spark, path, ["id"]))


@q("gen02_equal_area_grid", f"WITH b AS (SELECT CAST(floor(min(longitude) * 1e5 / 2e4) AS BIGINT) AS x0, CAST(ceil(max(longitude) * 1e5 / 2e4) AS BIGINT) AS x1, CAST(floor(min(latitude) * 1e5 / 2e4) AS BIGINT) AS y0, CAST(ceil(max(latitude) * 1e5 / 2e4) AS BIGINT) AS y1 FROM {W} w) SELECT grid_x, grid_y, round(degrees(grid_x * 2e4 / (6378137.0::DOUBLE * sqrt(0.75::DOUBLE) / sqrt(1 - 0.00669437999014::DOUBLE * 0.25))), 6) AS longitude FROM (SELECT unnest(range(x0, x1 + 1)) AS grid_x FROM b) a, (SELECT unnest(range(y0, y1 + 1)) AS grid_y FROM b) c")
def _(t, spark, folder):
    """A 20 km grid over the wells' extent, taken as 100 km for a degree."""
    r = t("wells").agg(F.min("longitude"), F.min("latitude"), F.max("longitude"), F.max("latitude")).first()
    grid = summaries.equal_area_grid(spark, tuple(x * 1e5 for x in r), 2e4)
    return grid.select("grid_x", "grid_y", F.round("longitude", 6).alias("longitude"))


_K0 = "(sqrt(0.75::DOUBLE) / sqrt(1 - 0.00669437999014::DOUBLE * 0.25))"


def _northing(lat: str) -> str:
    """Northing of the equal-area projection in SQL."""
    e = "sqrt(0.00669437999014::DOUBLE)"
    s_ = f"sin(radians({lat}))"
    return f"(6378137.0::DOUBLE * (1 - {e} * {e}) * ({s_} / (1 - {e} * {e} * {s_} * {s_}) - ln((1 - {e} * {s_}) / (1 + {e} * {s_})) / (2 * {e})) / (2 * {_K0}))"


# rectangles stay rectangles in this projection, so the oracle tests each grid point against each tile's projected sides
_EAST = lambda lon: f"(6378137.0::DOUBLE * {_K0} * radians({lon}))"
_LAND = f"SELECT objectid, map_symbol, name, {_EAST('x0')} AS w, {_EAST('x1')} AS e, {_northing('y0')} AS s, {_northing('y1')} AS n, {_EAST('x0 + 0.1')} AS hw, {_EAST('x0 + 0.3')} AS he, {_northing('y0 + 0.1')} AS hs, {_northing('y0 + 0.3')} AS hn FROM {sql('geology')} g"
_SPACING = 4000.0
_ON_LAND = f"""SELECT grid_x, grid_y, min({{'continent': map_symbol, 'country': name}}) AS b FROM ({_LAND}) l, (SELECT unnest(range(CAST(floor((SELECT min(w) FROM ({_LAND}) z) / {_SPACING}) AS BIGINT), CAST(ceil((SELECT max(e) FROM ({_LAND}) z) / {_SPACING}) AS BIGINT) + 1)) AS grid_x) a,
(SELECT unnest(range(CAST(floor((SELECT min(s) FROM ({_LAND}) z) / {_SPACING}) AS BIGINT), CAST(ceil((SELECT max(n) FROM ({_LAND}) z) / {_SPACING}) AS BIGINT) + 1)) AS grid_y) c
WHERE grid_x * {_SPACING} BETWEEN w AND e AND grid_y * {_SPACING} BETWEEN s AND n AND NOT (objectid % 3 = 0 AND grid_x * {_SPACING} > hw AND grid_x * {_SPACING} < he AND grid_y * {_SPACING} > hs AND grid_y * {_SPACING} < hn) GROUP BY 1, 2"""
_BAND_OF = f"CASE WHEN grid_y * {_SPACING} >= {_northing('40.0::DOUBLE')} THEN 'lat_p40_p41' ELSE 'lat_p39_p40' END"
_CANDIDATES = f"(SELECT concat('cand_004km_xm', lpad(CAST(-grid_x AS VARCHAR), 6, '0'), '_yp', lpad(CAST(grid_y AS VARCHAR), 6, '0')) AS region_id, concat(b.continent, '__', {_BAND_OF}) AS bucket_id, grid_x, grid_y, b.country AS country_bucket FROM ({_ON_LAND}) o)"


@q("job11_candidates", f"SELECT q.region_id, q.bucket_id, c.country_bucket, c.grid_x, c.grid_y, round(degrees((c.grid_x * {_SPACING} - 1000) / (6378137.0::DOUBLE * {_K0})), 6) AS min_lon FROM ({_quota('SELECT 300', 0.5, 'region', _CANDIDATES)}) q JOIN {_CANDIDATES} c ON q.region_id = c.region_id")
def _(t, spark, folder):
    """Regions of 2 km on a 4 km grid over the tiles of geology."""
    land = _polygons(t).join(t("geology").select("objectid", "name"), "objectid").select(F.col("objectid").alias("land_id"), F.col("map_symbol").alias("continent_bucket"), F.col("name").alias("country_bucket"), "parts")
    got = jobs.candidate_regions(land, 4000.0, 2000.0, 300, 0.5, 1.0, "cand")
    return _out(got.select("region_id", "bucket_id", "country_bucket", "grid_x", "grid_y", "min_lon"))


_TITLE = "array_to_string(list_transform(string_split(lower(county_name), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ')"


@q("job01_canonical", f"SELECT 'wells' AS tab, well_api AS id, {_TITLE} AS a, well_status AS b, CAST(spud_date AS VARCHAR) AS day, round(latitude, 6) AS x FROM {W} w UNION ALL SELECT 'permits', CAST(authorization_id AS VARCHAR), well_api, county_name, CAST(permit_issued_date AS VARCHAR), round(latitude, 6) FROM {P} p UNION ALL SELECT 'production', permit_num, production_scope, NULL, CAST(production_period_start_date AS VARCHAR), round(gas_quantity, 6) FROM {sql('production')} p")
def _(t, spark, folder):
    """Rows of all three tables, beside each other."""
    tables = jobs.canonical_tables(t("wells"), t("permits"), t("production"))
    wells = tables["wells"].select(F.lit("wells").alias("tab"), F.col("well_api").alias("id"), F.col("county_name").alias("a"), F.col("well_status").alias("b"), F.col("spud_date").cast("string").alias("day"), F.col("latitude").alias("x"))
    permits = tables["permits"].select(F.lit("permits"), F.col("authorization_id").cast("string"), "well_api", "county_name", F.col("permit_issued_date").cast("string"), "latitude")
    production = tables["production"].select(F.lit("production"), "well_api", "production_scope", F.lit(None).cast("string"), F.col("period_start_date").cast("string"), "gas_quantity")
    return _out(wells.union(permits).union(production))


_BINS = f"SELECT l.sample_id, year(seen_at) AS y, floor((dayofyear(CAST(seen_at AS DATE)) - 1) / 10) AS bin, collection IN ('view', 'click') AS s2 FROM {sql('locations')} l JOIN {S} s ON l.longitude BETWEEN west AND east AND l.latitude BETWEEN south AND north"


@q("job10_observation_plan", f"SELECT concat(sample_id, '__year_', CAST(y AS VARCHAR)) AS sequence_id, count(*) AS n_bins, CAST(sum(a::INT) AS BIGINT) AS n_s2, CAST(sum(b::INT) AS BIGINT) AS n_s1, CAST(sum((a AND b)::INT) AS BIGINT) AS n_paired FROM (SELECT sample_id, y, bin, bool_or(s2) AS a, bool_or(NOT s2) AS b FROM ({_BINS}) x GROUP BY 1, 2, 3) z GROUP BY 1")
def _(t, spark, folder):
    scenes = t("scenes")
    optical = F.col("collection").isin("view", "click")
    return jobs.observation_plan(t("locations"), scenes.where(optical), scenes.where(~optical), 10, 3, 37)[1].select("sequence_id", "n_bins", "n_s2", "n_s1", "n_paired")


@q("job12_regional_manifest", f"SELECT x.sample_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split, t.tile_id, t.role, w.n_support, w.n_halo FROM (SELECT sample_id, {_frac('tiles', 'sample_id')} AS u FROM {sql('locations')} l) x JOIN ({_TILES}) t ON t.sample_id = x.sample_id LEFT JOIN ({_WINDOWS}) w ON w.target_id = t.tile_id")
def _(t, spark, folder):
    """Each tile with its centre's split and, where it is a target, its window's support."""
    tiles, windows = jobs.regional_manifest(t("locations"), "sample_id", 2, 2560.0, 1, 1)
    targets = windows.select(F.col("target_id").alias("tile_id"), "n_support", "n_halo")
    return tiles.join(targets, "tile_id", "left").select("sample_id", "split", "tile_id", "role", "n_support", "n_halo")


@q("ml04_regression_trees")
def _(t, spark, folder):
    rows = _features(t).withColumn("target", F.col("k") * 10.0)
    model = models.regressor(rows.where("split_group = 'train'"), "target", ["latitude", "longitude"], ["county_name"], trees=5)
    return models.predict(model, rows.where("split_group = 'test'"), "y_pred", "log1p").select("well_api", "y_pred")


@q("ord04_importances")
def _(t, spark, folder):
    model = models.classifier(_features(t), "y", ["latitude", "longitude"], [], "trees", 5)
    return spark.createDataFrame([(n, float(v)) for n, v in models.importances(model, ["latitude", "longitude"])], "feature string, importance double")


@q("snk01_csv_round_trip", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t, spark, folder):
    path = scratch(spark, "orders") + ".csv"
    sinks.write_table(t("orders").select("o_orderkey", "o_orderstatus"), path)
    return readers.read_table(spark, path).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus")


@q("str03_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _(t, spark, folder):
    source, out = scratch(spark, "index"), scratch(spark, "seen")
    rows = t("events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    rows.write.parquet(source)
    stream = refresh.first_seen(spark.readStream.schema(rows.schema).parquet(source), "at", ["user_id", "event_type"])
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}_progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type")


@q("str02_binned_stream", """SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, user_id, CAST(floor((dayofyear(CAST(ts AS DATE)) - 1) / 10) AS INTEGER) AS bin, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY GROUP BY 1, 2, 3""")
def _(t, spark, folder):
    """All events in a first run, one late row in a second from the same checkpoint: days that the watermark has closed are told once, and the late row changes none."""
    source, out = scratch(spark, "events"), scratch(spark, "bins")
    rows = t("events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    late = rows.agg(F.min_by(F.struct("user_id", "at"), "at").alias("r")).select("r.*")
    for batch in (rows, late):
        batch.write.mode("append").parquet(source)
        stream = refresh.binned_counts(spark.readStream.schema(rows.schema).parquet(source), "at", "user_id", 10)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}_progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("day").cast("date").cast("string").alias("day"), "user_id", "bin", F.col("count").alias("n"))


@q("src06_chunk_files", f"SELECT well_api, county_name FROM {W} w WHERE k >= 0")
def _(t, spark, folder):
    """A list of chunk files, each a collection."""
    path = scratch(spark, "chunks")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("well_api").alias("WellAPI"), F.col("county_name").alias("County Name")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"))
    _collection(t("wells"), feature, F.floor(F.col("k") / 2000), path)
    files = [r.f for r in spark.read.text(path).select(F.col("_metadata.file_path").alias("f")).distinct().orderBy("f").collect()]
    return readers.read_features(spark, files).select("well_api", "county_name")
