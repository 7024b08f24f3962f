"""Readers. All go through Spark's own sources, so any path that Spark can open will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import century, number, snake_name, to_day
from .collections import feature_lines
from .scratch import materialize


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: Parquet or CSV by suffix; others are an error."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    raise ValueError(f"unknown table suffix: {path}")


def read_raw_csv(spark: SparkSession, path, encoding: str | None = None) -> DataFrame:
    """SRC-02: every column is text, the header is snake-cased, a byte-order mark is dropped. Without an encoding each file is UTF-8
    if all its lines are, else ISO-8859-1; columns of files of both kinds are matched by name."""

    def read(files, own: str) -> DataFrame:
        df = spark.read.option("header", True).option("inferSchema", False).option("encoding", own).option("multiLine", True).option("escape", '"').csv(files)
        return df.toDF(*[snake_name(c.lstrip("\ufeff").removeprefix("ï»¿")) for c in df.columns])

    if encoding:
        return read(path, encoding)
    # the text source doesn't decode, so lines still have the file's bytes; the driver has the list of files anyway
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    other = [r.file for r in lines.where("not valid").select("file").distinct().orderBy("file").collect()]
    if not other:
        return read(path, "UTF-8")
    good = [r.file for r in lines.where(~F.col("file").isin(other)).select("file").distinct().orderBy("file").collect()]
    latin = read(other, "ISO-8859-1")
    return read(good, "UTF-8").unionByName(latin, allowMissingColumns=True) if good else latin


def read_features(spark: SparkSession, path) -> DataFrame:
    """SRC-03: one row for each feature of GeoJSON collections, which any number of tasks read: snake-cased properties; longitude and latitude of points; the geometry's own JSON.
    path: one file, or a list or glob of chunk files (SRC-06)."""
    whole = spark.read.json(feature_lines(spark, path)).select(F.struct("*").alias("f"))
    names = whole.select("f.properties.*").columns
    geometry = F.col("f.geometry")
    point = F.when(geometry["type"] == "Point", F.from_json(F.to_json(geometry["coordinates"]), "array<double>"))
    return whole.select(*[F.col(f"f.properties.`{n}`").alias(snake_name(n)) for n in names], F.get(point, F.lit(0)).alias("longitude"), F.get(point, F.lit(1)).alias("latitude"), F.to_json(geometry).alias("geometry_json"))


def read_catalog(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    """SRC-04: one flat row for each scene of STAC item collections. Missing parts are null. schema: of a feature."""
    kind = schema or "id string, collection string, bbox array<double>, properties map<string,string>, assets map<string,struct<href:string>>, geometry string"
    rows = spark.read.schema(kind).json(feature_lines(spark, path)).select(F.struct("*").alias("f"))
    p = lambda k: F.try_element_at("f.properties", F.lit(k))
    return rows.select(
        F.col("f.id").alias("scene_id"), F.col("f.collection").alias("collection"), p("platform").alias("platform"), F.array_join(F.coalesce(F.from_json(p("instruments"), "array<string>"), F.array().cast("array<string>")), ";").alias("instruments"),
        F.try_to_timestamp(F.replace(p("datetime"), F.lit("Z"), F.lit(""))).alias("datetime"), p("eo:cloud_cover").try_cast("double").alias("cloud_cover"), p("s2:mgrs_tile").alias("grid_code"),
        *[F.get("f.bbox", F.lit(i)).alias(f"bbox_{n}") for i, n in enumerate(("west", "south", "east", "north"))], F.array_join(F.array_sort(F.map_keys("f.assets")), ";").alias("assets"), F.col("f.geometry").alias("geometry_json"),
    )


def geometry_bbox(geometry: Column) -> dict[str, Column]:
    """SRC-05: bounds of a geometry's coordinates at any depth: west, south, east, north; null without coordinates. geometry: JSON text. A position
    is an innermost array that begins with two numbers."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    text = F.get_json_object(geometry, "$.coordinates")
    xs, ys = (F.transform(F.regexp_extract_all(text, F.lit(rf"\[\s*{number}\s*,\s*{number}"), F.lit(k)), lambda v: v.cast("double")) for k in (1, 2))
    return {"west": F.array_min(xs), "south": F.array_min(ys), "east": F.array_max(xs), "north": F.array_max(ys)}


#: A polygon scene's properties in order, its links, and which of all columns are numbers or days.
SCENE_PROPERTIES = ("item_type", "acquired", "published", "updated", "cloud_cover", "cloud_percent", "clear_percent", "clear_confidence_percent", "visible_percent", "visible_confidence_percent", "gsd", "ground_control", "quality_category", "instrument", "satellite_id", "provider", "strip_id", "view_angle")
SCENE_LINKS = {"thumbnail": "thumbnail_href", "assets": "assets_href", "_self": "self_href"}
SCENE_NUMBERS = ("cloud_cover", "cloud_percent", "clear_percent", "clear_confidence_percent", "visible_percent", "visible_confidence_percent", "gsd", "view_angle")
SCENE_DAYS = ("acquired", "published", "updated")


def read_polygon_catalog(spark: SparkSession, path, source: str, checked_at: str | None = None) -> DataFrame:
    """SRC-05: one row for each scene of polygon-scene collections: source_id, scene_id, properties (numbers and days read leniently), links, the
    geometry's bounds and when the catalog was checked."""
    rows = spark.read.schema("id string, properties map<string,string>, _links map<string,string>, geometry string").json(feature_lines(spark, path))
    value = lambda m, k: F.try_element_at(m, F.lit(k))

    def typed(n: str) -> Column:
        c = value("properties", n)
        return (number(c) if n in SCENE_NUMBERS else to_day(F.substring(c, 1, 10)).cast("string") if n in SCENE_DAYS else c).alias(n)

    box = [c.alias(f"bbox_{n}") for n, c in geometry_bbox(F.col("geometry")).items()]
    return rows.select(F.lit(source).alias("source_id"), F.col("id").alias("scene_id"), *[typed(n) for n in SCENE_PROPERTIES], *[value("_links", k).alias(n) for k, n in SCENE_LINKS.items()], *box, F.lit(checked_at).alias("catalog_checked_at_utc"))


def read_manifested(spark: SparkSession, manifest: DataFrame, path: str, reader=read_raw_csv) -> DataFrame:
    """SRC-07: all files of a manifest (file, in folders or not, period_id, label) in one scan, each row with its file's period and label. File names differ; the manifest has a row for each file and is broadcast."""
    names = [r.file for r in manifest.select("file").distinct().orderBy("file").collect()]
    rows = reader(spark, [f"{path}/{n}" for n in names]).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.join(F.broadcast(manifest.withColumn("file", F.element_at(F.split("file", "/"), -1))), "file")


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-08."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_shards(spark: SparkSession, paths: list[str], key: list[str], order: list[Column]) -> DataFrame:
    """SRC-09: Parquet shards with one row for each key, the first in the order; no shard is an error."""
    from ..operators.ranking import best_of

    if not paths:
        raise ValueError("no shard files")
    return best_of(spark.read.parquet(*paths), key, order)


def packed_decimal(field: Column) -> Column:
    """SRC-10: COMP-3: the hex digits are the decimal digits, the last one the sign (D is minus). A bad digit counts as 0."""
    text = F.hex(field)
    digits = F.translate(F.substring(text, 1, F.length(text) - 1), "ABCDEF", "000000").try_cast("long")
    return F.when(F.substring(text, -1, 1) == "D", -digits).otherwise(digits)


def zoned_digits(field: Column) -> Column:
    """SRC-10: EBCDIC digits F0 .. F9 as text."""
    return F.regexp_replace(F.hex(field), "F(.)", "$1")


def read_mainframe(spark: SparkSession, path: str, record: int = 102, batch: int = 4096) -> DataFrame:
    """SRC-10: (file, part, position, kind, body) of the fixed-length records of one file, or all files of a folder or glob; the order within
    a file is part, position. Spark's own reader cuts a file into records, so one of any size is read by many tasks; Python hands on a batch of records as one value, which is cut up by Spark."""
    files = [r.path for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()]

    def of(file: str):
        def rows(i, records):
            held, base = [], 0
            for r in records:
                held.append(r)
                if len(held) == batch:
                    yield file, i, base, len(held), bytearray(b"".join(held))
                    held, base = [], base + batch
            if held:
                yield file, i, base, len(held), bytearray(b"".join(held))

        return spark.sparkContext.binaryRecords(file, record).mapPartitionsWithIndex(rows)

    df = spark.createDataFrame(spark.sparkContext.union([of(f) for f in files]) if files else [], "file string, part int, base int, n int, bodies binary")
    cut = df.select("file", "part", "base", "bodies", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    cut = cut.select("file", "part", (F.col("base") + F.col("k")).alias("position"), F.substring("bodies", F.col("k") * record + 1, F.lit(record)).alias("body"))
    return cut.withColumn("kind", zoned_digits(F.substring("body", 1, 2)))


def mainframe_production(records: DataFrame) -> DataFrame:
    """SRC-10, WIN-08: production records (15) with the root (01) and reporting cycle (14) before them; those before any root, or without
    a cycle since their root, are left out, as are months outside 1 to 12.

    Fixed values, bytes from 1: root: gas code 3, district 4-5, lease number 6-11; cycle: YYMM 3-6; production: gas 3-7, lift gas 8-12
    and condensate 13-17, packed decimal. A file's parts are few; each part's last root and cycle are carried into the next parts of that file by a window
    over its parts, so records are filled inside their own part and no task holds a file. Nothing is carried from file to file."""
    root = F.when(F.col("kind") == "01", F.struct(zoned_digits(F.substring("body", 4, 2)).alias("district"), zoned_digits(F.substring("body", 6, 6)).alias("lease")))
    cycle = F.when(F.col("kind") == "14", zoned_digits(F.substring("body", 3, 4)))
    amounts = F.when(F.col("kind") == "15", F.substring("body", 3, 15)).alias("amounts")  # of a record only what is asked for is sent to the window
    rows = records.select("file", "part", "position", root.alias("r"), cycle.alias("c"), amounts)
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("position"))
    ends = rows.groupBy("file", "part").agg(F.max_by("r", at("r")).alias("last_r"), F.max(at("r")).alias("r_at"), F.max_by("c", at("c")).alias("last_c"), F.max(at("c")).alias("c_at"))
    # a root without a cycle after it in its part ends what earlier parts said
    ends = ends.withColumn("last_c", F.when(F.col("c_at") > F.coalesce("r_at", F.lit(-1)), F.col("last_c")).when(F.col("r_at").isNotNull(), F.lit("")))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "part", F.last("last_r", True).over(before).alias("carried_r"), F.last("last_c", True).over(before).alias("carried_c"))
    # a number stands for file and part, so that no record carries the file's name
    carried = F.broadcast(materialize(carried.withColumn("piece", F.monotonically_increasing_id()), "carried"))
    upto = Window.partitionBy("piece").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.join(carried.select("file", "part", "piece"), ["file", "part"]).drop("file", "part")
    filled = filled.withColumns({"own_r": F.last("r", True).over(upto), "r_at": F.max(at("r")).over(upto), "own_c": F.last("c", True).over(upto), "c_at": F.max(at("c")).over(upto)})
    filled = filled.where("amounts is not null").join(carried, "piece")
    own = F.when(F.col("c_at") > F.coalesce("r_at", F.lit(-1)), F.col("own_c"))
    filled = filled.withColumns({"root": F.coalesce("own_r", "carried_r"), "cycle_key": F.coalesce(own, F.when(F.col("r_at").isNull(), F.nullif("carried_c", F.lit(""))))})
    amounts = [packed_decimal(F.substring("amounts", 1 + 5 * k, 5)).alias(n) for k, n in enumerate(("gas_mcf", "gas_lift_mcf", "condensate_bbl"))]
    year, month = century(F.substring("cycle_key", 1, 2).try_cast("int")), F.substring("cycle_key", 3, 2).try_cast("int")
    kept = filled.where("root is not null and cycle_key is not null").where(month.between(1, 12))
    return kept.select("file", "part", "position", "root.district", F.col("root.lease").alias("rrc_id"), "cycle_key", year.alias("production_year"), month.alias("production_month"), *amounts)


def archive_inventory(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: one row for each member of each ZIP archive; an unreadable archive gives none."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        out += [(name, m.filename, m.file_size) for m in z.infolist()]
                except zipfile.BadZipFile:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["archive", "member", "size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(members, "archive string, member string, size long")


def archive_tables(spark: SparkSession, path: str, scratch: str) -> dict[str, DataFrame]:
    """SRC-13: each CSV in the archives becomes a snake-cased table; the members' lines are written once, parted by data set."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for m in z.infolist():
                        if m.filename.lower().endswith(".csv"):
                            text = z.read(m).decode("utf-8-sig", "replace").splitlines()
                            name = snake_name(m.filename.rsplit("/", 1)[-1][:-4])
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(text)), pa.array(text, pa.string())], ["dataset", "value"])

    spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "dataset string, value string").write.partitionBy("dataset").text(scratch)
    names = [r.dataset for r in spark.read.text(scratch).select("dataset").distinct().orderBy("dataset").collect()]
    return {n: read_raw_csv(spark, f"{scratch}/dataset={n}") for n in names}


def asset_status(*manifests: tuple[str, DataFrame, str]) -> DataFrame:
    """SRC-12, SRC-14: (manifest, dataset, status, raw_path), distinct, from differing manifests: (name, table, column of the data set); the first known path column counts."""
    parts = []
    for name, df, dataset in manifests:
        paths = [F.col(c) for c in ("output_path", "tif_path", "local_path") if c in df.columns]
        status = F.col("status") if "status" in df.columns else F.lit(None).cast("string")
        parts.append(df.select(F.lit(name).alias("manifest"), F.col(dataset).cast("string").alias("dataset"), status.alias("status"), (F.coalesce(*paths) if paths else F.lit(None).cast("string")).alias("raw_path")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


#: Fields of a downloaded asset and of a composite in a raster manifest, in order; those in MEASURES are numbers.
ASSET_FIELDS = ("collection", "scene_id", "grid_code", "datetime", "cloud_cover", "platform", "asset_kind", "asset_role", "status", "href", "local_path", "file_size_bytes", "image_width", "image_height", "bbox_west", "bbox_south", "bbox_east", "bbox_north")
COMPOSITE_FIELDS = ("composite_id", "collection", "composite_kind", "rendering_method", "scene_count", "scene_ids", "image_path", "image_width", "image_height", "bbox_west", "bbox_south", "bbox_east", "bbox_north", "generated_at_utc")
MEASURES = ("cloud_cover", "scene_count", "file_size_bytes", "image_width", "image_height", "bbox_west", "bbox_south", "bbox_east", "bbox_north")


def read_raster_manifests(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: one row for each JSON manifest: source_id, checked_at_utc, downloads and composites; every inner field as text, so that no bad value spoils a manifest."""
    inner = lambda names: ", ".join(f"{n}: {'array<string>' if n == 'scene_ids' else 'string'}" for n in names)
    return spark.read.schema(f"source_id string, checked_at_utc string, downloads array<struct<{inner(ASSET_FIELDS)}>>, composites array<struct<{inner(COMPOSITE_FIELDS)}>>").json(path)


def _typed(item: str, names: tuple[str, ...]) -> list[Column]:
    return [(F.col(f"{item}.{n}").try_cast("double") if n in MEASURES else F.array_join(F.coalesce(F.col(f"{item}.{n}"), F.array().cast("array<string>")), ";") if n == "scene_ids" else F.col(f"{item}.{n}")).alias(n) for n in names]


def raster_assets(manifests: DataFrame) -> DataFrame:
    """SRC-14: one row for each downloaded asset; numbers that aren't are null."""
    return manifests.select("source_id", "checked_at_utc", F.explode("downloads").alias("a")).select("source_id", *_typed("a", ASSET_FIELDS), "checked_at_utc")


def raster_composites(manifests: DataFrame) -> DataFrame:
    """SRC-14: one row for each composite, its scene ids joined by ';'."""
    return manifests.select("source_id", F.explode("composites").alias("c")).select("source_id", *_typed("c", COMPOSITE_FIELDS))


def order_drafts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: one row for each JSON order draft: name, types, the first product's item type and bundle, and how many items it has."""
    drafts = spark.read.schema("name string, source_type string, order_type string, products array<struct<item_type: string, product_bundle: string, item_ids: array<string>>>").json(path)
    product = F.get("products", F.lit(0))
    return drafts.select(F.col("name").alias("draft_name"), "source_type", "order_type", product["item_type"].alias("item_type"), product["product_bundle"].alias("product_bundle"), F.coalesce(F.size(product["item_ids"]), F.lit(0)).alias("item_count"))
