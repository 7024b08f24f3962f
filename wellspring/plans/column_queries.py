"""One query for each column cleaner (NRM), over whole tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .fixtures import load, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, table: str, key: str, raw: dict[str, str], spark: dict, duck: dict[str, str]) -> None:
    """raw: SQL for input columns, alike in both engines. spark: name -> function of the input Columns (or its result). duck: name -> SQL over the inputs."""

    def query(session: SparkSession, folder: str) -> DataFrame:
        df = load(session, folder, table).selectExpr(f"{key} AS k", *[f"{e} AS {c}" for c, e in raw.items()])
        cols = {c: F.col(c) for c in raw}
        return df.select("k", *[(f(cols) if callable(f) else f).alias(out) for out, f in spark.items()])

    QUERIES[name] = query
    inner = ", ".join([f"{key} AS k", *[f"{e} AS {c}" for c, e in raw.items()]])
    SQL[name] = f"SELECT k, {', '.join(f'{e} AS {out}' for out, e in duck.items())} FROM (SELECT {inner} FROM {sql(table)} AS base) AS x"


def _texts(key: str, *values: str | None) -> str:
    """A CASE that deals the values out by key."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)}" for i, v in enumerate(values)) + " END"


def _text(c: Column) -> Column:
    return c.cast("string")


_add("nrm01_snake_case", "customer", "c_custkey", {"a": _texts("c_custkey", " WellAPI Number ", "SurfLat/Lon", "gas__quantity", "Year 1", "A-B_c")}, {"snake": lambda c: C.snake_value(c["a"])},
     {"snake": "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(a), '[^A-Za-z0-9]+', '_', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'))"})
_add("nrm02_bool", "customer", "c_custkey", {"a": _texts("c_custkey", "Yes", " y", "TRUE", "1", "no", "N ", "false", "0", "maybe", "", None)}, {"flag": lambda c: _text(C.to_bool(c["a"]))},
     {"flag": "CASE WHEN lower(trim(a)) IN ('yes','y','true','1') THEN 'true' WHEN lower(trim(a)) IN ('no','n','false','0') THEN 'false' END"})
_add("nrm03_dates", "orders", "o_orderkey", {"a": _texts("o_orderkey", "2020-02-29", "7/4/2019", "2021/03/01", "20180506", "nonsense", "2019-02-30", None)}, {"day": lambda c: _text(C.to_day(c["a"]))},
     {"day": "CAST(coalesce(try_strptime(a, '%Y-%m-%d'), try_strptime(a, '%-m/%-d/%Y'), try_strptime(a, '%Y/%m/%d'), try_strptime(a, '%Y%m%d'))::DATE AS VARCHAR)"})
_add("nrm04_epoch_ms", "events", "event_id", {"a": "CASE WHEN event_id % 9 = 0 THEN 'x' ELSE concat('', event_id * 86399999) END"}, {"day": lambda c: _text(C.epoch_ms_day(c["a"]))},
     # ISO 8601 signs years of more than four digits; DuckDB's text does not
     {"day": "CASE WHEN floor(TRY_CAST(a AS DOUBLE) / 86400000) >= 2932897 THEN '+' ELSE '' END || CAST(DATE '1970-01-01' + CAST(floor(TRY_CAST(a AS DOUBLE) / 86400000) AS INTEGER) AS VARCHAR)"})
_add("nrm05_numbers", "customer", "c_custkey", {"a": "CASE WHEN c_custkey % 5 = 0 THEN 'n/a' WHEN c_custkey % 5 = 1 THEN NULL ELSE concat('', c_acctbal) END"}, {"number": lambda c: C.number(c["a"])}, {"number": "TRY_CAST(a AS DOUBLE)"})
_add("nrm06_county_code", "customer", "c_custkey", {"a": "CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE concat('', c_custkey) END"}, {"code": lambda c: C.county_code(c["a"])},
     {"code": "CASE WHEN TRY_CAST(a AS DOUBLE) IS NULL THEN NULL WHEN length(CAST(TRY_CAST(a AS BIGINT) AS VARCHAR)) < 3 THEN lpad(a, 3, '0') ELSE a END"})
_add("nrm07_flags", "customer", "c_custkey", {"a": _texts("c_custkey", " Yes ", "NaN", "<NA>", "", "NA", "Marcellus ", None)}, {"flag": lambda c: C.clean_flag(c["a"]), "formation": lambda c: C.clean_formation(c["a"])},
     {"flag": "CASE WHEN lower(trim(a)) NOT IN ('', 'nan', '<na>') THEN lower(trim(a)) END", "formation": "CASE WHEN trim(a) NOT IN ('', 'nan', 'NA', '<NA>') THEN trim(a) END"})
_add("nrm08_well_id", "customer", "c_custkey", {"a": "CASE WHEN c_custkey % 6 = 0 THEN c_custkey + 0.5e0 ELSE c_custkey * 1e0 END", "b": _texts("c_custkey", " 37-1 ", "", "  ", "x")}, {"number_id": lambda c: C.well_id(c["a"], True), "text_id": lambda c: C.well_id(c["b"])},
     {"number_id": "CASE WHEN a = floor(a) THEN CAST(CAST(a AS BIGINT) AS VARCHAR) ELSE CAST(a AS VARCHAR) END", "text_id": "nullif(trim(b), '')"})
_add("nrm09_composite_well", "part", "p_partkey", {"a": "concat('34', p_partkey)", "b": "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN ' ' ELSE p_name END"}, {"key": lambda c: C.composite_well(c["a"], c["b"])},
     {"key": "CASE WHEN coalesce(trim(b), '') = '' THEN a ELSE concat(a, '_', replace(trim(b), ' ', '_')) END"})
_add("nrm10_credible_spud", "wells", "well_api", {"a": "CASE WHEN k % 3 = 0 THEN DATE '1949-12-31' ELSE spud_date END"}, {"spud": lambda c: _text(C.credible_spud(c["a"]))}, {"spud": "CAST(CASE WHEN a >= DATE '1950-01-01' THEN a END AS VARCHAR)"})
_add("nrm11_context_date", "wells", "well_api", {"a": "CASE WHEN k % 2 = 0 THEN spud_date END", "b": "CASE WHEN k % 3 = 0 THEN DATE '2001-02-03' END"}, {"context": lambda c: _text(C.context_date(c["a"], c["b"]))}, {"context": "CAST(coalesce(a, b) AS VARCHAR)"})
_add("nrm12_status_flags", "wells", "well_api", {"s": "well_status", "p": "CASE WHEN k % 3 = 0 THEN true WHEN k % 3 = 1 THEN false END"},
     {n: (lambda c, n=n: _text(C.status_flags(c["s"], c["p"])[n])) for n in ("is_developed", "is_excluded", "trainable_v0", "trainable_v1")},
     {"is_developed": "CAST(s IN ('Active','Plugged OG Well','Abandoned') AS VARCHAR)", "is_excluded": "CAST(s IN ('Duplicate','Proposed But Never Materialized') AS VARCHAR)", "trainable_v0": "CAST(s IN ('Active','Plugged OG Well','Abandoned') OR coalesce(p, false) AS VARCHAR)",
      "trainable_v1": "CAST((s IN ('Active','Plugged OG Well','Abandoned') OR coalesce(p, false)) AND s NOT IN ('Duplicate','Proposed But Never Materialized') AS VARCHAR)"})
_add("nrm13_threshold_labels", "orders", "o_orderkey", {"v": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice * 10 END", "a": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 4 = 1 END"},
     {f"f12_ge_{t}": (lambda c, t=t: _text(C.threshold_labels(c["v"], c["a"], "f12", [t])[f"f12_ge_{t}"])) for t in C.F12_THRESHOLDS}, {f"f12_ge_{t}": f"CASE WHEN a THEN CAST(coalesce(v >= {t}, false) AS VARCHAR) END" for t in C.F12_THRESHOLDS})
_add("nrm14_bucket_slug", "part", "p_partkey", {"a": "CASE WHEN p_partkey % 5 = 0 THEN 'nan' WHEN p_partkey % 5 = 1 THEN concat(p_type, ' & ', p_brand) ELSE concat(p_name, '/', p_type, '-x') END"}, {"slug": lambda c: C.bucket_slug(c["a"], "unknown")},
     {"slug": "CASE WHEN lower(trim(a)) IN ('', 'nan', 'none') THEN 'unknown' ELSE translate(replace(lower(trim(a)), '&', 'and'), '/- ', '___') END"})
_add("nrm15_latitude_band", "wells", "well_api", {"lat": "latitude - 40"}, {"band": lambda c: C.latitude_band(c["lat"], 5)},
     {"band": "concat('lat_', CASE WHEN floor(lat/5) < 0 THEN 'm' ELSE 'p' END, lpad(CAST(CAST(abs(floor(lat/5)*5) AS BIGINT) AS VARCHAR), 2, '0'), '_', CASE WHEN floor(lat/5)*5+5 < 0 THEN 'm' ELSE 'p' END, lpad(CAST(CAST(abs(floor(lat/5)*5+5) AS BIGINT) AS VARCHAR), 2, '0'))"})
_add("nrm16_grid_ids", "wells", "well_api", {"lat": "latitude", "lon": "longitude", "x": "k - 700"}, {"grid_group": lambda c: C.grid_group(c["lat"], c["lon"], 0.5), "dem_tile": lambda c: C.dem_tile(c["lat"], c["lon"]), "region_id": lambda c: C.region_id("p", 50, c["x"], c["x"] * 2)},
     {"grid_group": "printf('lat%04d_lon%04d', CAST(floor((lat+90)/0.5) AS BIGINT), CAST(floor((lon+180)/0.5) AS BIGINT))", "dem_tile": "printf('n%02dw%03d', CAST(ceil(lat) AS BIGINT), CAST(ceil(-lon) AS BIGINT))",
      "region_id": "concat('p_050km_x', CASE WHEN x < 0 THEN 'm' ELSE 'p' END, lpad(CAST(abs(x) AS VARCHAR), 6, '0'), '_y', CASE WHEN x < 0 THEN 'm' ELSE 'p' END, lpad(CAST(abs(x*2) AS VARCHAR), 6, '0'))"})
_add("nrm17_utm_epsg", "wells", "well_api", {"lat": "latitude - 40", "lon": "(longitude + 80) * 170"}, {"epsg": lambda c: C.utm_epsg(c["lat"], c["lon"]).cast("long")},
     {"epsg": "CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(greatest(floor((lon+180)/6)+1, 1), 60) AS BIGINT)"})
_add("nrm18_year_day", "events", "event_id", {"y": "2000 + event_id % 30", "d": "1 + event_id % 365", "s": "concat('20', 10 + event_id % 80, '-03-0', 1 + event_id % 9, 'T00:00:00Z')"}, {"day": lambda c: _text(C.year_day(c["y"], c["d"])), "doy": lambda c: C.iso_day_of_year(c["s"]).cast("long")},
     {"day": "CAST(make_date(CAST(y AS BIGINT), 1, 1) + CAST(d - 1 AS INTEGER) AS VARCHAR)", "doy": "CAST(dayofyear(CAST(substr(s, 1, 10) AS DATE)) AS BIGINT)"})
_add("nrm19_json_list", "events", "event_id", {"a": "CASE WHEN event_id % 4 = 0 THEN 'oops' WHEN event_id % 4 = 1 THEN NULL ELSE concat('[', event_id, ',', user_id, ']') END"}, {"n": lambda c: F.size(C.json_list(c["a"], "bigint")).cast("long"), "total": lambda c: F.aggregate(C.json_list(c["a"], "bigint"), F.lit(0).cast("long"), lambda s, x: s + x)},
     {"n": "CASE WHEN a LIKE '[%' THEN 2 ELSE 0 END", "total": "CASE WHEN a LIKE '[%' THEN coalesce(CAST(list_sum(CAST(json_extract(a, '$[*]') AS BIGINT[])) AS BIGINT), 0) ELSE 0 END"})
_add("nrm20_target_transform", "orders", "o_orderkey", {"v": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END"}, {"logged": lambda c: F.round(C.transform_target(c["v"], "log1p"), 6), "back": lambda c: F.round(C.inverse_target(C.transform_target(c["v"], "log1p"), "log1p"), 2)},
     {"logged": "round(ln(1 + coalesce(v, 0)), 6)", "back": "round(coalesce(v, 0), 2)"})
_add("nrm21_tiers", "orders", "o_orderkey", {"p": "(o_orderkey % 1000) / 1000.0e0"}, {"prospect": lambda c: C.tier(c["p"]), "sample": lambda c: C.tier(c["p"], C.SAMPLE_TIERS)},
     {"prospect": "CASE WHEN p >= 0.9 THEN 'very_high' WHEN p >= 0.7 THEN 'high' WHEN p >= 0.4 THEN 'medium' ELSE 'background' END", "sample": "CASE WHEN p >= 0.99 THEN 'tier_1' WHEN p >= 0.95 THEN 'tier_2' WHEN p >= 0.9 THEN 'tier_3' ELSE 'tier_4' END"})
_add("nrm22_reported_month", "pages", "page_id", {"u": "concat(url, CASE WHEN page_id % 3 = 0 THEN '/q3_2020.zip' ELSE '/2020.zip' END)"}, {"month": lambda c: C.reported_through_month(c["u"]).cast("long")}, {"month": "CASE WHEN upper(u) LIKE '%Q3%' THEN 9 ELSE 12 END"})
_add("nrm23_quarter_month", "part", "p_partkey", {"q": "CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE p_partkey % 6 END"}, {"month": lambda c: C.quarter_month(c["q"]).cast("long")}, {"month": "CASE WHEN q BETWEEN 1 AND 4 THEN q * 3 - 1 ELSE 2 END"})
_add("nrm24_century", "part", "p_partkey", {"y": "p_partkey % 100", "m": "p_partkey % 15"}, {"year": lambda c: C.century(c["y"]), "month": lambda c: C.valid_month(c["m"])}, {"year": "CASE WHEN y < 50 THEN 2000 + y ELSE 1900 + y END", "month": "CASE WHEN m BETWEEN 1 AND 12 THEN m END"})
_add("nrm25_sensor_units", "events", "event_id", {"raw": "value * 160", "qc": "cast(event_id % 8 AS int)"}, {"celsius": lambda c: F.round(C.kelvin_to_celsius(c["raw"]), 6), "mm": lambda c: F.round(C.metres_to_mm(c["raw"]), 4), "surface": lambda c: F.round(C.land_surface_celsius(c["raw"], c["qc"]), 6)},
     {"celsius": "round(raw - 273.15::DOUBLE, 6)", "mm": "round(raw * 1000, 4)", "surface": "CASE WHEN raw > 0 AND (qc & 3) <= 1 THEN round(raw * 0.02::DOUBLE - 273.15::DOUBLE, 6) END"})
_add("nrm26_indices", "lineitem", "l_orderkey * 10 + l_linenumber", {"a": "l_discount", "b": "l_tax"}, {"ndvi": lambda c: F.round(C.normalized_difference(c["a"], c["b"]), 6)}, {"ndvi": "CASE WHEN a + b <> 0 THEN round((a - b) / (a + b), 6) END"})
_add("nrm27_stable_fraction", "customer", "c_custkey", {"a": "c_custkey"}, {"fraction": lambda c: C.stable_fraction(c["a"], "s")}, {"fraction": "('0x' || substr(md5('s::' || a), 1, 13))::BIGINT / 4503599627370496::DOUBLE"})
_add("nrm28_sample_keys", "wells", "well_api", {"a": "well_api", "y": "2000 + k % 20", "n": "county_name"}, {"sample": lambda c: C.sample_key("well", c["a"]), "sequence": lambda c: C.sequence_key(C.sample_key("well", c["a"]), c["y"]), "safe": lambda c: C.file_safe(F.concat(c["n"], F.lit("::/ x")))},
     {"sample": "concat('well::', a)", "sequence": "concat('well::', a, '__year_', CAST(y AS VARCHAR))", "safe": "regexp_replace(concat(n, '::/ x'), '[^A-Za-z0-9._-]+', '_', 'g')"})
_add("nrm29_scope_and_tile", "lineitem", "l_orderkey * 10 + l_linenumber", {"a": "CASE WHEN l_linenumber % 2 = 0 THEN 'Unconventional wells' ELSE 'All' END", "i": "CASE WHEN l_linenumber = 1 THEN 'a.b' ELSE concat('HLS.L30.T', l_linenumber, '.x') END"}, {"scope": lambda c: C.production_scope(c["a"]), "tile": lambda c: C.tile_of_item(c["i"])},
     {"scope": "CASE WHEN lower(a) LIKE '%unconventional%' THEN 'unconventional' ELSE 'conventional' END", "tile": "nullif(split_part(i, '.', 3), '')"})
_add("nrm31_standardize", "lineitem", "l_orderkey * 10 + l_linenumber", {"x": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END", "ok": "l_returnflag <> 'A'"}, {"z": lambda c: F.round(C.standardize(c["x"], F.lit(25.0), F.lit(14.0), c["ok"]), 6)}, {"z": "round((coalesce(CASE WHEN ok THEN x END, 25) - 25) / (14.0::DOUBLE + 1e-6), 6)"})
_add("nrm32_offset", "wells", "well_api", {"lat": "latitude", "lon": "longitude", "dx": "cast(k % 11 - 5 AS double) * 2560", "dy": "cast(k % 7 - 3 AS double) * 2560"}, {"lat2": lambda c: F.round(C.offset_lat_lon(c["lat"], c["lon"], c["dx"], c["dy"])[0], 6), "lon2": lambda c: F.round(C.offset_lat_lon(c["lat"], c["lon"], c["dx"], c["dy"])[1], 6)},
     {"lat2": "round(degrees(asin(sin(radians(lat))*cos(sqrt(dx*dx+dy*dy)/6371008.8::DOUBLE) + cos(radians(lat))*sin(sqrt(dx*dx+dy*dy)/6371008.8::DOUBLE)*cos(atan2(dx,dy)))), 6)",
      "lon2": "round(lon + degrees(atan2(sin(atan2(dx,dy))*sin(sqrt(dx*dx+dy*dy)/6371008.8::DOUBLE)*cos(radians(lat)), cos(sqrt(dx*dx+dy*dy)/6371008.8::DOUBLE) - sin(radians(lat))*(sin(radians(lat))*cos(sqrt(dx*dx+dy*dy)/6371008.8::DOUBLE) + cos(radians(lat))*sin(sqrt(dx*dx+dy*dy)/6371008.8::DOUBLE)*cos(atan2(dx,dy))))), 6)"})
_add("nrm33_haversine", "wells", "well_api", {"lat": "latitude", "lon": "longitude"}, {"km": lambda c: F.round(C.haversine_km(c["lat"], c["lon"], F.lit(40.0), F.lit(-80.0)), 6)},
     {"km": "round(2*6371.0088::DOUBLE*asin(sqrt(sin(radians(40-lat)/2)*sin(radians(40-lat)/2)+cos(radians(lat))*cos(radians(40))*sin(radians(-80-lon)/2)*sin(radians(-80-lon)/2))), 6)"})
_add("nrm34_offset_roles", "part", "p_partkey", {"dx": "p_partkey % 5 - 2", "dy": "p_partkey % 7 - 3"}, {"ring": lambda c: C.chebyshev(c["dx"], c["dy"]), "role": lambda c: C.compass_role(c["dx"], c["dy"])},
     {"ring": "greatest(abs(dx), abs(dy))", "role": "CASE WHEN dx = 0 AND dy = 0 THEN 'center' ELSE concat(CASE WHEN dy > 0 THEN 'north' WHEN dy < 0 THEN 'south' ELSE '' END, CASE WHEN dx > 0 THEN 'east' WHEN dx < 0 THEN 'west' ELSE '' END) END"})
_add("nrm35_file_names", "part", "p_partkey", {"p": "concat('/x/', p_partkey % 9, '/s_weeks_', p_partkey % 52, '_4', CASE WHEN p_partkey % 2 = 0 THEN '-0000000000-0000000256' ELSE '' END, '.tif')"}, {"week": lambda c: C.week_range(c["p"])[0].cast("long"), "weeks": lambda c: C.week_range(c["p"])[1].cast("long"), "tiles": lambda c: C.tile_group(c["p"])},
     {"week": "CAST(regexp_extract(p, 'weeks?_(\\d+)_(\\d+)', 1) AS BIGINT)", "weeks": "CAST(regexp_extract(p, 'weeks?_(\\d+)_(\\d+)', 2) AS BIGINT)", "tiles": "regexp_replace(regexp_replace(list_extract(string_split(p, '/'), -1), '\\.tif$', ''), '-\\d{10}-\\d{10}$', '')"})


def nrm30_sequential_ids(session: SparkSession, folder: str) -> DataFrame:
    """NRM-30: sample ids numbered from an offset in the order of a key."""
    from ..operators.ranking import number_rows

    rows = number_rows(load(session, folder, "wells").select("well_api", "k"), [F.col("k")], "n")
    return rows.select("well_api", F.concat(F.lit("s_"), F.lpad((F.col("n") + 999).cast("string"), 6, "0")).alias("sample_id"))


QUERIES["nrm30_sequential_ids"] = nrm30_sequential_ids
SQL["nrm30_sequential_ids"] = f"SELECT well_api, concat('s_', lpad(CAST(row_number() OVER (ORDER BY k) + 999 AS VARCHAR), 6, '0')) AS sample_id FROM {sql('wells')} w"
