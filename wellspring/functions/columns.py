"""Column cleaners: each takes and gives Columns, so that Catalyst sees plain expressions. Bad values become null, never NaN or an error."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for true and false.
TRUE_TEXTS, FALSE_TEXTS = ("yes", "y", "true", "1"), ("no", "n", "false", "0")
#: Well statuses.
DEVELOPED = ("Active", "Plugged OG Well", "Regulatory Inactive Status", "Abandoned")
EXCLUDED = ("Operator Reported Not Drilled", "Proposed But Never Materialized", "Duplicate")
#: Thresholds of the first-life labels.
F12_THRESHOLDS, F24_THRESHOLDS = (100_000, 250_000, 500_000, 1_000_000, 2_000_000), (250_000, 500_000, 1_000_000, 2_000_000, 5_000_000)
#: Tiers by percentile, the smallest percentile of each.
PROSPECT_TIERS = ((0.9, "very_high"), (0.7, "high"), (0.4, "medium"), (None, "background"))
SAMPLE_TIERS = ((0.99, "tier_1"), (0.95, "tier_2"), (0.90, "tier_3"), (None, "tier_4"))
#: Date formats that are tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/MM/dd", "yyyyMMdd")
#: Texts that stand for nothing, in flags, in names, and in buckets.
NO_FLAG, NO_NAME, NO_BUCKET = ("", "nan", "<na>"), ("", "nan", "NA", "<NA>"), ("", "nan", "none")
EARTH_KM = 6371.0088


def snake_name(name: str) -> str:
    """NRM-01 for column names: camel humps and other signs become single underscores, all lower."""
    words = re.sub(r"[^A-Za-z0-9]+", "_", name.strip())
    return re.sub(r"_+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", words)).strip("_").lower()


def snake_value(c: Column) -> Column:
    """NRM-01 for values."""
    c = F.regexp_replace(F.trim(c), "[^A-Za-z0-9]+", "_")
    c = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_+|_+$", ""))


def to_bool(c: Column) -> Column:
    """NRM-02: known texts only, else null."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False)


def to_day(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """NRM-03: the first format that fits."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats])


def epoch_ms_day(c: Column) -> Column:
    """NRM-04: UTC date of epoch milliseconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(number(c) / 86_400_000).cast("int"))


def number(c: Column) -> Column:
    """NRM-05: double or null."""
    return c.try_cast("double")


def county_code(c: Column) -> Column:
    """NRM-06: at least three digits; longer codes stay whole."""
    text = number(c).cast("long").cast("string")
    return F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)


def clean_flag(c: Column) -> Column:
    """NRM-07: trimmed, lower; placeholders are null."""
    text = F.lower(F.trim(c))
    return F.when(~text.isin(*NO_FLAG), text)


def clean_formation(c: Column) -> Column:
    """NRM-07: trimmed, case kept; placeholders are null."""
    text = F.trim(c)
    return F.when(~text.isin(*NO_NAME), text)


def well_id(c: Column, numeric: bool = False) -> Column:
    """NRM-08: whole numbers lose their fraction, blank text is null."""
    if numeric:
        finite = ~F.isnan(c) & (F.abs(c) < float("inf"))
        return F.when(finite & (c == F.floor(c)), c.cast("long").cast("string")).when(finite, c.cast("string"))
    return F.nullif(F.trim(c), F.lit(""))


def composite_well(api: Column, name: Column) -> Column:
    """NRM-09: api, and the name if there is one, its spaces as underscores."""
    part = F.regexp_replace(F.trim(name), " ", "_")
    return F.when(F.coalesce(part, F.lit("")) == "", api).otherwise(F.concat_ws("_", api, part))


def credible_spud(c: Column) -> Column:
    """NRM-10."""
    return F.when(c >= F.lit("1950-01-01").cast("date"), c)


def context_date(*chain: Column) -> Column:
    """NRM-11: the first of the chain that is known."""
    return F.coalesce(*chain)


def status_flags(status: Column, has_production: Column) -> dict[str, Column]:
    """NRM-12: developed, excluded, and trainable by the older rule (keeps excluded) and the newer (drops them)."""
    developed, excluded = F.coalesce(status.isin(*DEVELOPED), F.lit(False)), F.coalesce(status.isin(*EXCLUDED), F.lit(False))
    any_ = developed | F.coalesce(has_production, F.lit(False))
    return {"is_developed": developed, "is_excluded": excluded, "trainable_v0": any_, "trainable_v1": any_ & ~excluded}


def threshold_labels(value: Column, available: Column, prefix: str, thresholds) -> dict[str, Column]:
    """NRM-13: null where the label isn't available; a missing value is below every threshold."""
    return {f"{prefix}_ge_{t}": F.when(F.coalesce(available, F.lit(False)), F.coalesce(value >= t, F.lit(False))) for t in thresholds}


def bucket_slug(c: Column, default: str) -> Column:
    """NRM-14."""
    text = F.lower(F.trim(c))
    slug = F.translate(F.replace(text, F.lit("&"), F.lit("and")), "/- ", "___")
    return F.when(F.coalesce(text, F.lit("")).isin(*NO_BUCKET), default).otherwise(slug)


def _signed(c: Column, digits: int) -> Column:
    return F.concat(F.when(c < 0, "m").otherwise("p"), F.lpad(F.abs(c).cast("string"), digits, "0"))


def latitude_band(lat: Column, width: float) -> Column:
    """NRM-15."""
    start = (F.floor(lat / width) * width).cast("long")
    return F.concat(F.lit("lat_"), _signed(start, 2), F.lit("_"), _signed(start + int(width), 2))


def grid_group(lat: Column, lon: Column, size: float) -> Column:
    """NRM-16: row and column of a grid from the south-west corner."""
    return F.format_string("lat%04d_lon%04d", F.floor((lat + 90) / size), F.floor((lon + 180) / size))


def dem_tile(lat: Column, lon: Column) -> Column:
    """NRM-16: the one-degree elevation tile named by its north-west corner, for the north-western quarter."""
    return F.format_string("n%02dw%03d", F.ceil(lat), F.ceil(-lon))


def region_id(prefix: str, spacing_km: int, x: Column, y: Column) -> Column:
    """NRM-16."""
    return F.concat(F.lit(f"{prefix}_{spacing_km:03d}km_x"), _signed(x, 6), F.lit("_y"), _signed(y, 6))


def utm_epsg(lat: Column, lon: Column) -> Column:
    """NRM-17."""
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def year_day(year: Column, day: Column) -> Column:
    """NRM-18: date of a day of a year."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int"))


def iso_day_of_year(c: Column) -> Column:
    """NRM-18."""
    return F.dayofyear(F.to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def json_list(c: Column, kind: str = "string") -> Column:
    """NRM-19: malformed text is an empty list."""
    return F.coalesce(F.from_json(c, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def transform_target(c: Column, kind: str) -> Column:
    """NRM-20: "log1p" or "none"."""
    if kind not in ("log1p", "none"):
        raise ValueError(f"unknown transform {kind}")
    return F.log1p(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))) if kind == "log1p" else c


def inverse_target(c: Column, kind: str) -> Column:
    """NRM-20."""
    return F.expm1(c) if kind == "log1p" else c


def tier(percentile: Column, scale=PROSPECT_TIERS) -> Column:
    """NRM-21."""
    out = None
    for least, name in scale[:-1]:
        out = F.when(percentile >= least, name) if out is None else out.when(percentile >= least, name)
    return out.otherwise(scale[-1][1])


def reported_through_month(url: Column) -> Column:
    """NRM-22: 9 for a third-quarter file, else 12."""
    return F.when(F.upper(url).contains("Q3"), 9).otherwise(12)


def quarter_month(quarter: Column) -> Column:
    """NRM-23: middle month; an unknown quarter counts as the first."""
    return F.when(quarter.between(1, 4), quarter * 3 - 1).otherwise(2).cast("int")


def century(two_digits: Column) -> Column:
    """NRM-24."""
    return F.when(two_digits < 50, two_digits + 2000).otherwise(two_digits + 1900)


def valid_month(c: Column) -> Column:
    """NRM-24."""
    return F.when(c.between(1, 12), c)


def kelvin_to_celsius(c: Column) -> Column:
    """NRM-25."""
    return c - 273.15


def metres_to_mm(c: Column) -> Column:
    """NRM-25."""
    return c * 1000.0


def land_surface_celsius(raw: Column, qc: Column) -> Column:
    """NRM-25: scaled surface temperature where the two lowest quality bits are 0 or 1."""
    return F.when((raw > 0) & (qc.bitwiseAND(3) <= 1), raw * 0.02 - 273.15)


def normalized_difference(a: Column, b: Column) -> Column:
    """NRM-26: null where the sum is zero."""
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def stable_fraction(key: Column, seed: str) -> Column:
    """NRM-27: a number in [0, 1) from 52 bits of the md5 of seed::key, alike on every run and engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}::"), key.cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def sample_key(kind: str, key: Column) -> Column:
    """NRM-28: well::<api>, cell::<id>."""
    return F.concat(F.lit(f"{kind}::"), key.cast("string"))


def sequence_key(sample: Column, year: Column) -> Column:
    """NRM-28."""
    return F.concat(sample, F.lit("__year_"), year.cast("string"))


def file_safe(c: Column) -> Column:
    """NRM-28."""
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def production_scope(label: Column) -> Column:
    """NRM-29: the scope is in the report's label."""
    return F.when(F.lower(label).contains("unconventional"), "unconventional").otherwise("conventional")


def tile_of_item(item: Column) -> Column:
    """NRM-29: the third dotted token, if there is one."""
    return F.get(F.split(item, "\\."), F.lit(2))


def standardize(x: Column, mean: Column, std: Column, valid: Column) -> Column:
    """NRM-31: missing and invalid values take the mean."""
    return (F.coalesce(F.when(valid, x), mean) - mean) / (std + 1e-6)


def offset_lat_lon(lat: Column, lon: Column, dx_m: Column, dy_m: Column) -> tuple[Column, Column]:
    """NRM-32: the point at that distance and bearing on the sphere; longitude in [-180, 180)."""
    angle, bearing = F.sqrt(dx_m * dx_m + dy_m * dy_m) / (EARTH_KM * 1000), F.atan2(dx_m, dy_m)
    lat1, lon1 = F.radians(lat), F.radians(lon)
    sine = F.sin(lat1) * F.cos(angle) + F.cos(lat1) * F.sin(angle) * F.cos(bearing)
    lat2 = F.asin(F.least(F.greatest(sine, F.lit(-1.0)), F.lit(1.0)))
    lon2 = lon1 + F.atan2(F.sin(bearing) * F.sin(angle) * F.cos(lat1), F.cos(angle) - F.sin(lat1) * sine)
    return F.degrees(lat2), F.pmod(F.degrees(lon2) + 180, F.lit(360.0)) - 180


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """NRM-33."""
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def chebyshev(dx: Column, dy: Column) -> Column:
    """NRM-34."""
    return F.greatest(F.abs(dx), F.abs(dy))


def compass_role(dx: Column, dy: Column) -> Column:
    """NRM-34: centre, or the side on which an offset lies."""
    north = F.when(dy > 0, "north").when(dy < 0, "south").otherwise("")
    east = F.when(dx > 0, "east").when(dx < 0, "west").otherwise("")
    return F.when((dx == 0) & (dy == 0), "center").otherwise(F.concat(north, east))


def week_range(path: Column) -> tuple[Column, Column]:
    """NRM-35: first week and number of weeks of a file name such as ..._weeks_12_4.tif; null where there is none."""
    found = [F.regexp_extract(path, r"weeks?_(\d+)_(\d+)", k) for k in (1, 2)]
    return tuple(F.when(f != "", f.cast("int")) for f in found)


def tile_group(path: Column) -> Column:
    """NRM-35: the name without the row-column suffix that a tiled export adds."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.tif$", "")
    return F.regexp_replace(name, r"-\d{10}-\d{10}$", "")
