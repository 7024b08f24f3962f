"""Typed inputs derived from the given tables, written once for Spark SQL and for DuckDB, so that both engines start alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    """The few words in which the two engines' SQL differs."""

    folder: str | None = None  # of the Parquet files; None: DuckDB, where tables are views

    def t(self, name: str) -> str:
        return f"parquet.`{self.folder}/{name}.parquet`" if self.folder else name

    def u(self, prefix: str, key: str) -> str:
        """A number in [0, 1) that depends on the key only."""
        if self.folder:
            return f"(cast(conv(substring(md5(concat('{prefix}:', cast({key} AS string))), 1, 6), 16, 10) AS double) / 16777216D)"
        return f"(('0x' || substr(md5('{prefix}:' || {key}), 1, 6))::BIGINT / 16777216.0::DOUBLE)"

    def days(self, day: str, n: str) -> str:
        return f"date_add({day}, cast({n} AS int))" if self.folder else f"({day} + cast({n} AS INTEGER))"

    def month(self, ts: str) -> str:
        return f"cast(date_trunc('month', {ts}) AS date)"

    def apart(self, start: str, end: str) -> str:
        return f"datediff({end}, {start})" if self.folder else f"date_diff('day', {start}, {end})"

    def text(self, x: str) -> str:
        return f"cast({x} AS {'string' if self.folder else 'VARCHAR'})"

    def hours(self, ts: str) -> str:
        return f"cast(unix_seconds(cast({ts} AS timestamp)) AS bigint)" if self.folder else f"cast(floor(epoch({ts})) AS BIGINT)"


DUCK = Dialect()


def wells(d: Dialect) -> str:
    return f"""SELECT c_custkey AS k, {d.text('c_custkey')} AS well_api, n_name AS county_name,
    39 + 2 * {d.u('lat', 'c_custkey')} AS latitude, -81 + 2 * {d.u('lon', 'c_custkey')} AS longitude,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Active' WHEN 'FURNITURE' THEN 'Plugged OG Well' WHEN 'MACHINERY' THEN 'Abandoned' WHEN 'BUILDING' THEN 'Duplicate' ELSE 'Proposed But Never Materialized' END AS well_status,
    {d.days("DATE '1995-01-01'", '(c_custkey * 37) % 2000')} AS spud_date, c_custkey % 10 <> 0 AS unconventional
    FROM {d.t('customer')} JOIN {d.t('nation')} ON c_nationkey = n_nationkey"""


def permits(d: Dialect) -> str:
    return f"""SELECT o_orderkey AS authorization_id, w.well_api, w.county_name, w.latitude, w.longitude,
    cast(o_orderdate AS date) AS permit_issued_date, w.spud_date FROM {d.t('orders')} JOIN ({wells(d)}) w ON o_custkey = w.k"""


def production(d: Dialect) -> str:
    return f"""SELECT {d.text('o_custkey')} AS permit_num, {d.month('l_shipdate')} AS production_period_start_date,
    last_day(cast(l_shipdate AS date)) AS production_period_end_date, l_quantity AS gas_quantity, l_discount AS oil_quantity,
    CASE WHEN l_returnflag <> 'A' THEN 'unconventional' ELSE 'conventional' END AS production_scope
    FROM {d.t('lineitem')} JOIN {d.t('orders')} ON l_orderkey = o_orderkey"""


def monthly(d: Dialect) -> str:
    return f"""SELECT {d.text('o_custkey')} AS well_api, {d.month('l_shipdate')} AS period_start_date,
    sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS gas_quantity, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS oil_quantity,
    sum(l_quantity) AS water_quantity, cast(count(*) AS double) AS ngl_quantity
    FROM {d.t('lineitem')} JOIN {d.t('orders')} ON l_orderkey = o_orderkey GROUP BY 1, 2"""


def wide_months(d: Dialect) -> str:
    months = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    slots = ", ".join(f"sum(CASE WHEN month(period_start_date) = {k} THEN {q}_quantity END) AS {m}_{q}" for q in ("gas", "oil") for k, m in enumerate(months, 1))
    return f"SELECT well_api, year(period_start_date) AS year, {slots} FROM ({monthly(d)}) m GROUP BY 1, 2"


def wells_multi(d: Dialect) -> str:
    return f"""SELECT {d.text('o_custkey')} AS well_api, o_orderkey AS objectid, {d.text('o_orderkey % 7')} AS permit_id,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS record_date, nullif(o_orderpriority, '5-LOW') AS operator_name,
    cast(o_orderkey % 19 AS double) AS county, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS longitude FROM {d.t('orders')}"""


def scenes(d: Dialect) -> str:
    return f"""SELECT event_id AS scene_id, ts AS seen_at, {d.hours('ts')} AS epoch_s, CASE WHEN event_id % 17 = 0 THEN NULL ELSE cast(value AS double) END AS cloud_cover, user_id AS grid_code, event_type AS collection,
    -81 + 2 * {d.u('slon', 'user_id')} - 0.15 AS west, -81 + 2 * {d.u('slon', 'user_id')} + 0.15 AS east,
    39 + 2 * {d.u('slat', 'user_id')} - 0.15 AS south, 39 + 2 * {d.u('slat', 'user_id')} + 0.15 AS north FROM {d.t('events')}"""


def locations(d: Dialect) -> str:
    return f"SELECT {d.text('s_suppkey')} AS sample_id, 39 + 2 * {d.u('llat', 's_suppkey')} AS latitude, -81 + 2 * {d.u('llon', 's_suppkey')} AS longitude FROM {d.t('supplier')}"


def daily(d: Dialect, kind: str) -> str:
    return f"SELECT {d.text('user_id')} AS sample_id, cast(ts AS date) AS date, avg(value) AS value, cast(count(*) AS double) AS image_count FROM {d.t('events')} WHERE event_type = '{kind}' GROUP BY 1, 2"


def daily_a(d: Dialect) -> str:
    return daily(d, "view")


def daily_b(d: Dialect) -> str:
    return daily(d, "click")


def daily_c(d: Dialect) -> str:
    return daily(d, "purchase")


def catalog_old(d: Dialect) -> str:
    return f"SELECT event_id AS id, cast(ts AS date) AS day, value FROM {d.t('events')} WHERE ts < TIMESTAMP '2024-01-20 00:00:00'"


def catalog_new(d: Dialect) -> str:
    return f"SELECT event_id AS id, cast(ts AS date) AS day, value + 1 AS value FROM {d.t('events')} WHERE ts >= TIMESTAMP '2024-01-17 00:00:00'"


def regions(d: Dialect) -> str:
    """A cell for each part key: the grid grows with the table."""
    return f"""SELECT p_partkey AS k, p_partkey % 40 AS grid_x, {'cast(floor(p_partkey / 40) AS bigint)' if d.folder else 'p_partkey // 40'} AS grid_y, concat(p_type, '') AS bucket_id,
    concat('r', {d.text('p_partkey')}) AS region_id FROM {d.t('part')} WHERE p_partkey % 13 <> 0"""


def geology(d: Dialect) -> str:
    """A 5 x 5 tiling of the wells' box, one tile for each nation: edges x0, x1, y0, y1."""
    row = "cast(floor(n_nationkey / 5) AS int)" if d.folder else "cast(n_nationkey // 5 AS INTEGER)"
    return f"""SELECT n_nationkey AS objectid, concat('M', {d.text('n_nationkey % 7')}) AS map_symbol, n_name AS name,
    -81 + 0.4 * (n_nationkey % 5) AS x0, -81 + 0.4 * (n_nationkey % 5) + 0.4 AS x1, 39 + 0.4 * {row} AS y0, 39 + 0.4 * {row} + 0.4 AS y1 FROM {d.t('nation')}"""


def dem(d: Dialect) -> str:
    return f"SELECT 't0' AS tile, {'cast(floor(p_partkey / 50) AS bigint)' if d.folder else 'p_partkey // 50'} AS r, p_partkey % 50 AS c, p_retailprice AS z FROM {d.t('part')}"


def scored(d: Dialect) -> str:
    return f"SELECT l.doc_id AS sample_id, l.quality AS y_true, (n_chars % 1000) / 1000.0{'D' if d.folder else '::DOUBLE'} AS score, lang AS region FROM {d.t('labels')} l JOIN {d.t('documents')} x ON l.doc_id = x.doc_id"


def reg_scored(d: Dialect) -> str:
    hundred = "100D" if d.folder else "100::DOUBLE"
    return f"SELECT o_orderkey AS sample_id, o_orderstatus AS region, o_totalprice AS y_true, o_totalprice * (1 + ((o_orderkey % 21) - 10) / {hundred}) AS y_pred FROM {d.t('orders')}"


def run_log(d: Dialect) -> str:
    return f"SELECT l_suppkey AS run_id, l_linenumber AS epoch, avg(l_discount) AS mean_loss, max(l_quantity) AS peak_mb FROM {d.t('lineitem')} GROUP BY 1, 2"


FIXTURES = {f.__name__: f for f in (wells, permits, production, monthly, wide_months, wells_multi, scenes, locations, daily_a, daily_b, daily_c, catalog_old, catalog_new, regions, geology, dem, scored, reg_scored, run_log)}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A fixture, or one of the given tables."""
    if name in FIXTURES:
        return spark.sql(FIXTURES[name](Dialect(folder)))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql(name: str) -> str:
    """The same for DuckDB, in brackets."""
    return f"({FIXTURES[name](DUCK)})" if name in FIXTURES else name
