"""Queries of labels, aggregates, joins, ranks, merges, samples, plans and metrics, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import projections
from ..operators import asof, life, lines, merging, metrics, observations, polygons, ranking, sampling, spatial, summaries
from .fixtures import load, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
R = 6371.0088


def q(name: str, oracle: str | None = None):
    """Register a function (load -> DataFrame) and its SQL. load(name) gives a fixture or a table."""

    def wrap(f):
        def query(spark: SparkSession, folder: str) -> DataFrame:
            return f(lambda t: load(spark, folder, t))

        query.__name__, query.__doc__ = name, f.__doc__
        QUERIES[name] = query
        if oracle:
            SQL[name] = oracle
        return f

    return wrap


def _out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates and booleans as text, whole numbers as long, doubles rounded: what both engines write alike."""
    kinds = {"date": lambda c: F.col(c).cast("string"), "boolean": lambda c: F.col(c).cast("string"), "int": lambda c: F.col(c).cast("long"), "double": lambda c: F.round(c, digits)}
    return df.select(*[kinds.get(t, F.col)(c).alias(c) for c, t in df.dtypes])


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2*{R}::DOUBLE*asin(sqrt(least(1.0, sin(radians({c}-{a})/2)*sin(radians({c}-{a})/2)+cos(radians({a}))*cos(radians({c}))*sin(radians({d}-{b})/2)*sin(radians({d}-{b})/2)))))"


W, P, PR, MO = sql("wells"), sql("permits"), sql("production"), sql("monthly")


@q("agg01_permits", f"SELECT well_api, count(*) AS permit_count, CAST(min(permit_issued_date) AS VARCHAR) AS first_permit_issued_date, CAST(max(permit_issued_date) AS VARCHAR) AS latest_permit_issued_date, CAST(min(spud_date) AS VARCHAR) AS first_permit_spud_date FROM {P} p GROUP BY 1")
def _(t):
    return _out(life.permit_summary(t("permits")))


_AGG02 = f"SELECT permit_num AS well_api, count(*) AS observed_rows, sum(gas_quantity) AS observed_gas, avg(gas_quantity) AS observed_gas_avg, max(gas_quantity) AS observed_gas_max, min(production_period_start_date) AS observed_first_prod_date, max(production_period_end_date) AS observed_last_prod_date FROM {PR} p WHERE production_scope = 'unconventional' GROUP BY 1"


@q("agg02_production", f"SELECT well_api, observed_rows, round(observed_gas, 6) AS observed_gas, round(observed_gas_avg, 6) AS observed_gas_avg, round(observed_gas_max, 6) AS observed_gas_max, CAST(observed_first_prod_date AS VARCHAR) AS observed_first_prod_date, CAST(observed_last_prod_date AS VARCHAR) AS observed_last_prod_date FROM ({_AGG02}) x")
def _(t):
    return _out(life.production_summary(t("production")))


_PRORATED = f"""WITH f AS (SELECT permit_num, min(production_period_start_date) AS s FROM {PR} p WHERE production_scope = 'unconventional' AND permit_num IN (SELECT well_api FROM {W} w) GROUP BY 1),
r AS (SELECT p.permit_num, f.s, gas_quantity AS g, date_diff('day', production_period_start_date, production_period_end_date) + 1 AS d, date_diff('day', greatest(production_period_start_date, f.s), least(production_period_end_date, f.s + 364)) + 1 AS o12, date_diff('day', greatest(production_period_start_date, f.s), least(production_period_end_date, f.s + 729)) + 1 AS o24 FROM {PR} p JOIN f ON p.permit_num = f.permit_num WHERE production_scope = 'unconventional'),
a AS (SELECT permit_num, s, sum(CASE WHEN o12 > 0 THEN g * o12 / d ELSE 0 END) AS f12_gas, sum(CASE WHEN o24 > 0 THEN g * o24 / d ELSE 0 END) AS f24_gas, sum(greatest(o12, 0)) AS c12, sum(greatest(o24, 0)) AS c24 FROM r GROUP BY 1, 2)
SELECT w.well_api, CAST(s AS VARCHAR) AS first_prod_date, round(f12_gas, 6) AS f12_gas, round(f24_gas, 6) AS f24_gas, CAST(c12 AS BIGINT) AS covered_days_f12, CAST(c24 AS BIGINT) AS covered_days_f24, CAST(coalesce(c12, 0) >= 330 AS VARCHAR) AS label_f12_available, CAST(coalesce(c24, 0) >= 695 AS VARCHAR) AS label_f24_available FROM {W} w LEFT JOIN a ON w.well_api = a.permit_num"""


@q("agg03_day_prorated", _PRORATED)
def _(t):
    return _out(life.day_prorated_labels(t("wells"), t("production")))


_SINCE = f"SELECT m.*, s, (year(period_start_date) - year(s)) * 12 + month(period_start_date) - month(s) AS k FROM {MO} m JOIN (SELECT well_api, min(period_start_date) AS s FROM {MO} m WHERE gas_quantity > 0 GROUP BY 1) f ON m.well_api = f.well_api"


@q("agg04_month_labels", f"""SELECT w.well_api, CAST(s AS VARCHAR) AS first_prod_date, round(g12, 6) AS f12_gas, round(g24, 6) AS f24_gas, round(n12 * 30.44::DOUBLE, 6) AS covered_days_f12, round(n24 * 30.44::DOUBLE, 6) AS covered_days_f24, CAST(coalesce(n12, 0) >= 12 AS VARCHAR) AS label_f12_available, CAST(coalesce(n24, 0) >= 24 AS VARCHAR) AS label_f24_available
FROM {W} w LEFT JOIN (SELECT well_api, min(s) AS s, sum(CASE WHEN k BETWEEN 0 AND 11 THEN gas_quantity END) AS g12, sum(CASE WHEN k BETWEEN 0 AND 23 THEN gas_quantity END) AS g24, count(DISTINCT CASE WHEN k BETWEEN 0 AND 11 THEN period_start_date END) AS n12, count(DISTINCT CASE WHEN k BETWEEN 0 AND 23 THEN period_start_date END) AS n24 FROM ({_SINCE}) x GROUP BY 1) a ON w.well_api = a.well_api""")
def _(t):
    return _out(life.month_labels(t("wells"), t("monthly")))


_LIFE = ", ".join([f"round(sum(CASE WHEN k BETWEEN 0 AND {n - 1} THEN {m}_quantity END), 6) AS f{n}_{m}" for n in (12, 24) for m in ("gas", "oil", "water", "ngl")] + [f"count(DISTINCT CASE WHEN k BETWEEN 0 AND {n - 1} THEN period_start_date END) AS covered_months_f{n}, CAST(max(CASE WHEN k BETWEEN 0 AND {n - 1} THEN period_start_date END) AS VARCHAR) AS last_month_f{n}, CAST(count(DISTINCT CASE WHEN k BETWEEN 0 AND {n - 1} THEN period_start_date END) >= {n} AS VARCHAR) AS label_f{n}_available" for n in (12, 24)])


@q("agg05_life_summary", f"SELECT well_api, CAST(min(s) AS VARCHAR) AS first_prod_date, CAST(max(period_start_date) AS VARCHAR) AS latest_prod_date, count(DISTINCT period_start_date) AS observed_months_all, round(sum(gas_quantity), 6) AS observed_gas_all, {_LIFE} FROM ({_SINCE}) x GROUP BY 1")
def _(t):
    return _out(life.life_summary(t("monthly")))


@q("agg06_cadence", f"SELECT m AS most_periods, CAST(m <= 40 AS VARCHAR) AS quarterly, CASE WHEN m <= 40 THEN 4 ELSE 12 END AS f12_periods, CASE WHEN m <= 40 THEN 8 ELSE 24 END AS f24_periods FROM (SELECT max(n) AS m FROM (SELECT count(DISTINCT period_start_date) AS n FROM {MO} m GROUP BY well_api) a) b")
def _(t):
    return _out(life.cadence(t("monthly")))


_MONTHLY_LABELS = SQL["agg04_month_labels"]


@q("agg07_label_methods", f"SELECT 'monthly' AS method, * FROM ({_MONTHLY_LABELS}) m")
def _(t):
    """Dispatch by name."""
    return _out(life.first_life(t("wells"), t("monthly"), "monthly").select(F.lit("monthly").alias("method"), "*"))


@q("agg08_pivot_horizons", "SELECT o_custkey AS k, max(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS price_f12, max(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) AS price_f24 FROM orders GROUP BY 1")
def _(t):
    long = t("orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "f12").otherwise("f24").alias("h"), F.col("o_totalprice").alias("price"))
    return life.horizons_wide(long, "k", "h", ["price"])


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


@q("agg09_unpivot_months", " UNION ALL ".join(f"SELECT well_api, CAST(year AS BIGINT) AS year, CAST({k} AS BIGINT) AS month, round({m}_gas, 6) AS gas, round({m}_oil, 6) AS oil FROM {sql('wide_months')} w" for k, m in enumerate(_MONTHS, 1)))
def _(t):
    return _out(life.months_long(t("wide_months"), ["well_api", "year"], ("gas", "oil")))


_SLOTS = [{"year": f"y{i}", "quarter": f"q{i}", "gas": f"g{i}", "oil": f"o{i}"} for i in (1, 2, 3)]
_WIDE_Q = "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 2000 + p_partkey % 3 END AS y1, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1 END AS q1, p_retailprice AS g1, 1.0e0 AS o1, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN 0 ELSE 2001 END AS y2, 2 AS q2, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS g2, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 2.0e0 END AS o2, 2002 AS y3, 3 AS q3, p_retailprice AS g3, 3.0e0 AS o3 FROM "
_QL = " UNION ALL ".join(f"SELECT k, {i - 1} AS slot, CAST(y{i} AS DOUBLE) AS year, coalesce(CAST(q{i} AS DOUBLE), 1) AS quarter, CAST(g{i} AS DOUBLE) AS gas, CAST(o{i} AS DOUBLE) AS oil FROM ({_WIDE_Q}part) x WHERE y{i} <> 0 AND (g{i} IS NOT NULL OR o{i} IS NOT NULL) {'AND y1 IS NOT NULL ' if i > 1 else ''}{'AND y2 IS NOT NULL' if i > 2 else ''}" for i in (1, 2, 3))


@q("agg10_unpivot_quarters", _QL)
def _(t):
    part = t("part")
    part.createOrReplaceTempView("part_for_quarters")
    return _out(life.quarters_long(part.sparkSession.sql(_WIDE_Q + "part_for_quarters"), ["k"], _SLOTS))


@q("agg11_long_production", f"SELECT permit_num AS well_api, CAST(make_date(year(production_period_start_date), month(production_period_start_date), 1) AS VARCHAR) AS period_start_date, gas_quantity, round(oil_quantity, 6) AS oil_quantity FROM {PR} p")
def _(t):
    return _out(t("production").select(F.col("permit_num").alias("well_api"), F.make_date(F.year("production_period_start_date"), F.month("production_period_start_date"), F.lit(1)).alias("period_start_date"), C.number(F.col("gas_quantity")).alias("gas_quantity"), C.number(F.col("oil_quantity")).alias("oil_quantity")))


_CON = "record_date ASC NULLS LAST, objectid ASC"


@q("agg12_consolidate", f"""SELECT well_api, last(operator_name ORDER BY {_CON}) FILTER (WHERE operator_name IS NOT NULL) AS operator_name, first(longitude ORDER BY {_CON}) FILTER (WHERE longitude IS NOT NULL) AS longitude,
CAST(min(record_date) AS VARCHAR) AS min_record_date, CAST(max(record_date) AS VARCHAR) AS max_record_date, count(DISTINCT permit_id) AS n_permit_id FROM {sql('wells_multi')} w GROUP BY 1""")
def _(t):
    return _out(life.consolidate(t("wells_multi"), "well_api", ["record_date", "objectid"], ["operator_name"], ["longitude"], ["record_date"], ["record_date"], ["permit_id"]))


@q("agg13_units", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return summaries.units(t("part"), ["p_brand", "p_type"])


@q("agg14_value_counts", "SELECT 'o_orderstatus' AS key, o_orderstatus AS value, count(*) AS n_rows FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def _(t):
    return summaries.value_counts(t("orders"), "o_orderstatus", "o_orderpriority")


@q("agg15_search_groups", f"SELECT CAST(floor((latitude + 90) / 0.5) AS BIGINT) AS gy, CAST(floor((longitude + 180) / 0.5) AS BIGINT) AS gx, y AS year, round(min(longitude) - 0.1::DOUBLE, 6) AS west, round(max(longitude) + 0.1::DOUBLE, 6) AS east, round(min(latitude) - 0.1::DOUBLE, 6) AS south, round(max(latitude) + 0.1::DOUBLE, 6) AS north, count(*) AS members FROM {W} w, (VALUES (2020), (2021)) v(y) GROUP BY 1, 2, 3")
def _(t):
    return _out(observations.search_groups(observations.location_years(t("wells").withColumnRenamed("well_api", "sample_id"), [2020, 2021]), 0.5, 0.1))


_PLAN = "SELECT user_id AS k, event_id AS bin, event_type IN ('view', 'click') AS has_s2, event_id % 3 <> 0 AS has_s1, value FROM events"


def _plan(t):
    return t("events").select(F.col("user_id").alias("k"), F.col("event_id").alias("bin"), F.col("event_type").isin("view", "click").alias("has_s2"), (F.col("event_id") % 3 != 0).alias("has_s1"), "value")


@q("agg16_coverage", f"SELECT k, n_bins, n_s2, n_s1, n_paired, round(n_paired / 37.0::DOUBLE, 6) AS paired_fraction, CAST(round_even(n_paired / 37.0::DOUBLE * 100 / 10, 0) * 10 AS BIGINT) AS decile FROM (SELECT k, count(*) AS n_bins, CAST(sum(has_s2::INT) AS BIGINT) AS n_s2, CAST(sum(has_s1::INT) AS BIGINT) AS n_s1, CAST(sum((has_s2 AND has_s1)::INT) AS BIGINT) AS n_paired FROM ({_PLAN}) p GROUP BY 1) x")
def _(t):
    return _out(observations.coverage(_plan(t), "k", 37))


@q("agg17_sequence_frame", f"SELECT k, arg_min(value, bin) AS value, CAST(sum((has_s2 AND has_s1)::INT) AS BIGINT) AS n_paired FROM ({_PLAN}) p GROUP BY 1 HAVING sum((has_s2 AND has_s1)::INT) >= 10")
def _(t):
    return observations.sequence_frame(_plan(t), "k", "bin", ["value"], 10)


A, B_, C_ = sql("daily_a"), sql("daily_b"), sql("daily_c")
_MERGED = f"SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.date, b.date) AS date, a.value AS a_value, a.image_count AS a_image_count, a.sample_id IS NOT NULL AS has_a, b.value AS b_value, b.image_count AS b_image_count, b.sample_id IS NOT NULL AS has_b FROM {A} a FULL JOIN {B_} b ON a.sample_id = b.sample_id AND a.date = b.date"


def _merged(t):
    return merging.merge_sources({"a": t("daily_a"), "b": t("daily_b")})


@q("jn17_merge_sources", f"SELECT sample_id, CAST(date AS VARCHAR) AS date, round(a_value, 6) AS a_value, a_image_count, CAST(has_a AS VARCHAR) AS has_a, round(b_value, 6) AS b_value, b_image_count, CAST(has_b AS VARCHAR) AS has_b FROM ({_MERGED}) m")
def _(t):
    return _out(_merged(t))


@q("agg18_source_coverage", f"SELECT 'a' AS what, round(avg(has_a::INT), 6) AS share FROM ({_MERGED}) m UNION ALL SELECT 'b', round(avg(has_b::INT), 6) FROM ({_MERGED}) m UNION ALL SELECT concat('n=', CAST(has_a::INT + has_b::INT AS VARCHAR)), round(count(*) / (SELECT count(*) FROM ({_MERGED}) m)::DOUBLE, 6) FROM ({_MERGED}) m GROUP BY 1")
def _(t):
    return _out(summaries.source_coverage(_merged(t), ["a", "b"]))


@q("flt07_required_sources", f"SELECT sample_id, CAST(date AS VARCHAR) AS date FROM ({_MERGED}) m WHERE has_a AND has_b")
def _(t):
    return _out(_merged(t).where(life.all_present(["has_a", "has_b"])).select("sample_id", "date"))


@q("jn18_future_targets", f"SELECT a.sample_id, CAST(a.date AS VARCHAR) AS date, round(x.value, 6) AS value_plus_1d, round(y.value, 6) AS value_plus_7d FROM {A} a LEFT JOIN {A} x ON a.sample_id = x.sample_id AND x.date = a.date + 1 LEFT JOIN {A} y ON a.sample_id = y.sample_id AND y.date = a.date + 7")
def _(t):
    return _out(merging.future_targets(t("daily_a").select("sample_id", "date"), t("daily_a"), "value", [1, 7]))


@q("jn19_request_pairs", f"SELECT sample_id, CAST(d AS VARCHAR) AS date FROM {sql('locations')} l, (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-10', INTERVAL 1 DAY)) AS DATE) AS d) x")
def _(t):
    return _out(merging.request_pairs(t("locations"), "2024-01-01", "2024-01-10"))


@q("agg19_label_positives", "SELECT count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderstatus <> 'P') AS high, count(*) FILTER (WHERE o_totalprice > 200000 AND o_orderstatus <> 'P') AS higher FROM orders")
def _(t):
    return summaries.label_positives(t("orders").select("o_orderstatus", (F.col("o_totalprice") > 100000).alias("high"), (F.col("o_totalprice") > 200000).alias("higher")), F.col("o_orderstatus") != "P", ["high", "higher"])


@q("agg20_layer_counts", f"SELECT 'wells' AS layer, count(*) AS n_rows FROM {W} w UNION ALL SELECT 'permits', count(*) FROM {P} p UNION ALL SELECT 'production', count(*) FROM {PR} p UNION ALL SELECT 'scenes', count(*) FROM {sql('scenes')} s")
def _(t):
    return summaries.layer_counts({n: t(n) for n in ("wells", "permits", "production", "scenes")})


@q("agg21_iou", "SELECT *, round((iou_0 + iou_1) / 2, 6) AS mean_iou FROM (SELECT round(count(*) FILTER (WHERE p = 0 AND t = 0) / (count(*) FILTER (WHERE p = 0 OR t = 0) + 1e-8), 6) AS iou_0, round(count(*) FILTER (WHERE p = 1 AND t = 1) / (count(*) FILTER (WHERE p = 1 OR t = 1) + 1e-8), 6) AS iou_1 FROM (SELECT l_linenumber % 2 AS p, CAST(l_quantity AS INT) % 2 AS t FROM lineitem WHERE l_returnflag <> 'A') x) y")
def _(t):
    px = t("lineitem").select((F.col("l_linenumber") % 2).alias("pred"), (F.col("l_quantity").cast("int") % 2).alias("target"), (F.col("l_returnflag") != "A").alias("valid"))
    return _out(metrics.iou(px, [0, 1]))


@q("agg22_mask_stats", "SELECT l_suppkey AS chip, round(avg((l_linenumber IN (4, 5))::INT), 6) AS clear_fraction, round(avg((l_linenumber <> 1)::INT), 6) AS valid_fraction, count(*) AS n_pixels, CAST(avg((l_linenumber <> 1)::INT) > 0.5 AS VARCHAR) AS seen FROM lineitem GROUP BY 1")
def _(t):
    return _out(summaries.mask_stats(t("lineitem").select(F.col("l_suppkey").alias("chip"), F.col("l_linenumber").alias("class")), ["chip"], [4, 5], 1))


@q("agg23_band_features", "SELECT l_suppkey AS chip, round(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 6) AS \"A_mean\", round(stddev_samp(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 6) AS \"A_std\", round(avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 6) AS \"N_mean\", round(stddev_samp(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 6) AS \"N_std\" FROM lineitem GROUP BY 1")
def _(t):
    return _out(summaries.band_features(t("lineitem").select(F.col("l_suppkey").alias("chip"), F.col("l_returnflag").alias("band"), F.col("l_quantity").alias("value")), "chip", ["A", "N"]))


_POOL = "list_transform(range(16), lambda d: (embedding[d+1]::DOUBLE + embedding[d+17]::DOUBLE + embedding[d+33]::DOUBLE + embedding[d+49]::DOUBLE) / 4)"


@q("agg24_pooling", f"SELECT vec_id, round(list_sum({_POOL}), 5) AS total, round(list_sum(list_transform({_POOL}, lambda x: x / sqrt(list_sum(list_transform({_POOL}, lambda y: y * y))))), 5) AS unit_total FROM embeddings")
def _(t):
    e = t("embeddings")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 5)
    return metrics.pool_vectors(e, "vec_id", "embedding", 4, False).select("vec_id", total(F.col("pooled")).alias("total")).join(metrics.pool_vectors(e, "vec_id", "embedding", 4, True).select("vec_id", total(F.col("pooled")).alias("unit_total")), "vec_id")


@q("agg25_vector_health", "WITH d AS (SELECT stddev_pop(x) AS s, max(abs(x)) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS d FROM embeddings) e GROUP BY d) SELECT round((SELECT avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) FROM embeddings), 5) AS mean_norm, round(avg(s), 5) AS mean_std, round(min(s), 5) AS min_std, round(max(s), 5) AS max_std, round(max(m), 5) AS max_abs FROM d")
def _(t):
    return _out(metrics.vector_health(t("embeddings"), "embedding"), 5)


@q("agg26_run_summary", f"WITH g AS (SELECT run_id, arg_max(mean_loss, epoch) AS last_loss, min(mean_loss) AS best_loss, max(peak_mb) AS peak_mb, CAST(max(epoch) AS BIGINT) AS last_epoch FROM {sql('run_log')} r GROUP BY 1) SELECT run_id, round(last_loss, 6) AS last_loss, round(best_loss, 6) AS best_loss, peak_mb, last_epoch, round((best_loss - (SELECT best_loss FROM g WHERE run_id = 1)) / (SELECT best_loss FROM g WHERE run_id = 1) * 100, 6) AS best_change_pct FROM g")
def _(t):
    return _out(summaries.run_summary(t("run_log"), 1))


@q("agg27_fetch_summary", "SELECT o_custkey AS chunk, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_ok, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_failed, round(avg(o_orderkey % 100), 6) AS mean_s, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 100 END), 6) AS mean_ok_s, coalesce(string_agg(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderkey AS VARCHAR) END, ';' ORDER BY CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderkey AS VARCHAR) END), '') AS failed, CAST(bool_and(o_orderstatus = 'F') AS VARCHAR) AS complete FROM orders GROUP BY 1")
def _(t):
    log = t("orders").select(F.col("o_custkey").alias("chunk"), F.when(F.col("o_orderstatus") == "F", 200).otherwise(500).alias("status"), (F.col("o_orderkey") % 100).cast("double").alias("seconds"), F.col("o_orderkey").cast("string").alias("sample"))
    return _out(summaries.fetch_summary(log, "chunk"))


@q("agg28_shard_totals", "SELECT CAST(sum(n) AS BIGINT) AS n_samples, CAST(least(greatest(sum(n) - 100, 0), 5000) AS BIGINT) AS n_used, count(*) AS n_shards, count(*) FILTER (WHERE n > 1) AS n_multi FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) x")
def _(t):
    return summaries.shard_totals(t("conversations").groupBy("conv_id").agg(F.count("*").alias("n_samples")), 100, 5000)


@q("agg29_split_profile", f"SELECT CASE WHEN spud_date < DATE '1998-01-01' THEN 'train' ELSE 'test' END AS split_group, CAST(min(spud_date) AS VARCHAR) AS first_date, CAST(max(spud_date) AS VARCHAR) AS last_date, count(*) AS n_rows, round(avg(unconventional::INT), 6) AS positive_rate FROM {W} w GROUP BY 1")
def _(t):
    return _out(summaries.split_profile(sampling.split_by_date(t("wells"), "spud_date", "1998-01-01"), "spud_date", "unconventional"))


@q("agg30_source_markers", "SELECT event_type AS source, count(*) AS n_rows, string_agg(DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR), ';' ORDER BY CAST(CAST(ts AS DATE) AS VARCHAR)) AS periods, max(event_id) AS last_seen FROM events GROUP BY 1")
def _(t):
    return summaries.source_markers(t("events").select(F.col("event_type").alias("source"), F.col("ts").cast("date").alias("period"), F.col("event_id").alias("seen")))


@q("agg31_score_distribution", f"SELECT min(score) AS min_score, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90, max(score) AS max_score, count(score) AS n_scored FROM {sql('scored')} s")
def _(t):
    return _out(metrics.score_distribution(t("scored"), "score"))


@q("agg32_explode_log", "SELECT conv_id, turn, role FROM conversations")
def _(t):
    logs = t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("log"))
    return summaries.explode_log(logs, "conv_id", "log")


@q("jn01_enrich", f"SELECT w.well_api, coalesce(permit_count, 0) AS permit_count, round(coalesce(observed_gas, 0), 6) AS observed_gas, CAST(x.well_api IS NOT NULL AS VARCHAR) AS has_permit_record FROM {W} w LEFT JOIN (SELECT well_api, count(*) AS permit_count FROM {P} p GROUP BY 1) x ON w.well_api = x.well_api LEFT JOIN ({_AGG02}) y ON w.well_api = y.well_api")
def _(t):
    joined = t("wells").join(life.permit_summary(t("permits")).withColumn("has", F.lit(True)), "well_api", "left").join(life.production_summary(t("production")), "well_api", "left")
    return _out(joined.select("well_api", F.coalesce("permit_count", F.lit(0)).alias("permit_count"), F.coalesce("observed_gas", F.lit(0.0)).alias("observed_gas"), F.coalesce("has", F.lit(False)).alias("has_permit_record")))


@q("jn02_months_since_first", f"SELECT well_api, CAST(period_start_date AS VARCHAR) AS period_start_date, CAST(k AS BIGINT) AS months FROM ({_SINCE}) x")
def _(t):
    return _out(life._since_first(t("monthly")).select("well_api", "period_start_date", F.col("months_since_first").alias("months")))


@q("jn03_semi", f"SELECT p.authorization_id FROM {P} p WHERE well_api IN (SELECT well_api FROM {W} w WHERE unconventional)")
def _(t):
    return t("permits").join(t("wells").where("unconventional"), "well_api", "left_semi").select("authorization_id")


@q("jn04_anti", f"SELECT DISTINCT id FROM {sql('catalog_new')} n WHERE id NOT IN (SELECT id FROM {sql('catalog_old')} o)")
def _(t):
    return merging.new_keys(t("catalog_old"), t("catalog_new"), ["id"])


_NEAR = f"SELECT a.well_api, b.well_api AS other, {_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS km, b.spud_date AS s, a.spud_date AS t, b.k AS v FROM {W} a JOIN {W} b ON abs(a.latitude - b.latitude) < 0.2"


def _stats(t, **kw):
    wells = t("wells").withColumn("spud", F.col("spud_date"))
    return asof.neighbour_stats(wells, wells, "well_api", **kw)


@q("jn05_asof_counts", f"SELECT w.well_api, round(nearest_km, 6) AS nearest_km, coalesce(n2, 0) AS count_2km, coalesce(n5, 0) AS count_5km, coalesce(n10, 0) AS count_10km FROM {W} w LEFT JOIN (SELECT well_api, min(km) AS nearest_km, count(*) FILTER (WHERE km <= 2) AS n2, count(*) FILTER (WHERE km <= 5) AS n5, count(*) FILTER (WHERE km <= 10) AS n10 FROM ({_NEAR}) x WHERE km <= 20 AND s < t GROUP BY 1) y ON w.well_api = y.well_api")
def _(t):
    return _out(_stats(t, radii=[2, 5, 10], cap_km=20, as_of=("spud", "spud_date")))


@q("jn06_asof_nearest", f"SELECT w.well_api, round(nearest_km, 6) AS nearest_km FROM {W} w LEFT JOIN (SELECT well_api, min(km) AS nearest_km FROM ({_NEAR}) x WHERE km <= 20 AND s < t GROUP BY 1) y ON w.well_api = y.well_api")
def _(t):
    return _out(_stats(t, radii=[], cap_km=20, as_of=("spud", "spud_date")))


@q("jn07_current_counts", f"SELECT w.well_api, round(nearest_km, 6) AS nearest_km, coalesce(n2, 0) AS count_2km, coalesce(n5, 0) AS count_5km FROM {W} w LEFT JOIN (SELECT well_api, min(km) AS nearest_km, count(*) FILTER (WHERE km <= 2) AS n2, count(*) FILTER (WHERE km <= 5) AS n5 FROM ({_NEAR}) x WHERE km <= 20 AND km > 1e-6 GROUP BY 1) y ON w.well_api = y.well_api")
def _(t):
    return _out(_stats(t, radii=[2, 5], cap_km=20, self_gap=1e-6))


for _name, _asof in (("jn08_asof_values", "AND s < t"), ("jn09_current_values", "")):

    @q(_name, f"SELECT w.well_api, round(nearest_km, 6) AS nearest_km, coalesce(n, 0) AS value_count_5km, round(m, 6) AS median_5km, round(p, 6) AS p90_5km, coalesce(n, 0) AS count_5km FROM {W} w LEFT JOIN (SELECT well_api, min(km) AS nearest_km, count(*) FILTER (WHERE km <= 5) AS n, quantile_cont(v, 0.5) FILTER (WHERE km <= 5) AS m, quantile_cont(v, 0.9) FILTER (WHERE km <= 5) AS p FROM ({_NEAR}) x WHERE km <= 5 {_asof} GROUP BY 1) y ON w.well_api = y.well_api")
    def _(t, asof=_asof):
        return _out(_stats(t, radii=[5], cap_km=5, value="k", as_of=("spud", "spud_date") if asof else None))


_LOC_NEAR = f"SELECT l.sample_id, w.k, {_hav('l.latitude', 'l.longitude', 'w.latitude', 'w.longitude')} AS km FROM {sql('locations')} l, {W} w"


@q("jn10_nearest_row", f"SELECT sample_id, k AS near_k, round(km, 6) AS near_km FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY km, k) AS r FROM ({_LOC_NEAR}) x) y WHERE r = 1")
def _(t):
    return _out(spatial.nearest(t("locations"), t("wells"), "sample_id", "k"))


@q("jn11_repair_keys", f"SELECT sample_id, k AS official_key, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY km, k) AS r FROM ({_LOC_NEAR}) x WHERE km <= 2) y WHERE r = 1")
def _(t):
    return _out(spatial.repair_keys(t("locations"), t("wells"), "sample_id", "k"))


def _polygons(t):
    ring = lambda *p: F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in p])
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    box = ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    hole = ring((x0 + 0.1, y0 + 0.1), (x0 + 0.3, y0 + 0.1), (x0 + 0.3, y0 + 0.3), (x0 + 0.1, y0 + 0.3))
    return t("geology").select("objectid", "map_symbol", F.array(F.when(F.col("objectid") % 3 == 0, F.array(box, hole)).otherwise(F.array(box))).alias("parts"))


@q("jn12_point_in_polygon", f"SELECT w.well_api, min(g.objectid) AS objectid, arg_min(g.map_symbol, g.objectid) AS map_symbol FROM {W} w LEFT JOIN {sql('geology')} g ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1 AND NOT (objectid % 3 = 0 AND longitude > x0 + 0.1 AND longitude < x0 + 0.3 AND latitude > y0 + 0.1 AND latitude < y0 + 0.3) GROUP BY 1")
def _(t):
    return _out(polygons.polygon_attributes(t("wells"), _polygons(t), "well_api", "objectid", ["map_symbol"]))


def _box_text(x0, x1, y0, y1):
    """A closed ring's coordinates as JSON text."""
    return F.concat(F.lit("["), *[F.concat(F.lit(c), F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]")) for c, (x, y) in zip(("", ",", ",", ",", ","), ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)), strict=True)], F.lit("]"))


def _footprints(t):
    """A footprint for each tile of geology, by its id's remainder of 5: polygon with a hole, overlapping parts, nested collection, none, empty."""
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    polygon = lambda *rings: F.concat(F.lit('{"type":"Polygon","coordinates":['), F.concat_ws(",", *rings), F.lit("]}"))
    holed = polygon(_box_text(x0, x1, y0, y1), _box_text(x0 + 0.1, x0 + 0.3, y0 + 0.1, y0 + 0.3))
    parts = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), _box_text(x0, x0 + 0.3, y0, y1), F.lit("],["), _box_text(x0 + 0.1, x1, y0, y1), F.lit("]]}"))
    nested = F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[0,0]},{"type":"GeometryCollection","geometries":['), polygon(_box_text(x0, x0 + 0.2, y0, y1)), F.lit("]}]}"))
    kind = F.col("objectid") % 5
    return t("geology").select("objectid", "x0", "y0", "x1", "y1", F.when(kind == 0, holed).when(kind == 1, parts).when(kind == 2, nested).when(kind == 3, None).otherwise("{}").alias("geometry"))


@q("jn13_footprints", f"SELECT w.well_api, g.objectid FROM {W} w JOIN {sql('geology')} g ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1 AND NOT (objectid % 5 = 0 AND longitude BETWEEN x0 + 0.1 AND x0 + 0.3 AND latitude BETWEEN y0 + 0.1 AND y0 + 0.3) AND NOT (objectid % 5 = 2 AND longitude > x0 + 0.2)")
def _(t):
    rings = polygons.from_geojson(_footprints(t), "objectid", box=("x0", "y0", "x1", "y1"))
    return polygons.points_in_polygons(t("wells"), rings, "well_api", strict=True).select("well_api", F.col("pid").alias("objectid"))


_CONIC = (40.9, 41.95, 40.16666, -77.75)  # parallels and origin


def _lambert_sql(lat: str, lon: str) -> tuple[str, str]:
    """The conic projection on GRS80 in SQL."""
    import math

    e2, (a1, a2, a0, o) = 0.00669438002290, _CONIC
    e, (p1, p2, p0) = math.sqrt(e2), map(math.radians, (a1, a2, a0))
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    scale = 6378137.0 * m(p1) / (n * t(p1) ** n)
    rho = f"({scale!r}::DOUBLE * power(tan(pi() / 4 - radians({lat}) / 2) / power((1 - {e!r}::DOUBLE * sin(radians({lat}))) / (1 + {e!r}::DOUBLE * sin(radians({lat}))), {e / 2!r}::DOUBLE), {n!r}::DOUBLE))"
    theta = f"({n!r}::DOUBLE * radians({lon} - ({o!r}::DOUBLE)))"
    return f"({rho} * sin({theta}))", f"({scale * t(p0) ** n!r}::DOUBLE - {rho} * cos({theta}))"


def faults_sql(wells: str) -> str:
    """(well_api, fault_km) of all wells by brute force: a line of two segments for each region, west of most wells."""
    (px, py), (ax, ay), (bx, by) = _lambert_sql("latitude", "longitude"), _lambert_sql("la", "lo"), _lambert_sql("lb", "lc")
    return f"""SELECT well_api, round(min(sqrt(power(x - (x1 + t * (x2 - x1)), 2) + power(y - (y1 + t * (y2 - y1)), 2))) / 1000, 6) AS fault_km FROM (
SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM (SELECT well_api, {px} AS x, {py} AS y FROM {wells} w) p,
(SELECT {ax} AS x1, {ay} AS y1, {bx} AS x2, {by} AS y2 FROM (SELECT 39.0::DOUBLE + r_regionkey * 0.02 AS la, -81.0::DOUBLE + r_regionkey * 0.1 AS lo, 40.0::DOUBLE + r_regionkey * 0.02 AS lb, -80.9::DOUBLE + r_regionkey * 0.1 AS lc FROM region
UNION ALL SELECT 40.0::DOUBLE + r_regionkey * 0.02, -80.9::DOUBLE + r_regionkey * 0.1, 40.3::DOUBLE + r_regionkey * 0.02, -80.2::DOUBLE + r_regionkey * 0.1 FROM region) g) s) u GROUP BY 1"""


def fault_segments(t):
    """The same lines, projected."""
    corner = lambda lat, lon: F.struct(*[c.alias(n) for c, n in zip(projections.lambert_conic(lat + F.col("r_regionkey") * 0.02, lon + F.col("r_regionkey") * 0.1, *_CONIC), "xy", strict=True)])
    return lines.segments_of(t("region").select(F.array(*[corner(F.lit(a), F.lit(b)) for a, b in ((39.0, -81.0), (40.0, -80.9), (40.3, -80.2))]).alias("points")))


def well_places(lat=None, lon=None) -> tuple:
    return projections.lambert_conic(F.col("latitude") if lat is None else lat, F.col("longitude") if lon is None else lon, *_CONIC)


@q("jn14_nearest_line", faults_sql(W))
def _(t):
    x, y = well_places()
    got = lines.nearest_line_km(t("wells").select("well_api", x.alias("x"), y.alias("y")), fault_segments(t), "well_api")
    return _out(got.withColumnRenamed("line_km", "fault_km"))


S, L = sql("scenes"), sql("locations")
_HIT = f"SELECT l.sample_id, s.*, CAST(floor((dayofyear(CAST(seen_at AS DATE)) - 1) / 10) AS BIGINT) AS bin, CAST(year(seen_at) AS BIGINT) AS year FROM {L} l JOIN {S} s ON l.longitude BETWEEN west AND east AND l.latitude BETWEEN south AND north"


@q("jn15_scene_shortlists", f"SELECT sample_id, year, bin, r AS rank, scene_id, cloud_cover FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, year, bin ORDER BY cloud_cover ASC NULLS LAST, abs(epoch_s - (epoch(make_date(year, 1, 1))::BIGINT + bin * 864000 + 432000)), epoch_s DESC, scene_id) AS r FROM ({_HIT}) h) x WHERE r <= 3")
def _(t):
    return _out(observations.scene_shortlists(t("locations"), t("scenes"), 10, 3))


# scenes of all months: each event's day is moved by a twelfth of a year for each of its last digits
_SHIFTED = f"(SELECT scene_id, collection, 'T' || CAST(grid_code % 40 AS VARCHAR) AS tile_id, epoch_s + (scene_id % 12) * 2592000 AS epoch_s, cloud_cover % 60 AS cloud_cover, west, east, south, north FROM {S} s)"
_SEASONAL = f"""SELECT *, CAST(year(day) AS BIGINT) AS year FROM (SELECT *, CAST(to_timestamp(epoch_s) AT TIME ZONE 'UTC' AS DATE) AS day FROM {_SHIFTED} x) y, (VALUES ('early_spring', 3, 1, 4, 30), ('late_spring', 5, 1, 6, 30), ('summer', 7, 1, 8, 31), ('fall', 9, 1, 10, 31)) w(season, m1, d1, m2, d2)
WHERE cloud_cover < 35 AND day BETWEEN make_date(year(day), m1, d1) AND make_date(year(day), m2, d2)"""
_PREFERRED = "CASE collection WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 999 END"


@q(
    "jn16_season_hits",
    f"""WITH d AS ({_SEASONAL}), c AS (SELECT d.*, (SELECT count(*) FROM {L} l WHERE l.longitude BETWEEN d.west AND d.east AND l.latitude BETWEEN d.south AND d.north) AS n_points FROM d),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, season, tile_id ORDER BY n_points DESC, {_PREFERRED}, cloud_cover, epoch_s DESC, scene_id) AS r FROM c) x WHERE r = 1),
h AS (SELECT * FROM (SELECT l.sample_id, t.* EXCLUDE (r), row_number() OVER (PARTITION BY sample_id, year, season ORDER BY {_PREFERRED}, cloud_cover, epoch_s DESC, scene_id) AS k FROM {L} l JOIN t ON l.longitude BETWEEN t.west AND t.east AND l.latitude BETWEEN t.south AND t.north) x WHERE k = 1)
SELECT sample_id, year, season, scene_id, tile_id, n_points FROM (SELECT *, count(*) OVER (PARTITION BY sample_id, year) AS n FROM h) x WHERE n = 4""",
)
def _(t):
    scenes = t("scenes").select("scene_id", "collection", F.concat(F.lit("T"), (F.col("grid_code") % 40).cast("string")).alias("tile_id"), (F.col("epoch_s") + F.col("scene_id") % 12 * 2592000).alias("epoch_s"), (F.col("cloud_cover") % 60).alias("cloud_cover"), "west", "east", "south", "north")
    return _out(observations.season_hits(t("locations"), scenes, preferred=("view", "click")))


@q("jn20_back_fill", "SELECT c_custkey AS k, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END, s_acctbal) AS bal, s_name AS name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def _(t):
    left = t("customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"))
    return merging.back_fill(left, t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name")), "k")


@q("jn21_sample_embeddings", "SELECT concat('well::', CAST(vec_id AS VARCHAR)) AS sample_id, c_name, label FROM customer JOIN embeddings ON c_custkey = vec_id")
def _(t):
    key = lambda c: [C.sample_key("well", F.col(c)).alias("sample_id"), F.lit("well").alias("sample_type"), F.col(c).cast("string").alias("sample_key")]
    a, b = t("customer").select(*key("c_custkey"), "c_name"), t("embeddings").select(*key("vec_id"), F.col("label").cast("long").alias("label"))
    return a.join(b, ["sample_id", "sample_type", "sample_key"]).select("sample_id", "c_name", "label")


G = sql("regions")


@q("jn22_full_clusters", f"SELECT a.region_id FROM {G} a JOIN {G} b ON abs(a.grid_x - b.grid_x) <= 1 AND abs(a.grid_y - b.grid_y) <= 1 GROUP BY 1 HAVING count(*) = 9")
def _(t):
    return spatial.full_clusters(t("regions"), "region_id", 1).select("region_id")


@q("jn23_exclusion", f"SELECT region_id FROM {G} a WHERE NOT EXISTS (SELECT 1 FROM {G} b WHERE b.k % 101 = 0 AND abs(a.grid_x - b.grid_x) <= 2 AND abs(a.grid_y - b.grid_y) <= 2)")
def _(t):
    return spatial.away_from(t("regions"), t("regions").where("k % 101 = 0"), 2).select("region_id")


@q("jn24_first_per_cell", f"SELECT grid_x, grid_y, map_symbol, well_api FROM (SELECT *, row_number() OVER (PARTITION BY grid_x, grid_y ORDER BY map_symbol, objectid, well_api) AS r FROM (SELECT CAST(floor(longitude / 0.05::DOUBLE) AS BIGINT) AS grid_x, CAST(floor(latitude / 0.05::DOUBLE) AS BIGINT) AS grid_y, map_symbol, objectid, well_api FROM {W} w JOIN {sql('geology')} g ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1 AND NOT (objectid % 3 = 0 AND longitude > x0 + 0.1 AND longitude < x0 + 0.3 AND latitude > y0 + 0.1 AND latitude < y0 + 0.3)) x) y WHERE r = 1")
def _(t):
    hits = polygons.points_in_polygons(t("wells"), polygons.from_parts(_polygons(t), "objectid"), "well_api").withColumnRenamed("pid", "objectid")
    rows = hits.join(t("wells"), "well_api").join(t("geology").select("objectid", "map_symbol"), "objectid").select(F.floor(F.col("longitude") / 0.05).alias("grid_x"), F.floor(F.col("latitude") / 0.05).alias("grid_y"), "map_symbol", "objectid", "well_api")
    return spatial.first_per_cell(rows, ["map_symbol", "objectid", "well_api"]).select("grid_x", "grid_y", "map_symbol", "well_api")


@q("jn25_overlay", "SELECT coalesce(c_custkey, s_suppkey) AS k, coalesce(s_acctbal, c_acctbal) AS bal, c_mktsegment AS seg FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3")
def _(t):
    return merging.overlay(t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")), t("supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_acctbal").alias("bal")), key="k")


SQL["jn25_overlay"] = "SELECT coalesce(c_custkey, s) AS k, coalesce(b, c_acctbal) AS bal, c_mktsegment AS seg FROM customer FULL JOIN (SELECT s_suppkey * 3 AS s, s_acctbal AS b FROM supplier) x ON c_custkey = s"


@q("jn26_scene_coverage", f"SELECT s.scene_id, count(l.sample_id) AS n_points FROM {S} s LEFT JOIN {L} l ON l.longitude BETWEEN west AND east AND l.latitude BETWEEN south AND north GROUP BY 1")
def _(t):
    return observations.scene_coverage(t("locations"), t("scenes"))


@q("jn27_catalog_views", f"SELECT p.authorization_id, w.well_status, CAST(count(x.permit_num) AS BIGINT) AS n_production FROM {P} p JOIN {W} w ON p.well_api = w.well_api LEFT JOIN {PR} x ON x.permit_num = p.well_api AND x.production_scope = 'conventional' GROUP BY 1, 2")
def _(t):
    counts = t("production").where("production_scope = 'conventional'").groupBy(F.col("permit_num").alias("well_api")).agg(F.count("*").alias("n_production"))
    return t("permits").select("authorization_id", "well_api").join(t("wells").select("well_api", "well_status"), "well_api").join(counts, "well_api", "left").select("authorization_id", "well_status", F.coalesce("n_production", F.lit(0)).alias("n_production"))


@q("win01_rank_percentile", "SELECT sample_id, round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER (), 9) AS percentile FROM " + sql("scored") + " s")
def _(t):
    return ranking.average_rank_percentile(t("scored").select("sample_id", "score"), "score", "percentile").select("sample_id", F.round("percentile", 9).alias("percentile"))


@q("win02_score_rank", "SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS score_rank FROM orders")
def _(t):
    return ranking.number_rows(t("orders").select(F.col("o_orderkey").alias("k"), "o_totalprice"), [F.desc("o_totalprice"), F.col("k")], "score_rank").select("k", "score_rank")


@q("win03_best_scene", f"SELECT grid_code, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY grid_code ORDER BY coalesce(cloud_cover, 999), epoch_s DESC, scene_id) AS r FROM {S} s) x WHERE r = 1")
def _(t):
    return ranking.best_of(t("scenes"), ["grid_code"], [F.coalesce("cloud_cover", F.lit(999.0)), F.desc("epoch_s"), F.col("scene_id")]).select("grid_code", "scene_id")


@q("win04_keep_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return ranking.best_of(t("orders"), ["o_custkey"], [F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@q("win05_top_k", "SELECT o_custkey, o_orderkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 3")
def _(t):
    return _out(ranking.top_k(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank"))


@q("win06_rerank", f"SELECT grid_code, scene_id FROM (SELECT a.*, row_number() OVER (PARTITION BY grid_code ORDER BY cf DESC NULLS LAST, cloud_cover ASC NULLS LAST, rank, scene_id) AS r2 FROM (SELECT *, CASE WHEN scene_id % 5 <> 0 THEN (scene_id % 10) / 10.0::DOUBLE END AS cf, row_number() OVER (PARTITION BY grid_code ORDER BY epoch_s, scene_id) AS rank FROM {S} s) a WHERE rank <= 4) b WHERE r2 = 1")
def _(t):
    s = t("scenes")
    short = ranking.top_k(s, ["grid_code"], [F.col("epoch_s"), F.col("scene_id")], 4)
    return observations.rerank(short, s.where("scene_id % 5 <> 0").select("scene_id", ((F.col("scene_id") % 10) / 10.0).alias("clear_fraction")), ["grid_code"], "scene_id").select("grid_code", "scene_id")


@q("win07_until_target", "SELECT k, o_orderkey, taken_before FROM (SELECT o_custkey AS k, o_orderkey, CAST(coalesce(sum(o_orderkey % 10) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS taken_before FROM orders) x WHERE taken_before < 12")
def _(t):
    rows = t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (F.col("o_orderkey") % 10).alias("n"))
    return ranking.until_target(rows, ["k"], [F.col("o_orderkey")], "n", 12).select("k", "o_orderkey", "taken_before")


@q("win08_forward_fill", "SELECT event_id, root, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, root_no ORDER BY event_id) AS cycle FROM (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER w AS root_no, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS root FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) x")
def _(t):
    e = t("events")
    got = ranking.forward_fill(e, ["user_id"], [F.col("event_id")], F.col("event_type") == "signup", F.col("event_type") == "click", F.col("event_id"), F.col("event_id"))
    return got.select("event_id", "root", "cycle")


_DEM = sql("dem")
_Z = {(a, b): f"max(CASE WHEN n.r - c.r = {a} AND n.c - c.c = {b} THEN n.z END)" for a in (-1, 0, 1) for b in (-1, 0, 1)}


@q("win09_focal", f"SELECT tile, r, c, elevation, round(degrees(atan(sqrt(power(gx, 2) + power(gy, 2)))), 6) AS slope_deg, round(relief, 6) AS relief FROM (SELECT c.tile, c.r, c.c, {_Z[0, 0]} AS elevation, (({_Z[-1, 1]} + 2*{_Z[0, 1]} + {_Z[1, 1]}) - ({_Z[-1, -1]} + 2*{_Z[0, -1]} + {_Z[1, -1]})) / (8*30.0::DOUBLE) AS gx, (({_Z[1, -1]} + 2*{_Z[1, 0]} + {_Z[1, 1]}) - ({_Z[-1, -1]} + 2*{_Z[-1, 0]} + {_Z[-1, 1]})) / (8*30.0::DOUBLE) AS gy, max(n.z) - min(n.z) AS relief FROM {_DEM} c JOIN {_DEM} n ON c.tile = n.tile AND n.r BETWEEN c.r - 1 AND c.r + 1 AND n.c BETWEEN c.c - 1 AND c.c + 1 GROUP BY 1, 2, 3) x")
def _(t):
    return _out(spatial.focal_stats(t("dem"), 30.0, 30.0))


@q("win10_raster_at", f"SELECT w.well_api, z FROM {W} w LEFT JOIN {_DEM} d ON d.r = CAST(floor((41 - latitude) / 0.1::DOUBLE) AS BIGINT) AND d.c = CAST(floor((longitude + 81) / 0.1::DOUBLE) AS BIGINT)")
def _(t):
    tiles = t("dem").groupBy("tile").agg(F.lit(-81.0).alias("west"), F.lit(41.0).alias("north"), F.lit(0.1).alias("step_x"), F.lit(0.1).alias("step_y"), (F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"))
    return spatial.raster_at(t("wells"), tiles, t("dem"), "well_api", ["z"]).select("well_api", "z")


@q("win11_grid_places", "SELECT k, dense_rank() OVER (PARTITION BY b ORDER BY y DESC) - 1 AS row, dense_rank() OVER (PARTITION BY b ORDER BY x) - 1 AS col FROM (SELECT p_partkey AS k, p_brand AS b, p_partkey % 7 AS x, p_size AS y FROM part) p")
def _(t):
    return _out(ranking.grid_places(t("part").select(F.col("p_partkey").alias("k"), "p_brand", (F.col("p_partkey") % 7).alias("x"), F.col("p_size").alias("y")), ["p_brand"], "x", "y").select("k", "row", "col"))


@q("win12_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r")
def _(t):
    return _out(ranking.spearman(t("lineitem"), "l_quantity", "l_extendedprice"))


@q("ord01_nulls_last", "SELECT k, v FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) x ORDER BY v ASC NULLS LAST, k")
def _(t):
    return t("orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("v")).orderBy(F.col("v").asc_nulls_last(), "k")


@q("ord02_top_prospects", "SELECT o_orderkey AS k, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(t):
    return t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("score")).orderBy(F.desc("score"), "k").limit(100)


@q("ord03_order_draft", f"SELECT scene_id FROM {S} s WHERE cloud_cover IS NOT NULL ORDER BY cloud_cover, epoch_s DESC, scene_id LIMIT 25")
def _(t):
    return t("scenes").where("cloud_cover is not null").orderBy("cloud_cover", F.desc("epoch_s"), "scene_id").limit(25).select("scene_id")


@q("set01_union_regions", f"SELECT well_api, county_name, CAST(NULL AS VARCHAR) AS formation FROM {W} w WHERE unconventional UNION ALL SELECT well_api, NULL, county_name FROM {W} w WHERE NOT unconventional")
def _(t):
    w = t("wells")
    return merging.union_regions({"a": w.where("unconventional").select("well_api", "county_name"), "b": w.where("not unconventional").select("well_api", F.col("county_name").alias("formation")), "c": None})[0]


_UP = f"SELECT id, day, value FROM {sql('catalog_new')} n UNION ALL SELECT id, day, value FROM {sql('catalog_old')} o WHERE id NOT IN (SELECT id FROM {sql('catalog_new')} n)"


@q("set02_upsert", f"SELECT id, CAST(day AS VARCHAR) AS day, round(value, 6) AS value FROM ({_UP}) u")
def _(t):
    return _out(merging.upsert(t("catalog_old"), t("catalog_new"), ["id"]))


@q("set03_manifest_upsert", "SELECT dataset, period, max(CASE WHEN src = 1 THEN v END) AS fresh_value, count(*) AS n FROM (SELECT l_returnflag AS dataset, l_linenumber AS period, max(l_quantity) AS v, 1 AS src FROM lineitem GROUP BY 1, 2) x GROUP BY 1, 2")
def _(t):
    l = t("lineitem")  # noqa: E741
    fresh = l.groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").alias("period")).agg(F.max("l_quantity").alias("fresh_value"))
    old = fresh.withColumn("fresh_value", F.lit(-1.0))
    return _out(merging.upsert(old, fresh, ["dataset", "period"]).groupBy("dataset", "period").agg(F.max("fresh_value").alias("fresh_value"), F.count("*").alias("n")))


@q("set04_cache_merge", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def _(t):
    e = t("embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return merging.upsert(e, e.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100), ["vec_id"])


@q("set05_diff", "SELECT concat(CAST(event_id AS VARCHAR), '.k') AS path, json_extract_string(props, '$.k') AS left_value, CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') ELSE 'x' END AS right_value FROM events WHERE event_id % 5 = 0 AND json_extract_string(props, '$.k') IS NOT NULL")
def _(t):
    rows = merging.flatten_json(t("events"), "event_id", "props").withColumn("path", F.concat(F.col("event_id").cast("string"), F.lit("."), F.col("path")))
    return merging.differing(rows.select("path", "value"), rows.select("path", F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("value")).alias("value")))


@q("smp01_date_split", f"SELECT well_api, CASE WHEN spud_date < DATE '1998-01-01' THEN 'train' ELSE 'test' END AS split_group FROM {W} w")
def _(t):
    return sampling.split_by_date(t("wells"), "spud_date", "1998-01-01").select("well_api", "split_group")


_D = "date_diff('day', DATE '1970-01-01', spud_date)"


@q("smp02_quantile_split", f"SELECT well_api, CASE WHEN {_D} <= (SELECT quantile_cont({_D}::DOUBLE, 0.8) FROM {W} w) THEN 'train' ELSE 'test' END AS split_group FROM {W} w")
def _(t):
    return sampling.split_by_quantile(t("wells"), "spud_date", 0.8).select("well_api", "split_group")


@q("smp03_fallback_split", f"SELECT well_api, CASE WHEN {_D} <= (SELECT quantile_cont({_D}::DOUBLE, 0.8) FROM {W} w) THEN 'train' ELSE 'test' END AS split_group FROM {W} w")
def _(t):
    return sampling.split_with_fallback(t("wells"), "spud_date", 0.8, "unconventional")[1].select("well_api", "split_group")


@q("smp04_leave_out", f"SELECT well_api, CASE WHEN upper(county_name) = 'NATION_3' THEN 'test' ELSE 'train' END AS split_group FROM {W} w")
def _(t):
    return sampling.leave_out(t("wells"), "county_name", "nation_3").select("well_api", "split_group")


@q("smp05_cohort_split", f"SELECT well_api, CASE WHEN k % 4 = 0 THEN 'test' ELSE 'train' END AS split_group FROM {W} w")
def _(t):
    rows = t("wells").withColumn("split_group", F.when(F.col("k") % 4 == 0, "test").otherwise("train"))
    return sampling.split_from_cohort(rows, "spud_date", 0.8).select("well_api", "split_group")


def _frac(seed: str, key: str) -> str:
    return f"('0x' || substr(md5('{seed}::' || {key}), 1, 13))::BIGINT / 4503599627370496::DOUBLE"


@q("smp06_group_split", f"SELECT well_api, CASE WHEN county_name IN (SELECT county_name FROM (SELECT DISTINCT county_name FROM {W} w) g ORDER BY {_frac('group', 'county_name')}, county_name LIMIT (SELECT CAST(ceil(0.2 * count(DISTINCT county_name)) AS BIGINT) FROM {W} w)) THEN 'test' ELSE 'train' END AS split_group FROM {W} w")
def _(t):
    return sampling.group_split(t("wells"), "county_name").select("well_api", "split_group")


@q("smp07_hash_split", f"SELECT well_api, CASE WHEN {_frac('s7', 'well_api')} < 0.8 THEN 'train' WHEN {_frac('s7', 'well_api')} < 0.9 THEN 'val' ELSE 'test' END AS split FROM {W} w")
def _(t):
    return t("wells").select("well_api", sampling.hash_split(F.col("well_api"), "s7", 0.8, 0.1).alias("split"))


@q("smp08_balanced_sample", f"SELECT well_api, unconventional::VARCHAR AS label FROM (SELECT *, row_number() OVER (PARTITION BY unconventional ORDER BY {_frac('sample', 'well_api')}, well_api) AS r, sum((NOT unconventional)::INT) OVER () AS neg FROM {W} w) x WHERE r <= CASE WHEN unconventional THEN 100 - least(50, neg) ELSE least(50, neg) END")
def _(t):
    got = sampling.balanced_sample(t("wells"), "unconventional", "well_api", 100)
    return got.select("well_api", F.col("unconventional").cast("string").alias("label"))


@q("smp09_cap_per_group", f"SELECT well_api FROM (SELECT *, row_number() OVER (PARTITION BY county_name ORDER BY {_frac('cap', 'well_api')}, well_api) AS r FROM {W} w) x WHERE r <= 20")
def _(t):
    return sampling.cap_per_group(t("wells"), "county_name", "well_api", 20).select("well_api")


def _quota(target: str, share: float, seed: str, table: str = G) -> str:
    """Regions taken by quota in SQL: an equal part for each bucket, the rest by what is left, largest remainders first."""
    return f"""WITH b AS (SELECT bucket_id, count(*) AS n, row_number() OVER (ORDER BY bucket_id) - 1 AS i, count(*) OVER () AS nb, ({target}) AS target FROM {table} g GROUP BY 1),
    e AS (SELECT *, least(n, CAST(round_even(target * {share}::DOUBLE, 0) AS BIGINT) // nb + (i < CAST(round_even(target * {share}::DOUBLE, 0) AS BIGINT) % nb)::INT) AS first FROM b),
    x AS (SELECT *, (n - first) * (target - sum(first) OVER ()) / CAST(sum(n - first) OVER () AS DOUBLE) AS exact FROM e),
    z AS (SELECT *, first + CAST(floor(exact) AS BIGINT) AS base FROM x),
    q AS (SELECT bucket_id, base + (row_number() OVER (ORDER BY floor(exact) - exact, bucket_id) <= target - sum(base) OVER ())::INT AS quota FROM z)
    SELECT region_id, g.bucket_id, r, quota FROM (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY {_frac(seed, 'region_id')}, region_id) AS r FROM {table} g) g JOIN q ON g.bucket_id = q.bucket_id WHERE r <= quota"""


@q("smp10_quota", f"SELECT region_id, bucket_id FROM ({_quota(f'SELECT count(*) FROM {G} h WHERE k < 300', 0.4, 'quota')}) x")
def _(t):
    """As many rows as have k under 300."""
    r = t("regions")
    return sampling.quota_sample(r, "bucket_id", "region_id", r.where("k < 300").count(), 0.4).select("region_id", "bucket_id")


@q("smp11_take_quota", f"SELECT region_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY {_frac('quota', 'region_id')}, region_id) AS r FROM {G} g) x WHERE r <= 7")
def _(t):
    r = t("regions")
    return sampling.take_quota(r, "bucket_id", "region_id", {k: 7 for k in sampling.bucket_counts(r, "bucket_id")}).select("region_id")


def _walk(rows: str, apart: int, target: int = 1 << 30) -> str:
    """A greedy walk in SQL over rows (region_id, grid_x, grid_y, bucket_id, i: place from 1, q: quota of the bucket): each is kept
    if it is at least `apart` from all kept, its bucket has fewer than q, and fewer than `target` are kept."""
    near = "len(list_filter(c, lambda p: greatest(abs(p.x - o.grid_x), abs(p.y - o.grid_y)) < {}))".format(apart)
    room = f"len(list_filter(c, lambda p: p.b = o.bucket_id)) < o.q AND len(c) < {target}" if target < 1 << 30 else "true"
    return f"""WITH RECURSIVE o AS MATERIALIZED ({rows}), w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(x BIGINT, y BIGINT, b VARCHAR, k VARCHAR)[]) AS c
    UNION ALL SELECT o.i, CASE WHEN {near} = 0 AND {room} THEN list_append(c, {{'x': CAST(o.grid_x AS BIGINT), 'y': CAST(o.grid_y AS BIGINT), 'b': o.bucket_id, 'k': o.region_id}}) ELSE c END FROM w JOIN o ON o.i = w.i + 1)
    SELECT p.k AS region_id, p.b AS bucket_id, p.x AS grid_x, p.y AS grid_y FROM (SELECT unnest(c) AS p FROM w WHERE i = (SELECT max(i) FROM w)) z"""


@q("smp12_separated", f"SELECT region_id FROM ({_walk(f'SELECT *, 1 AS q, row_number() OVER (ORDER BY ' + _frac('anchor', 'region_id') + f', region_id) AS i FROM {G} g', 3)}) x")
def _(t):
    """Each farther than 2 from all others."""
    return sampling.separated(t("regions"), "region_id", 2).select("region_id")


# regions in five buckets; anchors by quota among cells with all neighbours, then a second round over all of them
_REGIONS = f"(SELECT grid_x, grid_y, region_id, split_part(bucket_id, ' ', 1) AS bucket_id FROM {G} r)"
_WHOLE = f"(SELECT a.* FROM {_REGIONS} a WHERE (SELECT count(*) FROM {_REGIONS} b WHERE abs(b.grid_x - a.grid_x) <= 1 AND abs(b.grid_y - a.grid_y) <= 1) = 9)"
_PASSES = f"""SELECT *, row_number() OVER (ORDER BY pass, CASE WHEN pass = 1 THEN bucket_id ELSE '' END, {_frac('anchor', 'region_id')}, region_id) AS i FROM (
SELECT 1 AS pass, h.*, q FROM {_WHOLE} h JOIN (SELECT bucket_id, max(quota) AS q FROM ({_quota('SELECT 12', 0.5, 'anchor', _WHOLE)}) z GROUP BY 1) y ON h.bucket_id = y.bucket_id UNION ALL SELECT 2, h.*, 1000000 FROM {_WHOLE} h) u"""
_ANCHORS = _walk(_PASSES, 3, 12)
_AWAY = f"(SELECT g.* FROM {_REGIONS} g WHERE NOT EXISTS (SELECT 1 FROM ({_ANCHORS}) a WHERE greatest(abs(a.grid_x - g.grid_x), abs(a.grid_y - g.grid_y)) <= 3))"


@q("job11_centres", f"SELECT region_id, bucket_id, 'anchor' AS kind FROM ({_ANCHORS}) a UNION ALL SELECT region_id, bucket_id, 'isolated' FROM ({_quota('SELECT 20', 0.5, 'isolated', _AWAY)}) b")
def _(t):
    from .jobs import centres

    return centres(t("regions").withColumn("bucket_id", F.substring_index("bucket_id", " ", 1)), 12, 20, 3, 1)


@q("smp13_members", f"SELECT a.region_id AS anchor, b.region_id, b.grid_x - a.grid_x AS dx, b.grid_y - a.grid_y AS dy FROM {G} a JOIN {G} b ON abs(a.grid_x - b.grid_x) <= 1 AND abs(a.grid_y - b.grid_y) <= 1 WHERE a.k % 17 = 0")
def _(t):
    return _out(sampling.expand_members(t("regions").where("k % 17 = 0"), t("regions"), "region_id", 1))


@q("smp14_isolated", f"SELECT region_id, bucket_id, 'quota' AS pick FROM ({_quota('SELECT 120', 0.5, 'isolated')}) x")
def _(t):
    return sampling.isolated_centres(t("regions"), "bucket_id", "region_id", 120, 0.5).select("region_id", "bucket_id", "pick")


@q("smp15_phases", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus = 'P' ORDER BY o_orderkey) AS r FROM orders) x ORDER BY r > 100, r, o_orderstatus = 'P', o_orderkey LIMIT 200")
def _(t):
    return sampling.balanced_phases(t("orders").withColumn("phase", F.col("o_orderstatus") == "P"), "phase", "o_orderkey", 200).select("o_orderkey")


@q("smp16_first_complete", "SELECT user_id, CASE WHEN row_number() OVER (ORDER BY user_id) <= 30 THEN 'train' ELSE 'val' END AS split_group FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' ORDER BY user_id LIMIT 40) x")
def _(t):
    return sampling.first_complete(t("events"), "user_id", "event_id", F.col("event_type") == "purchase", 30, 10).select("user_id", "split_group")


@q("gen01_grid", f"WITH e AS (SELECT CAST(floor((min(longitude) - 0.1) / 0.25) AS BIGINT) AS a, CAST(ceil((max(longitude) + 0.1) / 0.25) AS BIGINT) - 1 AS b, CAST(floor((min(latitude) - 0.1) / 0.25) AS BIGINT) AS c, CAST(ceil((max(latitude) + 0.1) / 0.25) AS BIGINT) - 1 AS d FROM {W} w) SELECT cx, cy, cx * 0.25::DOUBLE AS min_lon, cy * 0.25::DOUBLE AS min_lat, (cx + 1) * 0.25::DOUBLE AS max_lon, (cy + 1) * 0.25::DOUBLE AS max_lat FROM (SELECT unnest(range(a, b + 1)) AS cx FROM e) x, (SELECT unnest(range(c, d + 1)) AS cy FROM e) y")
def _(t):
    return _out(summaries.degree_grid(t("wells"), 0.25, 0.1))


@q("gen01_occupied_cells", f"SELECT DISTINCT CAST(floor(longitude / 0.05::DOUBLE) AS BIGINT) + dx AS cx, CAST(floor(latitude / 0.05::DOUBLE) AS BIGINT) + dy AS cy FROM {W} w, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)")
def _(t):
    return summaries.occupied_cells(t("wells"), 0.05)


@q("gen03_location_pool", f"SELECT objectid, r AS n, round(latitude, 6) AS latitude, round(x0 + j * step, 6) AS longitude FROM (SELECT *, row_number() OVER (PARTITION BY objectid ORDER BY i, j) AS r FROM (SELECT *, unnest(range(CAST(floor((x1 - x0) / step) AS BIGINT) + 1)) AS j FROM (SELECT *, y0 + i * 0.1::DOUBLE AS latitude, 0.05::DOUBLE / greatest(cos(radians(y0 + i * 0.1::DOUBLE)), 0.01) AS step FROM (SELECT *, unnest(range(CAST(floor((y1 - y0) / 0.1::DOUBLE) AS BIGINT) + 1)) AS i FROM {sql('geology')} g) f) a) b) c WHERE r <= 20")
def _(t):
    g = t("geology").withColumnsRenamed({"x0": "west", "x1": "east", "y0": "south", "y1": "north"})
    return _out(summaries.location_pool(g, "objectid", 0.1, 0.05, 20))


@q("gen04_year_bins", "SELECT y AS year, b AS bin, CAST(make_date(y, 1, 1) + CAST(b * 16 AS INTEGER) AS VARCHAR) AS bin_start, CAST(least(make_date(y, 1, 1) + CAST(b * 16 + 16 AS INTEGER), make_date(y + 1, 1, 1)) AS VARCHAR) AS bin_end FROM (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders) o, (SELECT unnest(range(23)) AS b) x WHERE make_date(y, 1, 1) + CAST(b * 16 AS INTEGER) < make_date(y + 1, 1, 1)")
def _(t):
    return _out(observations.year_bins(t("orders").select(F.year("o_orderdate").alias("year")).distinct(), 16).select("year", "bin", "bin_start", "bin_end"))


@q("gen05_seasons", "SELECT y AS year, s AS season, CAST(make_date(y, m1, d1) AS VARCHAR) AS season_start, CAST(make_date(y, m2, d2) AS VARCHAR) AS season_end FROM (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders) o, (VALUES ('early_spring', 3, 1, 4, 30), ('late_spring', 5, 1, 6, 30), ('summer', 7, 1, 8, 31), ('fall', 9, 1, 10, 31)) v(s, m1, d1, m2, d2)")
def _(t):
    return _out(observations.seasons(t("orders").select(F.year("o_orderdate").alias("year")).distinct()))


@q("gen06_sequences", f"SELECT concat(well_api, '__year_', CAST(year(spud_date) + 1 AS VARCHAR)) AS sequence_id FROM {W} w")
def _(t):
    return observations.location_years(t("wells").withColumnRenamed("well_api", "sample_id"), date="spud_date", offset=1).select("sequence_id")


@q("gen07_events", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame, role, turn FROM conversations")
def _(t):
    index = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l")).select("conv_id", F.transform("l", lambda x: x["turn"]).alias("turns"), F.transform("l", lambda x: x["role"]).alias("roles"))
    return _out(observations.observation_events(index, "conv_id", {"turn": "turns", "role": "roles"}))


# offsets of 5 x 5 tiles and the place of each on the sphere
_SPAN = "(VALUES (-2), (-1), (0), (1), (2))"
_ANGLE, _BEARING = f"(sqrt(x * x + y * y) / ({R}::DOUBLE * 1000))", "atan2(x, y)"
_SINE = f"(sin(radians(latitude)) * cos({_ANGLE}) + cos(radians(latitude)) * sin({_ANGLE}) * cos({_BEARING}))"
_TILES = f"""SELECT sample_id, kind, dx, dy, concat(sample_id, '_', kind, '_', CAST(dx AS VARCHAR), '_', CAST(dy AS VARCHAR)) AS tile_id, greatest(abs(dx), abs(dy)) AS ring,
CASE WHEN dx = 0 AND dy = 0 THEN 'center' ELSE concat(CASE WHEN dy > 0 THEN 'north' WHEN dy < 0 THEN 'south' ELSE '' END, CASE WHEN dx > 0 THEN 'east' WHEN dx < 0 THEN 'west' ELSE '' END) END AS role, degrees(asin({_SINE})) AS tile_lat,
degrees(radians(longitude) + atan2(sin({_BEARING}) * sin({_ANGLE}) * cos(radians(latitude)), cos({_ANGLE}) - sin(radians(latitude)) * {_SINE})) AS tile_lon
FROM (SELECT *, dx * 2560.0::DOUBLE AS x, dy * 2560.0::DOUBLE AS y FROM {L} l, (SELECT 'local' AS kind, a.c AS dx, b.c AS dy FROM {_SPAN} a(c), {_SPAN} b(c) UNION ALL SELECT 'regional', 0, 0) o) z"""


@q("gen08_tile_manifest", f"SELECT sample_id, tile_id, kind, dx, dy, ring, role, round(tile_lat, 6) AS tile_lat, round(tile_lon, 6) AS tile_lon FROM ({_TILES}) x")
def _(t):
    return _out(observations.tile_manifest(t("locations"), "sample_id", 2, 2560.0))


_WINDOWS = f"SELECT a.sample_id, a.tile_id AS target_id, count(*) AS n_members, count(*) FILTER (WHERE greatest(abs(b.dx - a.dx), abs(b.dy - a.dy)) <= 1) AS n_support, count(*) FILTER (WHERE greatest(abs(b.dx - a.dx), abs(b.dy - a.dy)) <= 1 AND b.ring > 1) AS n_halo FROM ({_TILES}) a JOIN ({_TILES}) b ON a.sample_id = b.sample_id WHERE a.kind = 'local' AND b.kind = 'local' AND a.ring <= 1 GROUP BY 1, 2"


@q("gen09_training_windows", _WINDOWS)
def _(t):
    return _out(observations.training_windows(observations.tile_manifest(t("locations"), "sample_id", 2, 2560.0), "sample_id", 1, 1))


@q("gen10_raster_tiles", f"SELECT DISTINCT printf('n%02dw%03d', CAST(ceil(latitude) AS BIGINT), CAST(ceil(-longitude) AS BIGINT)) AS tile_id FROM {W} w")
def _(t):
    return summaries.raster_tiles(t("wells"), C.dem_tile(F.col("latitude"), F.col("longitude")))


@q("flt01_basin_scope", f"SELECT well_api FROM {W} w WHERE unconventional AND county_name IN ('NATION_1', 'NATION_2', 'NATION_3')")
def _(t):
    return t("wells").where(F.col("unconventional") & F.upper(F.trim("county_name")).isin("NATION_1", "NATION_2", "NATION_3") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("well_api")


@q("flt02_trainable", f"SELECT well_api FROM ({_PRORATED}) x WHERE first_prod_date IS NOT NULL AND f12_gas IS NOT NULL AND label_f12_available = 'true'")
def _(t):
    got = life.day_prorated_labels(t("wells"), t("production"))
    return got.where("first_prod_date is not null and f12_gas is not null and label_f12_available").select("well_api")


@q("flt03_points_in_window", f"SELECT well_api, CAST((SELECT count(*) FROM {W} w WHERE longitude BETWEEN -80.5 AND -80.0 AND latitude BETWEEN 39.5 AND 40.0) > 50 AS VARCHAR) AS truncated FROM (SELECT * FROM {W} w WHERE longitude BETWEEN -80.5 AND -80.0 AND latitude BETWEEN 39.5 AND 40.0 ORDER BY k LIMIT 50) x")
def _(t):
    return _out(summaries.window_query(t("wells"), -80.5, 39.5, -80.0, 40.0, 50, ["k"]).select("well_api", "truncated"))


for _name, _op, _layer in (("flt04_boxes_in_window", ">", False), ("flt05_layers_in_window", ">=", True)):

    @q(_name, f"SELECT scene_id, CAST((SELECT count(*) FROM {S} s WHERE NOT (east < -80.5 OR west > -80 OR north < 39.5 OR south > 40)) {_op} 200 AS VARCHAR) AS truncated FROM (SELECT * FROM {S} s WHERE NOT (east < -80.5 OR west > -80 OR north < 39.5 OR south > 40) ORDER BY scene_id LIMIT 200) x")
    def _(t, layer=_layer):
        return _out(summaries.window_query(t("scenes"), -80.5, 39.5, -80.0, 40.0, 200, ["scene_id"], boxes=True, layer=layer).select("scene_id", "truncated"))


@q("flt06_quality_gate", "SELECT event_id, round(coalesce(CASE WHEN event_id % 3 <> 0 THEN value / 500 END, CASE WHEN event_id % 2 = 0 THEN value / 400 END, 0), 6) AS quality FROM events WHERE coalesce(CASE WHEN event_id % 3 <> 0 THEN value / 500 END, CASE WHEN event_id % 2 = 0 THEN value / 400 END, 0) >= 0.05")
def _(t):
    rows = t("events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value") / 500).alias("c"), F.when(F.col("event_id") % 2 == 0, F.col("value") / 400).alias("v"))
    return _out(observations.quality_gate(rows, "c", "v", 0.05).select("event_id", "quality"))


@q("flt08_recent_clear", f"SELECT scene_id FROM {S} s WHERE epoch_s >= (SELECT max(epoch_s) FROM {S} s) - 864000 AND (cloud_cover IS NULL OR cloud_cover < 20)")
def _(t):
    return observations.recent_clear(t("scenes"), 10, 20.0).select("scene_id")


@q("flt09_slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def _(t):
    return t("orders").select("o_orderkey").orderBy("o_orderkey").offset(100).limit(50)


@q("flt10_shard_filter", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) x WHERE (n - 1) % 7 = 3")
def _(t):
    return ranking.number_rows(t("orders").select("o_orderkey"), [F.col("o_orderkey")], "n").where(F.pmod(F.col("n") - 1, F.lit(7)) == 3).select("o_orderkey")


@q("flt11_trim_plan", f"SELECT k, bin FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bin) AS n FROM ({_PLAN}) p WHERE has_s2 AND has_s1) a WHERE n <= 8) b WHERE c >= 5")
def _(t):
    return observations.trim_plan(_plan(t), "k", "bin", 8, 5).select("k", "bin")


@q("flt12_permits_of_wells", f"SELECT well_api FROM {W} w WHERE lower(well_status) LIKE '%proposed%'")
def _(t):
    return t("wells").where(F.coalesce(F.lower("well_status").contains("proposed"), F.lit(False))).select("well_api")


@q("flt13_paired_share", f"SELECT k FROM (SELECT k, sum((has_s2 AND has_s1)::INT) / count(*)::DOUBLE AS s FROM ({_PLAN}) p GROUP BY 1) x WHERE s >= 0.3")
def _(t):
    return observations.coverage(_plan(t), "k", 37).where(F.coalesce(F.col("n_paired") / F.nullif("n_bins", F.lit(0)), F.lit(0.0)) >= 0.3).select("k")


@q("prj01_align", f"SELECT well_api, state, region_id, round(longitude, 6) AS nearest_well_km, round(latitude, 6) AS latitude, CAST(spud_date AS VARCHAR) AS spud_date, well_status, CAST(NULL AS DOUBLE) AS f12_gas, CAST(46 AS BIGINT) AS n_columns FROM (SELECT *, 'PA' AS state, 'r1' AS region_id FROM {W} w) x")
def _(t):
    got = merging.align(t("wells").withColumn("nearest_well_distance_km", F.col("longitude")), {"nearest_well_distance_km": "nearest_well_km"}, state="PA", region_id="r1")
    return _out(got.select("well_api", "state", "region_id", "nearest_well_km", "latitude", "spud_date", "well_status", "f12_gas", F.lit(len(got.columns)).alias("n_columns")))


@q("prj02_ensure_features", "SELECT c_custkey AS k, TRY_CAST(c_name AS DOUBLE) AS c_name, CAST(NULL AS DOUBLE) AS extra, CAST(c_nationkey AS VARCHAR) AS cat FROM customer")
def _(t):
    return merging.ensure_features(t("customer").select(F.col("c_custkey").alias("k"), "c_name", F.col("c_nationkey").alias("cat")), ["c_name", "extra"], ["cat"]).select("k", "c_name", "extra", "cat")


@q("prj03_keep_sorted", f"SELECT well_api, county_name FROM {W} w ORDER BY well_api")
def _(t):
    return merging.keep_sorted(t("wells"), ["well_api", "county_name", "not_there"], ["well_api"])


@q("prj04_tree_fill", "SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END, -999) AS v, coalesce(nullif(o_orderpriority, '5-LOW'), 'missing') AS p FROM orders")
def _(t):
    rows = t("orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("v"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return merging.fill_for_trees(rows, ["v"], ["p"])


@q("val01_validate", "SELECT 'r' AS region_id, 'duplicate' AS kind, count(*) - count(DISTINCT o_custkey) AS n FROM orders")
def _(t):
    rows = merging.validate(t("orders").select(F.col("o_custkey").cast("string").alias("well_api"), F.lit(40.0).alias("latitude"), F.lit(-80.0).alias("longitude")), "r")
    return rows.where(F.col("warning").contains("duplicate")).select("region_id", F.lit("duplicate").alias("kind"), F.regexp_extract("warning", r"(\d+)", 1).cast("long").alias("n"))


@q("val02_require", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS n_unusable, count(*) FILTER (WHERE o_orderkey % 9 <> 0) - count(DISTINCT o_custkey) FILTER (WHERE o_orderkey % 9 <> 0) AS n_repeats FROM orders")
def _(t):
    rows = t("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("v"))
    return merging.require(rows, ["o_custkey", "v"], ["o_custkey"], [F.col("o_orderkey")])[1]


@q("val03_aligned_keys", "SELECT coalesce(a.u, b.u) AS shard, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, CAST(coalesce(a.l = b.l, false) AS VARCHAR) AS aligned FROM (SELECT user_id AS u, count(*) AS n, list_sort(list(DISTINCT CAST(ts AS DATE))) AS l FROM events WHERE event_type = 'view' GROUP BY 1) a FULL JOIN (SELECT user_id AS u, count(*) AS n, list_sort(list(DISTINCT CAST(ts AS DATE))) AS l FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.u = b.u")
def _(t):
    e = t("events").select(F.col("user_id").alias("shard"), F.col("ts").cast("date").alias("day"), "event_type")
    return _out(merging.aligned_keys(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "shard", "day"))


_CLS = f"SELECT region, n, p, CASE WHEN p > 0 AND p < n THEN round((rs - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)), 6) END AS roc_auc, CASE WHEN p > 0 AND p < n THEN round(ap / p, 6) END AS average_precision FROM (SELECT region, CAST(sum(c) AS BIGINT) AS n, CAST(sum(q) AS BIGINT) AS p, sum(q * (below + (c + 1) / 2.0::DOUBLE)) AS rs, sum(q * tp / seen::DOUBLE) AS ap FROM (SELECT *, coalesce(sum(c) OVER (PARTITION BY region ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(q) OVER (PARTITION BY region ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(c) OVER (PARTITION BY region ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS seen FROM (SELECT region, score, count(*) AS c, sum((y_true = 1)::INT) AS q FROM {sql('scored')} s GROUP BY 1, 2) a) b GROUP BY 1) d"


@q("ml09_classification", _CLS)
def _(t):
    return _out(metrics.classification(t("scored"), by="region").withColumnsRenamed({"n_rows": "n", "n_pos": "p"}))


@q("ml10_regression", f"SELECT region, count(*) AS n_rows, round(sqrt(avg(power(y_true - y_pred, 2))), 4) AS rmse, round(avg(abs(y_true - y_pred)), 4) AS mae, round(1 - sum(power(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)), 4) AS r2 FROM {sql('reg_scored')} r GROUP BY 1")
def _(t):
    return _out(metrics.regression(t("reg_scored"), by="region"), 4)


@q("ml11_accuracy", f"SELECT round(avg(((score >= 0.5)::INT = y_true)::INT), 6) AS accuracy FROM {sql('scored')} s")
def _(t):
    return _out(metrics.accuracy(t("scored"), "y_true", "score"))


@q("ml12_class_balance", f"SELECT region, CAST(y_true AS BIGINT) AS y_true, count(*) AS n_rows FROM {sql('scored')} s GROUP BY 1, 2")
def _(t):
    return _out(metrics.class_balance(t("scored"), "y_true", ["region"]))


@q("snk02_sidecar", f"SELECT count(*) AS n_rows, CAST(min(spud_date) AS VARCHAR) AS min_date, CAST(max(spud_date) AS VARCHAR) AS max_date, count(*) FILTER (WHERE unconventional) AS positive_unconventional, 'spud_date,unconventional' AS columns FROM {W} w")
def _(t):
    return summaries.table_sidecar(t("wells").select("spud_date", "unconventional"), "spud_date", ["unconventional"])


@q("str01_refresh_start", f"SELECT CAST(max(day) - 3 AS VARCHAR) AS start FROM {sql('catalog_old')} o")
def _(t):
    return _out(merging.refresh_start(t("catalog_old"), "day", 3, "2020-01-01"))


@q("str02_time_bins", "SELECT event_id, CAST(floor((dayofyear(ts) - 1) / 7) AS BIGINT) AS bin FROM events")
def _(t):
    return _out(t("events").select("event_id", observations.bin_of(F.col("ts").cast("date"), 7).alias("bin")))


@q("job02_training_table_v0", f"""SELECT w.well_api, w.county_name, coalesce(permit_count, 0) AS permit_count, coalesce(observed_rows, 0) AS observed_rows, round(coalesce(observed_gas, 0), 6) AS observed_gas, g.objectid AS geology_id,
CAST(w.well_status IN ('Active','Plugged OG Well','Abandoned') OR y.well_api IS NOT NULL AS VARCHAR) AS trainable, CASE WHEN w.well_status IN ('Active','Plugged OG Well','Abandoned') OR y.well_api IS NOT NULL THEN CAST(coalesce(observed_gas, 0) >= 1000 AS VARCHAR) END AS label_ge_1000
FROM {W} w LEFT JOIN (SELECT well_api, count(*) AS permit_count FROM {P} p GROUP BY 1) x ON w.well_api = x.well_api LEFT JOIN ({_AGG02}) y ON w.well_api = y.well_api
LEFT JOIN (SELECT w.well_api, min(g.objectid) AS objectid FROM {W} w JOIN {sql('geology')} g ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1 AND NOT (objectid % 3 = 0 AND longitude > x0 + 0.1 AND longitude < x0 + 0.3 AND latitude > y0 + 0.1 AND latitude < y0 + 0.3) GROUP BY 1) g ON w.well_api = g.well_api""")
def _(t):
    from .jobs import training_table_v0

    got = training_table_v0(t("wells"), t("permits"), t("production"), _polygons(t), ["map_symbol"])
    return _out(got.select("well_api", "county_name", "permit_count", "observed_rows", "observed_gas", F.col("objectid").alias("geology_id"), F.col("trainable_v0").alias("trainable"), F.col("label_obs_ge_1000").alias("label_ge_1000")))
