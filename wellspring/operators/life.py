"""First-life production labels and aggregates by well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def permit_summary(permits: DataFrame) -> DataFrame:
    """AGG-01: one row for each known well."""
    return permits.where("well_api is not null").groupBy("well_api").agg(
        F.count("*").alias("permit_count"), F.min("permit_issued_date").alias("first_permit_issued_date"), F.max("permit_issued_date").alias("latest_permit_issued_date"), F.min("spud_date").alias("first_permit_spud_date")
    )


def production_summary(production: DataFrame, scope: str | None = "unconventional") -> DataFrame:
    """AGG-02: rows, sum, mean and largest gas, first start and last end of each well. An all-null sum is 0."""
    rows = production.where("permit_num is not null")
    if scope is not None:
        rows = rows.where(F.col("production_scope") == scope)
    return rows.groupBy(F.col("permit_num").alias("well_api")).agg(
        F.count("*").alias("observed_rows"),
        F.coalesce(F.sum("gas_quantity"), F.lit(0.0)).alias("observed_gas"),
        F.coalesce(F.avg("gas_quantity"), F.lit(0.0)).alias("observed_gas_avg"),
        F.coalesce(F.max("gas_quantity"), F.lit(0.0)).alias("observed_gas_max"),
        F.min("production_period_start_date").alias("observed_first_prod_date"),
        F.max("production_period_end_date").alias("observed_last_prod_date"),
    )


def day_prorated_labels(wells: DataFrame, production: DataFrame, scope: str | None = "unconventional", f12_days: int = 330, f24_days: int = 695) -> DataFrame:
    """AGG-03: gas of the first 365 and 730 days from the first period's start. A record gives the share of its days that
    lie inside; covered days add up over records, so overlapping records count twice. One aggregation gives both horizons."""
    rows = production if scope is None else production.where(F.col("production_scope") == scope)
    rows = rows.select(F.col("permit_num").alias("well_api"), F.col("production_period_start_date").alias("start"), F.col("production_period_end_date").alias("end"), F.coalesce("gas_quantity", F.lit(0.0)).alias("gas"))
    rows = rows.join(wells.select("well_api").distinct(), "well_api", "left_semi")
    first = rows.groupBy("well_api").agg(F.min("start").alias("first_prod_date")).where("first_prod_date is not null")
    rows = rows.join(first, "well_api")
    period = F.datediff("end", "start") + 1

    def inside(days: int) -> Column:
        overlap = F.datediff(F.least(F.col("end"), F.date_add("first_prod_date", days - 1)), F.greatest("start", "first_prod_date")) + 1
        return F.when((overlap > 0) & (period > 0), overlap).otherwise(0)

    sums = []
    for name, days in (("f12", 365), ("f24", 730)):
        share = F.coalesce(F.col("gas") * inside(days) / F.when(period > 0, period).otherwise(1), F.lit(0.0))
        sums += [F.sum(share).alias(f"{name}_gas"), F.sum(F.coalesce(inside(days), F.lit(0))).alias(f"covered_days_{name}")]
    labels = wells.select("well_api").join(rows.groupBy("well_api", "first_prod_date").agg(*sums), "well_api", "left")
    return labels.select(
        "well_api", "first_prod_date", "f12_gas", "f24_gas", "covered_days_f12", "covered_days_f24",
        (F.coalesce("covered_days_f12", F.lit(0)) >= f12_days).alias("label_f12_available"), (F.coalesce("covered_days_f24", F.lit(0)) >= f24_days).alias("label_f24_available"),
    )


def _since_first(production: DataFrame) -> DataFrame:
    """Monthly rows of wells that ever gave gas, with their first such month and the months since."""
    rows = production.where("well_api is not null").withColumn("gas_quantity", F.coalesce("gas_quantity", F.lit(0.0)))
    first = rows.where("gas_quantity > 0").groupBy("well_api").agg(F.min("period_start_date").alias("first_prod_date"))
    months = (F.year("period_start_date") - F.year("first_prod_date")) * 12 + F.month("period_start_date") - F.month("first_prod_date")
    return rows.join(first, "well_api").withColumn("months_since_first", months)


def _months_since_first(production: DataFrame, measures: tuple[str, ...] = ("gas",)) -> DataFrame:
    """A row for each well that ever gave gas and each of its months: sums of the measures, its first month with gas, and the months since. Rows are
    dealt by well once; so months are distinct, and what follows counts them without a distinct aggregate."""
    rows = production.where("well_api is not null").repartition("well_api").groupBy("well_api", "period_start_date").agg(
        F.max(F.coalesce("gas_quantity", F.lit(0.0)) > 0).alias("__gives"), *[F.sum(F.coalesce(f"{m}_quantity", F.lit(0.0))).alias(f"{m}_quantity") for m in dict.fromkeys(("gas", *measures))]
    )
    first = F.min(F.when(F.col("__gives"), F.col("period_start_date"))).over(Window.partitionBy("well_api"))
    months = (F.year("period_start_date") - F.year("first_prod_date")) * 12 + F.month("period_start_date") - F.month("first_prod_date")
    return rows.withColumn("first_prod_date", first).where("first_prod_date is not null").withColumn("months_since_first", months).drop("__gives")


def _within(months: int) -> Column:
    return (F.col("months_since_first") >= 0) & (F.col("months_since_first") < months)


def month_labels(wells: DataFrame, production: DataFrame, f12_months: int = 12, f24_months: int = 24, f12_periods: int | None = None, f24_periods: int | None = None) -> DataFrame:
    """AGG-04: gas of the first 12 and 24 months from the first month with gas; coverage counts distinct months, as 30.44 days each. A label is
    available with so many covered periods (all months, if none is given; fewer where a state reports by quarters)."""
    rows = _months_since_first(production.join(wells.select("well_api").distinct(), "well_api", "left_semi"))
    sums = []
    for name, months in (("f12", f12_months), ("f24", f24_months)):
        sums += [F.sum(F.when(_within(months), F.col("gas_quantity"))).alias(f"{name}_gas"), F.count(F.when(_within(months), F.col("period_start_date"))).alias(f"months_{name}")]
    got = rows.groupBy("well_api").agg(F.min("first_prod_date").alias("first_prod_date"), *sums)
    labels = wells.select("well_api").join(got, "well_api", "left")
    return labels.select(
        "well_api", "first_prod_date", "f12_gas", "f24_gas", (F.col("months_f12") * 30.44).alias("covered_days_f12"), (F.col("months_f24") * 30.44).alias("covered_days_f24"),
        (F.coalesce("months_f12", F.lit(0)) >= (f12_periods or f12_months)).alias("label_f12_available"), (F.coalesce("months_f24", F.lit(0)) >= (f24_periods or f24_months)).alias("label_f24_available"),
    )


def first_life(wells: DataFrame, production: DataFrame, method: str, **options) -> DataFrame:
    """AGG-07: labels by the method's name."""
    methods = {"day_prorated": day_prorated_labels, "monthly": month_labels}
    if method not in methods:
        raise ValueError(f"unknown label method {method}; known: {', '.join(sorted(methods))}")
    return methods[method](wells, production, **options)


def life_summary(production: DataFrame, measures: tuple[str, ...] = ("gas", "oil", "water", "ngl")) -> DataFrame:
    """AGG-05: life-long and first 12 / 24 months' sums of each measure, months seen and last months, in one aggregation."""
    out = [F.min("first_prod_date").alias("first_prod_date"), F.max("period_start_date").alias("latest_prod_date"), F.count("period_start_date").alias("observed_months_all"), F.sum("gas_quantity").alias("observed_gas_all")]
    for n in (12, 24):
        out += [F.sum(F.when(_within(n), F.col(f"{m}_quantity"))).alias(f"f{n}_{m}") for m in measures]
        out += [F.count(F.when(_within(n), F.col("period_start_date"))).alias(f"covered_months_f{n}"), F.max(F.when(_within(n), F.col("period_start_date"))).alias(f"last_month_f{n}")]
    got = _months_since_first(production, measures).groupBy("well_api").agg(*out)
    return got.withColumns({f"label_f{n}_available": F.col(f"covered_months_f{n}") >= n for n in (12, 24)})


def cadence(production: DataFrame, most_quarterly: int = 40) -> DataFrame:
    """AGG-06: one row: the most distinct periods of a well, whether the table is quarterly, and the periods that a full label needs."""
    most = production.where("well_api is not null").groupBy("well_api").agg(F.countDistinct("period_start_date").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_periods"))
    quarterly = F.col("most_periods") <= most_quarterly
    return most.select("most_periods", quarterly.alias("quarterly"), F.when(quarterly, 4).otherwise(12).alias("f12_periods"), F.when(quarterly, 8).otherwise(24).alias("f24_periods"))


def horizons_wide(long: DataFrame, key: str, horizon: str, measures: list[str], names: tuple[str, ...] = ("f12", "f24")) -> DataFrame:
    """AGG-08: (key, horizon, measures) to one row for each key; the horizons are named, so no pass is needed to find them."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col(horizon) == n, F.col(m))).alias(f"{m}_{n}") for m in measures for n in names])


def months_long(wide: DataFrame, keys: list[str], measures: tuple[str, ...], months=("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")) -> DataFrame:
    """AGG-09: a row for each of the twelve months, null ones too; columns such as jan_gas become month and gas."""
    have = set(wide.columns)
    slots = [F.struct(F.lit(k).alias("month"), *[(F.col(f"{m}_{q}") if f"{m}_{q}" in have else F.lit(None).cast("double")).alias(q) for q in measures]) for k, m in enumerate(months, 1)]
    return wide.select(*keys, F.explode(F.array(*slots)).alias("s")).select(*keys, "s.*")


def quarters_long(wide: DataFrame, keys: list[str], slots: list[dict[str, str]]) -> DataFrame:
    """AGG-10: suffixed slots (each a dict of year, quarter, gas, oil column names) to rows. Slots end at the first missing
    year; year 0 and rows with neither gas nor oil are left out; a missing quarter counts as the first."""
    rows = [F.struct(*[F.col(s[n]).cast("double").alias(n) for n in ("year", "quarter", "gas", "oil")]) for s in slots]
    array = F.array(*rows)
    # what stands before the first slot without a year
    end = F.array_position(F.transform(array, lambda s: s["year"].isNull()), True)
    kept = F.when(end == 0, array).otherwise(F.slice(array, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int")))
    long = wide.select(*keys, F.posexplode(kept).alias("slot", "s")).select(*keys, "slot", "s.*")
    return long.where("year <> 0 and (gas is not null or oil is not null)").withColumn("quarter", F.coalesce("quarter", F.lit(1.0)))


def consolidate(rows: DataFrame, key: str, order: list[str], last: list[str] = (), first: list[str] = (), smallest: list[str] = (), largest: list[str] = (), distinct: list[str] = ()) -> DataFrame:
    """AGG-12: one row for each key: the last / first known value of columns in an ascending order with nulls last, extremes and distinct counts.
    The order is written into one struct, so a single aggregation does it without a sort."""
    place = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(c))])
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in last],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in first],
        *[F.min(c).alias(f"min_{c}") for c in smallest],
        *[F.max(c).alias(f"max_{c}") for c in largest],
        *[F.countDistinct(c).alias(f"n_{c}") for c in distinct],
    )


def all_present(flags: list[str]) -> Column:
    """FLT-07: every source is there; a missing flag is false."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit(False)) for f in flags])
