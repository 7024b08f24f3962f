"""Model queries whose results SQL can tell: an optimum is held by its conditions (moments, normal equations), and trees that part all
cells of their features by their closed form (means, boosting steps of a cell)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models
from ..sources.scratch import scratch
from .core_queries import W, _out
from .fixtures import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def q(name: str, oracle: str):
    """Register a function of (load, spark) and its SQL."""

    def wrap(f):
        QUERIES[name] = lambda spark, folder: f(lambda t: load(spark, folder, t), spark)
        SQL[name] = oracle
        return f

    return wrap


#: Wells with a label that hangs on the latitude, and on what no feature tells; four bands of latitude.
_LABELLED = f"(SELECT k, well_api, well_status, county_name, latitude, longitude, CAST(floor(latitude * 2) AS DOUBLE) AS band, CAST(latitude - 40 + ((k * 37) % 100) / 50.0::DOUBLE - 1 > 0 AS INT) AS y FROM {W} w)"


def labelled(t) -> DataFrame:
    late = F.col("latitude") - 40 + ((F.col("k") * 37) % 100) / F.lit(50.0) - 1
    return t("wells").select("k", "well_api", "well_status", "county_name", "latitude", "longitude", F.floor(F.col("latitude") * 2).cast("double").alias("band"), (late > 0).cast("int").alias("y"))


@q(
    "ml01_preprocess",
    """WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN month(o_orderdate) END AS v, nullif(o_orderpriority, '5-LOW') AS p FROM orders),
    m AS (SELECT p AS common FROM f WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1),
    g AS (SELECT o_orderkey, v, coalesce(p, (SELECT common FROM m)) AS p FROM f),
    c AS (SELECT p, row_number() OVER (ORDER BY count(*) DESC, p) - 1 AS place FROM g GROUP BY p)
    SELECT o_orderkey, CAST(coalesce(v, (SELECT quantile_disc(v, 0.5) FROM f)) AS DOUBLE) AS month_filled, g.p AS priority_filled, CAST(place AS BIGINT) AS hot FROM g JOIN c ON g.p = c.p""",
)
def _(t, spark):
    """Missing months take the median, missing priorities the mode; hot is the place of the one in the encoded vector, the commonest value first."""
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.month("o_orderdate").cast("double")).alias("v"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    rows = rows.fillna(models.modes(rows, ["p"]))
    got = Pipeline(stages=models.preprocess(["v"], ["p"])).fit(rows).transform(rows)
    hot = F.array_position(models.vector_to_array("p__o"), F.lit(1.0)) - 1
    return _out(got.select("o_orderkey", F.col("v__f").alias("month_filled"), F.col("p").alias("priority_filled"), hot.alias("hot")))


_WEIGHTED = f"(SELECT *, CASE WHEN y = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS weight FROM (SELECT *, count(*) OVER () * 1.0::DOUBLE AS n, sum(y) OVER () * 1.0::DOUBLE AS p FROM {_LABELLED} l) m)"


@q(
    "ml02_moments",
    f"""SELECT 'latitude' AS feature, round(sum(weight * y * (latitude - 39)) / sum(weight), 4) AS moment FROM {_WEIGHTED} x UNION ALL SELECT 'longitude', round(sum(weight * y * (longitude + 81)) / sum(weight), 4) FROM {_WEIGHTED} x
    UNION ALL SELECT well_status, round(sum(weight * y) / sum(weight), 4) FROM {_WEIGHTED} x GROUP BY 1""",
)
def _(t, spark):
    """The balanced logistic fit is at its optimum exactly where each feature's weighted moment under the fitted scores is that under the labels."""
    rows = labelled(t)
    scored = models.balanced(models.predict(models.classifier(rows, "y", ["latitude", "longitude"], ["well_status"]), rows), "y")
    per = scored.select(F.explode(F.array(F.struct(F.lit("latitude").alias("feature"), (F.col("latitude") - 39).alias("x")), F.struct(F.lit("longitude").alias("feature"), (F.col("longitude") + 81).alias("x")), F.struct(F.col("well_status").alias("feature"), F.lit(1.0).alias("x")))).alias("f"), "score", "weight")
    return _out(per.groupBy("f.feature").agg((F.sum(F.col("weight") * F.col("score") * F.col("f.x")) / F.sum("weight")).alias("moment")), 4)


#: A cell's boosting in closed form: the first tree is the weighted mean of -1 and 1, each later one a tenth of the loss's mean gradient.
_BOOSTED = f"""WITH RECURSIVE c AS (SELECT band, sum(y) * (SELECT sum(1 - y) / sum(y)::DOUBLE FROM {_LABELLED} a) AS pos, sum(1 - y)::DOUBLE AS neg FROM {_LABELLED} l GROUP BY 1),
    b AS (SELECT band, pos, neg, 1 AS tree, (pos - neg) / (pos + neg) AS f FROM c UNION ALL SELECT band, pos, neg, tree + 1, f + 0.1::DOUBLE * (pos * 4 / (1 + exp(2 * f)) - neg * 4 / (1 + exp(-2 * f))) / (pos + neg) FROM b WHERE tree < 8),
    s AS (SELECT band, 1 / (1 + exp(-2 * f)) AS score FROM b WHERE tree = 8)"""


@q("ml03_boosted_bands", f"{_BOOSTED} SELECT well_api, round(score, 6) AS score FROM {_LABELLED} l JOIN s ON l.band = s.band")
def _(t, spark):
    """Eight trees on four bands: each tree can part all bands, so every band is boosted by itself. Checks weights of the classes, loss and step."""
    rows = labelled(t)
    return _out(models.predict(models.classifier(rows, "y", ["band"], [], "trees", 8, subsample=1.0), rows).select("well_api", "score"))


@q("ml04_status_means", f"SELECT w.well_api, round(expm1, 4) AS y_pred FROM {_LABELLED} w JOIN (SELECT well_status, exp(avg(ln(1 + k * 10.0::DOUBLE))) - 1 AS expm1 FROM {_LABELLED} l GROUP BY 1) m ON w.well_status = m.well_status")
def _(t, spark):
    """Regression trees on one-hot statuses: the mean of each status on the log scale, taken back."""
    rows = labelled(t).withColumn("target", F.col("k") * 10.0)
    return _out(models.predict(models.regressor(rows, "target", [], ["well_status"], trees=3, subsample=1.0), rows, "y_pred", "log1p").select("well_api", "y_pred"), 4)


_HALVES = f"(SELECT *, CASE WHEN k % 4 = 0 THEN 'test' ELSE 'train' END AS split_group FROM {_LABELLED} l)"


@q(
    "ml05_deployed",
    f"""WITH a AS (SELECT well_status, sum(y) * 1.0::DOUBLE AS pos, sum(1 - y) * 1.0::DOUBLE AS neg, (SELECT sum(1 - y) / sum(y)::DOUBLE FROM {_LABELLED} x) AS w FROM {_LABELLED} l GROUP BY 1)
    SELECT well_status, round(w * pos / (w * pos + neg), 3) AS score, (SELECT count(*) FROM {_HALVES} h WHERE split_group = 'test') AS n_test, (SELECT CAST(sum(y) AS BIGINT) FROM {_HALVES} h WHERE split_group = 'test') AS n_test_pos FROM a""",
)
def _(t, spark):
    """The model refitted on all rows, written, read again and applied: with one-hot statuses alone its score is the weighted share of positives of the status."""
    rows, path = labelled(t).withColumn("split_group", F.when(F.col("k") % 4 == 0, "test").otherwise("train")), scratch(spark, "model")
    report = models.deploy(rows, "y", [], ["well_status"], path)
    scored = models.predict(models.deployed(path), rows).groupBy("well_status").agg(F.avg("score").alias("score"))
    return _out(scored.crossJoin(F.broadcast(report.select(F.col("n_rows").alias("n_test"), F.col("n_pos").alias("n_test_pos")))), 3)


@q(
    "ml06_ranked_cells",
    f"""{_BOOSTED}, r AS (SELECT well_api, score, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pct FROM {_LABELLED} l JOIN s ON l.band = s.band)
    SELECT well_api, round(score, 6) AS score, round(pct, 6) AS score_percentile, CASE WHEN pct >= 0.9 THEN 'very_high' WHEN pct >= 0.7 THEN 'high' WHEN pct >= 0.4 THEN 'medium' ELSE 'background' END AS prospect_tier FROM r""",
)
def _(t, spark):
    rows = labelled(t)
    model = models.classifier(rows, "y", ["band"], [], "trees", 8, subsample=1.0)
    return _out(models.score_cells(model, rows.select("well_api", "band")).select("well_api", "score", "score_percentile", "prospect_tier"))


_SIGNED = """(SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split_group, vec_id % 2 AS x, list_sum(CAST(embedding[1:32] AS DOUBLE[])) > 0 AS a, list_sum(CAST(embedding[33:] AS DOUBLE[])) > 0 AS b,
    50 + 100 * CAST(embedding[6] AS DOUBLE) AS target FROM embeddings WHERE len(embedding) > 32)"""


def _fused(by: str) -> str:
    pred = f"(SELECT {by}, exp(avg(ln(1 + greatest(target, 0)))) - 1 AS p FROM {_SIGNED} e WHERE split_group = 'train' GROUP BY ALL)"
    return f"SELECT '{'tabular' if by == 'x' else 'fused'}' AS features, count(*) AS n_rows, round(sqrt(avg((target - p) * (target - p))), 4) AS rmse, round(avg(abs(target - p)), 4) AS mae, round(1 - sum((target - p) * (target - p)) / (var_pop(target) * count(*)), 4) AS r2 FROM {_SIGNED} e JOIN {pred} m USING ({by}) WHERE split_group = 'test'"


@q("ml07_fused_signs", f"{_fused('x')} UNION ALL {_fused('x, a, b')}")
def _(t, spark):
    """A tabular feature, and with it the signs of an embedding's two halves: trees of depth 4 part all eight cells."""
    parts = [F.aggregate(half, F.lit(0.0), lambda acc, v: acc + v.cast("double")) for half in (F.slice("embedding", 1, 32), F.expr("slice(embedding, 33, size(embedding))"))]
    e = t("embeddings").where("size(embedding) > 32").select("vec_id", F.array(*[(s > 0).cast("double") for s in parts]).alias("v"), (F.get("embedding", F.lit(5)).cast("double") * 100 + 50).alias("target"), (F.col("vec_id") % 2).cast("double").alias("x"))
    rows = e.withColumn("split_group", F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train"))
    return _out(models.compare_fused(rows, "target", ["x"], [], "v", trees=3, subsample=1.0), 4)


_LONG = "(SELECT vec_id, unnest(range(1, 65)) AS j, CAST(unnest(embedding[1:64]) AS DOUBLE) AS c, vec_id % 10 + 10 * CAST(embedding[1] AS DOUBLE) AS y FROM embeddings WHERE len(embedding) = 64)"


@q(
    "ml08_ridge_conditions",
    f"SELECT j AS component, round(sum(z * y), 3) AS moment FROM (SELECT j, y, (c - avg(c) OVER (PARTITION BY j)) / stddev_samp(c) OVER (PARTITION BY j) AS z FROM {_LONG} l) s GROUP BY 1",
)
def _(t, spark):
    """A ridge probe (alpha 3) on all 64 components is where each scaled component's moment with the prediction, and alpha times its weight, make its moment with the target."""
    e = t("embeddings").where("size(embedding) = 64").select("vec_id", "embedding", ((F.col("vec_id") % 10) + 10 * F.get("embedding", F.lit(0)).cast("double")).alias("y"))
    model = models.probe(e, "embedding", "y", "ridge", 3.0)
    weights = F.array(*[F.lit(float(w)) for w in model.stages[-1].coefficients])
    scored = models.probe_scores(model, e, "embedding").select("score", F.posexplode("embedding").alias("place", "c")).withColumn("c", F.col("c").cast("double"))
    sums = scored.groupBy("place").agg(F.sum(F.col("score") * F.col("c")).alias("sc"), F.sum("score").alias("s"), F.avg("c").alias("m"), F.stddev_samp("c").alias("d"))
    return _out(sums.select((F.col("place") + 1).cast("long").alias("component"), ((F.col("sc") - F.col("s") * F.col("m")) / F.col("d") + 3.0 * F.get(weights, F.col("place"))).alias("moment")), 3)


_SPLITS = ("north", "east", "unconventional")
_FLAGS = f"(SELECT y, CASE WHEN y = 1 THEN (SELECT sum(1 - y) / sum(y)::DOUBLE FROM {_LABELLED} a) ELSE 1.0::DOUBLE END AS w, latitude >= 40.2 AS north, longitude >= -80 AS east, k % 10 <> 0 AS unconventional FROM {_LABELLED} l)"
_GAINS = " UNION ALL ".join(f"SELECT '{c}' AS feature, sum(s * s / n) AS gain FROM (SELECT sum(w * (2 * y - 1)) AS s, sum(w) AS n FROM {_FLAGS} f GROUP BY {c}) g" for c in _SPLITS)


@q("ord04_best_split", f"SELECT feature, CAST(row_number() OVER (ORDER BY gain DESC) = 1 AS INT)::DOUBLE AS importance FROM ({_GAINS}) g")
def _(t, spark):
    """One tree of one split gives all importance to the feature that parts the weighted labels best."""
    rows = labelled(t).select("y", (F.col("latitude") >= 40.2).cast("double").alias("north"), (F.col("longitude") >= -80).cast("double").alias("east"), (F.col("k") % 10 != 0).cast("double").alias("unconventional"))
    model = models.classifier(rows, "y", list(_SPLITS), [], "trees", 1, depth=1, subsample=1.0)
    return spark.createDataFrame([(n, float(v)) for n, v in models.importances(model, list(_SPLITS))], "feature string, importance double")
