"""Models on Spark ML: preprocessing, balanced logistic baseline, boosted trees, probes, and scoring of cells."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import inverse_target, tier, transform_target
from . import metrics
from .ranking import average_rank_percentile


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The most frequent known value of each column (ties: the smallest)."""
    row = df.agg(*[F.mode(c, True).alias(c) for c in columns]).first() if columns else {}
    return {c: row[c] if row[c] is not None else "missing" for c in columns}


def preprocess(numeric: list[str], categorical: list[str], scale: bool = False) -> list:
    """ML-01: median for missing numbers, one-hot with unknown values ignored; categorical columns are filled with fill_modes before."""
    filled = [f"{c}__f" for c in numeric]
    stages: list = [Imputer(inputCols=numeric, outputCols=filled, strategy="median")] if numeric else []
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}__i" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__i" for c in categorical], outputCols=[f"{c}__o" for c in categorical], handleInvalid="keep")]
    stages.append(VectorAssembler(inputCols=filled + [f"{c}__o" for c in categorical], outputCol="raw_features" if scale else "features"))
    return [*stages, StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)] if scale else stages


def balanced(df: DataFrame, label: str) -> DataFrame:
    """ML-02: a weight column that makes both classes count alike."""
    n = df.agg(F.count(label).alias("n"), F.sum(F.col(label).cast("double")).alias("p")).first()
    pos, neg = n.p or 0.0, n.n - (n.p or 0.0)
    return df.withColumn("weight", F.when(F.col(label) == 1, n.n / (2 * pos) if pos else 1.0).otherwise(n.n / (2 * neg) if neg else 1.0))


def spread(df: DataFrame, n: int, most: int = 200_000) -> DataFrame:
    """df, of n rows, in parts of about `most` rows. A fit of trees keeps its rows and reads them for each level of a tree, part by part, and a compact file comes as few parts."""
    return df.repartition(-(-n // most)) if n > most else df


def classifier(train: DataFrame, label: str, numeric: list[str], categorical: list[str], kind: str = "logistic", trees: int = 20, depth: int = 4, subsample: float = 0.8) -> PipelineModel:
    """ML-02, ML-03: "logistic" (scaled, balanced) or "trees" (positives weigh neg / pos). label: 0 or 1. subsample: share of the rows that each tree sees."""
    rows = train.fillna(modes(train, categorical)) if categorical else train
    if kind == "logistic":
        return Pipeline(stages=[*preprocess(numeric, categorical, True), LogisticRegression(labelCol=label, weightCol="weight", maxIter=50)]).fit(balanced(rows, label))
    n = rows.agg(F.count(label).alias("n"), F.sum(F.col(label).cast("double")).alias("p")).first()
    weighted = rows.withColumn("weight", F.when(F.col(label) == 1, (n.n - n.p) / n.p if n.p else 1.0).otherwise(1.0))
    return Pipeline(stages=[*preprocess(numeric, categorical), GBTClassifier(labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=subsample, seed=42)]).fit(spread(weighted, n.n))


def regressor(train: DataFrame, target: str, numeric: list[str], categorical: list[str], transform: str = "log1p", trees: int = 20, depth: int = 4, subsample: float = 0.8) -> PipelineModel:
    """ML-04: boosted trees on the transformed target."""
    rows = (train.fillna(modes(train, categorical)) if categorical else train).withColumn("target_t", transform_target(F.col(target), transform))
    return Pipeline(stages=[*preprocess(numeric, categorical), GBTRegressor(labelCol="target_t", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=subsample, seed=42)]).fit(spread(rows, rows.count()))


def predict(model: PipelineModel, df: DataFrame, score: str = "score", transform: str | None = None) -> DataFrame:
    """The positive class's probability, or the prediction on the raw scale."""
    out = model.transform(df)
    value = vector_to_array("probability")[1] if "probability" in out.columns else inverse_target(F.col("prediction"), transform or "none")
    return out.select(*df.columns, value.alias(score))


def evaluate_and_refit(df: DataFrame, label: str, numeric: list[str], categorical: list[str], kind: str = "logistic") -> tuple[PipelineModel, DataFrame]:
    """ML-05: metrics of a fit on the train side, and the model fitted on all rows. df has split_group."""
    first = classifier(df.where("split_group = 'train'"), label, numeric, categorical, kind)
    report = metrics.classification(predict(first, df.where("split_group = 'test'")), label)
    return classifier(df, label, numeric, categorical, kind), report


def deploy(df: DataFrame, label: str, numeric: list[str], categorical: list[str], path: str, kind: str = "logistic") -> DataFrame:
    """ML-05: evaluate, refit on all rows, and write the refit model to path/model and the report to path/report; returns the report. An earlier model at path is replaced."""
    model, report = evaluate_and_refit(df, label, numeric, categorical, kind)
    report.write.mode("overwrite").parquet(f"{path}/report")
    model.write().overwrite().save(f"{path}/model")
    return df.sparkSession.read.parquet(f"{path}/report")


def deployed(path: str) -> PipelineModel:
    """The model that deploy wrote."""
    return PipelineModel.load(f"{path}/model")


def score_cells(model: PipelineModel, cells: DataFrame) -> DataFrame:
    """ML-06: score, average-rank percentile and tier."""
    scored = average_rank_percentile(predict(model, cells), "score", "score_percentile")
    return scored.withColumn("prospect_tier", tier(F.col("score_percentile")))


def compare_fused(df: DataFrame, target: str, numeric: list[str], categorical: list[str], vector: str, transform: str = "log1p", trees: int = 20, subsample: float = 0.8) -> DataFrame:
    """ML-07: regression metrics with tabular features, and with the vector's components besides, on the same rows. df has split_group."""
    size = df.select(F.size(vector).alias("n")).where("n > 0").agg(F.max("n")).first()[0] or 0
    wide = df.select("*", *[F.get(vector, F.lit(i)).cast("double").alias(f"v_{i}") for i in range(size)])
    reports = []
    for name, cols in (("tabular", numeric), ("fused", numeric + [f"v_{i}" for i in range(size)])):
        model = regressor(wide.where("split_group = 'train'"), target, cols, categorical, transform, trees, subsample=subsample)
        test = predict(model, wide.where("split_group = 'test'"), "y_pred", transform)
        reports.append(metrics.regression(test, target, "y_pred").select(F.lit(name).alias("features"), "*"))
    return reports[0].unionByName(reports[1])


def probe(df: DataFrame, vector: str, label: str, kind: str = "logistic", alpha: float = 1.0) -> PipelineModel:
    """ML-08: a linear probe on scaled vectors: logistic, or ridge with that alpha."""
    rows = df.withColumn("v", array_to_vector(F.col(vector).cast("array<double>")))
    scaler = StandardScaler(inputCol="v", outputCol="features", withMean=True)
    if kind == "logistic":
        model = LogisticRegression(labelCol=label, maxIter=100)
    else:
        # the solver divides the penalty by the label's deviation and the number of rows
        n, deviation = rows.agg(F.count("*"), F.stddev_pop(label)).first()
        model = LinearRegression(labelCol=label, regParam=alpha * (deviation or 1.0) / (n or 1), elasticNetParam=0.0, standardization=False, solver="normal")
    return Pipeline(stages=[scaler, model]).fit(rows)


def probe_scores(model: PipelineModel, df: DataFrame, vector: str, score: str = "score") -> DataFrame:
    out = model.transform(df.withColumn("v", array_to_vector(F.col(vector).cast("array<double>"))))
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*df.columns, value.alias(score))


def importances(model: PipelineModel, names: list[str], most: int = 25) -> list[tuple[str, float]]:
    """ORD-04: the model's largest feature importances; a vector on the driver."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else [abs(x) for x in last.coefficients.toArray()]
    return sorted(zip(names, values, strict=False), key=lambda p: (-p[1], p[0]))[:most]
