"""Models as Spark ML pipelines: a grid evaluated over folds of whole groups, the best of it, models saved and loaded, scores of new rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions import expr as E
from assayloom.operators.ranking import ranked
from assayloom.operators.regress import metrics
from assayloom.shared import shared_folder, stored

BASELINE = "mean"


def preparation(features: list[str]) -> list:
    """Unknown features are filled with medians of the rows fitted to, all are standardised."""
    filled = [f"_f_{c}" for c in features]
    return [
        Imputer(inputCols=features, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="_vector"),
        StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=True, withStd=True),
    ]


def on_scaled(estimator, target: str):
    return estimator.copy({estimator.featuresCol: "_scaled", estimator.labelCol: target, estimator.predictionCol: "prediction"})


def pipeline(features: list[str], target: str, estimator) -> Pipeline:
    return Pipeline(stages=[*preparation(features), on_scaled(estimator, target)])


def forest(trees: int = 200, depth: int = 8, part: str = "onethird", bootstrap: bool = True, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy=part, bootstrap=bootstrap, seed=seed)


def elastic(alpha: float, l1: float) -> LinearRegression:
    return LinearRegression(regParam=alpha, elasticNetParam=l1, standardization=True)


def boosted(rounds: int = 20, depth: int = 3, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed)


def grid() -> dict:
    """Names and estimators; the baseline has none."""
    models = {f"elastic_net_a{a:g}_l{r:g}": elastic(a, r) for a in (0.01, 0.1, 0.5) for r in (0.2, 0.5, 0.8)}
    models |= {f"random_forest_n200_depth{d}_{p}": forest(200, d, p) for d, p in ((4, "sqrt"), (8, "onethird"))}
    return {BASELINE: None} | models


def held_out(rows: DataFrame, features: list[str], target: str, group: Column, models: dict, folds: int = 3) -> DataFrame:
    """(model, row_id, actual, prediction): each row with a target predicted by models fitted to the folds without its group. Rows without a
    target are left out. Rows are stored with their folds, and once per fold as prepared by what is fitted to the other folds."""
    rows = rows.withColumns({c: E.known(c) for c in [*features, target]}).where(F.col(target).isNotNull())
    rows = stored(rows.select("row_id", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int").alias("fold"), F.col(target).alias("actual"), *features), "folds")
    parts = []
    for fold in range(folds):
        prepared = Pipeline(stages=preparation(features)).fit(rows.where(F.col("fold") != fold))
        ready = stored(prepared.transform(rows).select("row_id", "fold", "actual", "_scaled"), "prepared")
        train, test = ready.where(F.col("fold") != fold), ready.where(F.col("fold") == fold)
        for name, estimator in models.items():
            if estimator is None:
                made = test.crossJoin(F.broadcast(train.agg(F.avg("actual").alias("prediction"))))  # one row
            else:
                made = on_scaled(estimator, "actual").fit(train).transform(test)
            parts.append(made.select(F.lit(name).alias("model"), "row_id", "actual", "prediction"))
    return reduce(DataFrame.unionByName, parts)


def leaderboard(predictions: DataFrame) -> DataFrame:
    """(place, model, n, mae, rmse, r2), the best first: by mae, then rmse, then name. One row per model."""
    table = metrics(predictions, "actual", "prediction", ["model"])
    return ranked(table, {"mae": False, "rmse": False, "model": False}, "place").select("place", "model", "n", "mae", "rmse", "r2").orderBy("place")


def fitted(rows: DataFrame, features: list[str], target: str, estimator) -> PipelineModel:
    rows = rows.withColumns({c: E.known(c) for c in [*features, target]}).where(F.col(target).isNotNull())
    return pipeline(features, target, estimator).fit(rows)


def saved(model: PipelineModel, rows: DataFrame, name: str) -> str:
    """The path of the model in the shared folder."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    model.save(path)
    return path


def scored(rows: DataFrame, path: str, features: list[str], training: DataFrame) -> DataFrame:
    """(row_id, prediction, ic50_um, distance) of rows by a saved model: the prediction as a concentration too, and how far the row's features
    are from those that the model was fitted to. Unknown features are filled as the model does and left out of the distance."""
    rows = rows.withColumns({c: E.known(c) for c in features})
    made = PipelineModel.load(path).transform(rows).select("row_id", "prediction", *features)
    beside = E.beside(made, E.population(training, features))
    return beside.select("row_id", "prediction", E.micromolar(F.col("prediction")).alias("ic50_um"), E.distance_to_training(features).alias("distance"))
