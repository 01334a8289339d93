"""Spark ML members: fit on assembled features, score to one probability column."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schema

# --- fixed values: defaults of the members ---------------------------------
GBT_DEFAULTS = {"maxIter": 500, "maxDepth": 8, "stepSize": 0.1, "subsamplingRate": 0.8}
FOREST_DEFAULTS = {"numTrees": 500, "maxDepth": 10, "minInstancesPerNode": 10}
EDA_FOREST = {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 10}
BASELINE_FOREST = {"numTrees": 100, "maxDepth": 5, "cacheNodeIds": False}  # shallow: coming down again is as fast, and rows take less memory
PARALLEL = 3  # fits at a time


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vector ``features``; rows must have been imputed before."""
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def gbt(label: str, weight: str | None = None, validation: str | None = None, **params) -> GBTClassifier:
    """Boosted trees; with a validation column fitting stops once its loss no longer falls."""
    chosen = {**GBT_DEFAULTS, **params}
    learner = GBTClassifier(labelCol=label, featuresCol="features", seed=schema.SEED, **chosen)
    if weight:
        learner = learner.setWeightCol(weight)
    return learner.setValidationIndicatorCol(validation) if validation else learner


def forest(label: str, weight: str | None = None, **params) -> RandomForestClassifier:
    """Bagged trees. Each row's node is kept from level to level, so that it need not come down every tree again."""
    chosen = {**FOREST_DEFAULTS, "cacheNodeIds": True, **params}
    learner = RandomForestClassifier(labelCol=label, featuresCol="features", seed=schema.SEED, **chosen)
    return learner.setWeightCol(weight) if weight else learner


def logistic(label: str, weight: str | None = None, **params) -> LogisticRegression:
    learner = LogisticRegression(labelCol=label, featuresCol="features", **params)
    return learner.setWeightCol(weight) if weight else learner


def scored(model: Model, df: DataFrame, name: str = "probability_1") -> DataFrame:
    """``df`` plus the probability of class 1 under ``name``."""
    out = model.transform(df)
    made = [c for c in ("rawPrediction", "probability", "prediction") if c not in df.columns]
    return out.withColumn(name, vector_to_array("probability")[1]).drop(*made)


def fitted(jobs: list[tuple[Estimator, DataFrame]], parallelism: int = PARALLEL) -> list[Model]:
    """Every learner fitted on its rows, several at a time: the short jobs of one fit leave cores idle that another can use."""
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        return pool.map(lambda job: job[0].copy().fit(job[1]), jobs, chunksize=1)


def importances(model, features: list[str]) -> list[tuple[str, float, float]]:
    """(feature, importance, deviation over the trees), one entry per feature."""
    per_tree = [tree.featureImportances.toArray() for tree in model.trees]
    mean = model.featureImportances.toArray()
    out = []
    for i, name in enumerate(features):
        values = [float(t[i]) for t in per_tree]
        centre = sum(values) / len(values)
        spread = (sum((v - centre) ** 2 for v in values) / len(values)) ** 0.5
        out.append((name, float(mean[i]), spread))
    return out


def importance_frame(spark, model, features: list[str]) -> DataFrame:
    rows = importances(model, features)
    made = spark.createDataFrame(rows, "feature string, importance double, std double")
    return made.orderBy(F.desc("importance"), "feature")


def select_by_importance(model, features: list[str]) -> list[str]:
    """Features at or above the median importance."""
    rows = importances(model, features)
    ordered = sorted(v for _, v, _ in rows)
    half = len(ordered) // 2
    middle = ordered[half] if len(ordered) % 2 else (ordered[half - 1] + ordered[half]) / 2
    return [name for name, value, _ in rows if value >= middle]
