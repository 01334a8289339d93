"""A trained stage on disk: the model with all that scoring needs besides it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession

from cohortlens.functions.features import add_features
from cohortlens.functions.project import with_exprs
from cohortlens.models import members
from cohortlens.operators import encoding


@dataclass
class Fitted:
    """``inputs`` are filled with ``medians``, the feature set is added, ``features`` go to the model in that order."""

    stage: str
    version: str
    inputs: list[str]
    medians: dict[str, float]
    feature_set: str | None
    features: list[str]
    threshold: float


def save(spark: SparkSession, path: str, model: Model, fitted: Fitted) -> None:
    model.write().overwrite().save(f"{path}/model")
    text = json.dumps(asdict(fitted))
    spark.createDataFrame([(text,)], "fitted string").write.mode("overwrite").text(f"{path}/fitted")


def load(spark: SparkSession, path: str, kind=GBTClassificationModel) -> tuple[Model, Fitted]:
    text = spark.read.text(f"{path}/fitted").first()["value"]
    return kind.load(f"{path}/model"), Fitted(**json.loads(text))


def probability(df: DataFrame, model: Model, fitted: Fitted, name: str) -> DataFrame:
    """``df`` plus the probability of label 1 of every row; missing inputs count as their median."""
    have = set(df.columns)
    inputs = with_exprs(df, {c: f"double(`{c}`)" if c in have else "CAST(NULL AS DOUBLE)" for c in fitted.inputs})
    filled = encoding.fill(inputs, {c: fitted.medians.get(c) or 0.0 for c in fitted.inputs})
    if fitted.feature_set:
        filled = add_features(filled, fitted.feature_set, fitted.stage)
    wide = with_exprs(filled, {c: f"coalesce(double(`{c}`), 0D)" for c in fitted.features})
    scored = members.scored(model, members.assemble(wide, fitted.features), name)
    return scored.select(*df.columns, name)
