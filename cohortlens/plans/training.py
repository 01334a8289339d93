"""Training of one stage from the standardized table to metrics and a registry row."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schema
from cohortlens.functions.features import add_features, feature_names
from cohortlens.models import artefacts, members
from cohortlens.operators import encoding, metrics, profiling, ranking, splitting
from cohortlens.session import materialize
from cohortlens.sources import files, registry

LABEL = schema.LABEL


def prepare_fitted(
    df: DataFrame, stage: str, feature_set: str | None = "base", shares: dict = splitting.SHARES["60/20/20"],
    fit_on: str = "train",
) -> tuple[DataFrame, list[str], dict[str, float]]:
    """Split, imputed and engineered rows, written once, the feature names and the medians used.

    Medians are taken from the training rows, or from all rows with ``fit_on='all'``.
    """
    base = encoding.stage_features(df, stage)
    matrix = encoding.model_matrix(df, base)
    split = splitting.stratified_split(matrix, "row_id", LABEL, shares)
    source = split.filter(F.col("split") == "train") if fit_on == "train" else split
    medians = ranking.medians(source, base)
    filled = encoding.fill(split, medians)
    names = list(base)
    if feature_set:
        made = feature_names(filled, feature_set, stage)
        filled = add_features(filled, feature_set, stage)
        names += [c for c in made if c not in names]
    encoding.check_features(names, stage)
    rows = filled.select("row_id", LABEL, "split", *[F.col(c).cast("double").alias(c) for c in names])
    # Fitting goes over the rows again and again: as many files as tasks can run, whatever the input's were.
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(rows.repartition(parts, "row_id")), names, medians


def prepare(df: DataFrame, stage: str, *args, **options) -> tuple[DataFrame, list[str]]:
    """Split, imputed and engineered rows, written once, and the feature names."""
    return prepare_fitted(df, stage, *args, **options)[:2]


def ready(df: DataFrame, names: list[str]) -> DataFrame:
    """Assembled vectors, balanced weights and the validation mark."""
    weighted = encoding.with_class_weight(df, LABEL)
    marked = weighted.withColumn("is_val", F.col("split") == "val")
    kept = members.assemble(marked, names)
    return kept.select("row_id", LABEL, "split", "weight", "is_val", "features")


def choose_threshold(scored: DataFrame, stage: str, score: str) -> float:
    """Stage A by target recall, stage B by the weighted mix, on the validation rows."""
    rows = scored.filter(F.col("split") == "val")
    if stage == "A":
        curve = metrics.threshold_curve(rows, score, LABEL, metrics.SCREENING_GRID)
        found = metrics.screening_threshold(curve)
    else:
        found = metrics.triage_threshold(metrics.threshold_curve(rows, score, LABEL, metrics.TRIAGE_GRID))
    row = found.first()
    return row["threshold"] if row else 0.5


def train_stage(
    df: DataFrame, stage: str, feature_set: str | None = "base", registry_path: str | None = None,
    model_path: str | None = None, version: str = "v1", channel: str = "base", dataset_hash: str | None = None,
    report_path: str | None = None, **params,
) -> tuple[Model, DataFrame]:
    """Fit boosted trees, choose the threshold, return the model and metrics per split.

    ``model_path`` gets the artefact: model, medians, feature list and threshold together.
    """
    rows, names, medians = prepare_fitted(df, stage, feature_set)
    data = ready(rows, names)
    fitting = data.filter(F.col("split") != "test")
    model = members.gbt(LABEL, "weight", "is_val", **params).fit(fitting)
    scored = materialize(members.scored(model, data).select("row_id", LABEL, "split", "probability_1"))
    threshold = choose_threshold(scored, stage, "probability_1")
    report = metrics.binary_metrics(scored, "probability_1", LABEL, threshold, ("split",))
    report = report.selectExpr(f"'{stage}' AS stage", f"{threshold!r}D AS threshold", "*")
    if model_path:
        inputs = encoding.stage_features(df, stage)
        fitted = artefacts.Fitted(stage, version, inputs, medians, feature_set, names, threshold)
        artefacts.save(df.sparkSession, model_path, model, fitted)
    if report_path:
        files.write_json(report, report_path)
    if registry_path:
        entry = report.filter(F.col("split") == "test").selectExpr(
            f"'{version}' AS model_version", "current_timestamp()::timestamp_ntz AS created_at",
            f"'{channel}' AS channel", f"nullif('{dataset_hash or ''}', '') AS dataset_hash", "stage", "roc_auc",
            "pr_auc", "threshold", f"nullif('{model_path or ''}', '') AS artifact_path", f"nullif('{report_path or ''}', '') AS report_path",
        )
        registry.append(entry, registry_path)
    return model, report


def train_version(
    df: DataFrame, registry_path: str, root: str, version: str, stages: tuple[str, ...] = ("A", "B"),
    dataset_path: str | None = None, **options,
) -> DataFrame:
    """Train the stages of one version, store artefacts and reports below ``root``, register both; metrics of all."""
    spark = df.sparkSession
    digest = files.fingerprint(spark, dataset_path).first()["sha256"] if dataset_path else None
    reports = [
        train_stage(
            df, stage, registry_path=registry_path, model_path=f"{root}/{version}/{stage}", version=version,
            dataset_hash=digest, report_path=f"{root}/{version}/report_{stage}", **options,
        )[1]
        for stage in stages
    ]
    return reduce(DataFrame.unionByName, reports)


def baselines(df: DataFrame, stage: str, forest: dict = members.BASELINE_FOREST) -> DataFrame:
    """Exact test AUC and accuracy of a forest and a scaled logistic regression on 80/20."""
    rows, names = prepare(df, stage, None, {"test": 0.20})
    scaled = encoding.scale_standard(rows, names, fit_on=rows.filter(F.col("split") == "train"))
    data = ready(scaled, names)
    train, test = data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test")
    learners = {
        "forest": members.forest(LABEL, "weight", **forest),
        "logistic": members.logistic(LABEL, "weight"),
    }
    parts = [
        members.scored(learner.fit(train), test).select(
            F.lit(name).alias("model"), F.col(LABEL), "probability_1"
        )
        for name, learner in learners.items()
    ]
    both = materialize(parts[0].unionByName(parts[1]))
    found = metrics.binary_metrics(both, "probability_1", LABEL, 0.5, ("model",))
    accuracy = (F.col("tp") + F.col("tn")) / F.col("rows")
    return found.select(F.lit(stage).alias("stage"), "model", "rows", "roc_auc", accuracy.alias("accuracy"))


def forest_importance(df: DataFrame, stage: str, **params) -> DataFrame:
    rows, names = prepare(df, stage, None, {}, fit_on="all")
    model = members.forest(LABEL, "weight", **{**members.EDA_FOREST, **params}).fit(ready(rows, names))
    return members.importance_frame(df.sparkSession, model, names)


def stage_report(df: DataFrame, stage: str, out: str | None = None, forest: dict | None = None) -> DataFrame:
    """All profiles of a stage as one nested row, written as JSON on request.

    The collected lists hold one entry per feature or model.
    """
    columns = encoding.stage_features(df, stage)

    def listed(part: DataFrame, name: str) -> DataFrame:
        return part.agg(F.collect_list(F.struct(*part.columns)).alias(name))

    def one(part: DataFrame, name: str) -> DataFrame:
        return part.select(F.struct(*part.columns).alias(name))

    parts = {
        "missing": listed(profiling.missing_analysis(df, columns), "missing"),
        "classes": one(profiling.class_distribution(df), "classes"),
        "majority": one(profiling.majority_baseline(df), "majority"),
        "statistics": listed(profiling.feature_stats(df, columns), "statistics"),
        "correlations": listed(profiling.label_correlations(df, columns), "correlations"),
        "importance": listed(forest_importance(df, stage, **(forest or {})), "importance"),
        "baselines": listed(baselines(df, stage, forest or members.BASELINE_FOREST), "baselines"),
    }
    report = df.sparkSession.range(1).select(
        F.lit(stage).alias("stage"), *[part.scalar().alias(name) for name, part in parts.items()]
    )
    if out:
        files.write_json(report, out)
    return report
