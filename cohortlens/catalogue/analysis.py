"""Profiles, features, splits, evaluation and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import schema
from cohortlens.functions.features import add_features, feature_names
from cohortlens.functions.project import with_exprs
from cohortlens.operators import comparison, encoding, information, metrics, monitoring, neighbours, profiling
from cohortlens.operators import quality, resampling, scoring, splitting
from cohortlens.plans.assess_job import FEATURE_TO_REQUEST
from cohortlens.plans.survey import raw_survey, survey, table
from cohortlens.sources import files, registry

LABEL = schema.LABEL
NUMERIC = [
    "age", "bmi", "sleep_duration", "sleep_quality", "average_screen_time", "stress_level",
    "heart_rate", "daily_steps", "physical_activity", "systolic", "diastolic",
]


def rounded(df, places: int = 6, skip: tuple = ()):
    """Round double columns; adding 0 turns a negative zero into zero."""
    doubles = [c for c, t in df.dtypes if t == "double" and c not in skip]
    return with_exprs(df, {c: f"round(`{c}`, {places}) + 0D" for c in doubles})


def feature_stats(spark, sf_dir):
    return rounded(profiling.feature_stats(survey(spark, sf_dir), NUMERIC))


def feature_stats_lineitem(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(profiling.feature_stats(table(spark, sf_dir, "lineitem"), columns), 4)


def label_correlations(spark, sf_dir):
    return rounded(profiling.label_correlations(survey(spark, sf_dir), schema.STAGE_B_FEATURES))


def correlation_top(spark, sf_dir):
    columns = [*schema.STAGE_B_FEATURES, "symptom_score", "validity_ratio"]
    return rounded(profiling.correlation_top(survey(spark, sf_dir), columns))


def correlation_lineitem(spark, sf_dir):
    lines = with_exprs(table(spark, sf_dir, "lineitem"), {"one": "1"})
    columns = ["l_quantity", "l_extendedprice", "l_tax", "one"]
    return rounded(profiling.correlation_row(lines, columns, "l_discount"))


def leak_alarm(spark, sf_dir):
    return rounded(profiling.leak_alarm(survey(spark, sf_dir), ["symptom_score", *schema.SYMPTOMS]))


def column_profile(spark, sf_dir):
    data = survey(spark, sf_dir).select(*NUMERIC, "gender", "age_band", "blood_pressure_raw", LABEL)
    return profiling.column_profile(data)


def categorical_top5(spark, sf_dir):
    columns = ["gender", "smoking", "blood_pressure", "medical_issue", "redness_in_eye"]
    return profiling.categorical_top(raw_survey(spark, sf_dir), columns)


def categorical_top5_part(spark, sf_dir):
    return profiling.categorical_top(table(spark, sf_dir, "part"))


def factorize(spark, sf_dir):
    columns = ["gender", "smoking", "redness_in_eye", "blood_pressure"]
    raw = raw_survey(spark, sf_dir).select("row_id", *columns)
    return encoding.factorize(raw, columns, "row_id")


def mutual_info_binned(spark, sf_dir):
    columns = [*NUMERIC, *schema.SYMPTOMS, "symptom_score"]
    return rounded(profiling.mutual_information(survey(spark, sf_dir), columns))


def mutual_info_nearest(spark, sf_dir):
    columns = ["age", "sleep_duration", "sleep_quality", "average_screen_time", "stress_level", "heart_rate", "daily_steps", "symptom_score"]
    return rounded(information.nearest_information(survey(spark, sf_dir), columns))


def label_conflicts(spark, sf_dir):
    keys = ["age_band", "gender", "stress_level", "sleep_quality", "symptom_score", "smoking"]
    return profiling.label_conflicts(survey(spark, sf_dir), keys)


def _features(name, digits=()):
    def query(spark, sf_dir):
        data = survey(spark, sf_dir)
        out = add_features(data, name).select("row_id", *feature_names(data, name))
        return with_exprs(out, {c: f"round(`{c}`, 6)" for c in out.columns if c.endswith(digits)}) if digits else out

    return query


def target_encode(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(
        table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id"
    )
    encoded = encoding.target_encode(joined, "source", "toxic")
    return rounded(encoded.select("doc_id", "source", "source_encoded"))


def target_encode_lineitem(spark, sf_dir):
    deep = F.when(F.col("l_discount") > 0.05, 1).otherwise(0)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", deep.alias("deep"))
    # A low limit makes the key table go through the salted join.
    encoded = encoding.target_encode(lines, "l_partkey", "deep", broadcast_rows=100)
    return rounded(encoded.select("l_orderkey", "l_linenumber", "l_partkey", "l_partkey_encoded"))


def model_matrix(spark, sf_dir):
    raw = raw_survey(spark, sf_dir)
    coded = with_exprs(raw, {LABEL: "CASE upper(dry_eye_disease) WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END"})
    wanted = ["age", "sleep_duration", "smoking", "medical_issue", "redness_in_eye", "blood_pressure"]
    return encoding.model_matrix(coded, wanted)


def median_impute(spark, sf_dir):
    matrix = encoding.model_matrix(survey(spark, sf_dir), schema.STAGE_A_FEATURES)
    return encoding.median_impute(matrix, schema.STAGE_A_FEATURES)


def mode_impute(spark, sf_dir):
    columns = ["smoking", "smart_device_before_bed", "redness_in_eye"]
    return encoding.mode_impute(survey(spark, sf_dir).select("row_id", *columns), columns)


def scale_standard(spark, sf_dir):
    data = survey(spark, sf_dir).select("row_id", *NUMERIC)
    return rounded(encoding.scale_standard(data, NUMERIC))


def scale_robust(spark, sf_dir):
    data = survey(spark, sf_dir).select("row_id", *NUMERIC)
    return rounded(encoding.scale_robust(data, NUMERIC))


def knn_impute(spark, sf_dir):
    columns = [
        "age", "sleep_duration", "sleep_quality", "average_screen_time", "stress_level", "heart_rate",
        "daily_steps", "physical_activity",
    ]
    data = survey(spark, sf_dir).select("row_id", *columns)
    return rounded(neighbours.knn_impute(data, "row_id", columns))


def _training_rows(spark, sf_dir):
    columns = ["age", "bmi", "sleep_duration", "average_screen_time", "stress_level", "daily_steps"]
    data = survey(spark, sf_dir).select("row_id", LABEL, *columns)
    split = splitting.stratified_split(data, "row_id", LABEL)
    train = split.filter(F.col("split") == "train").drop("split")
    return encoding.median_impute(train, columns), columns


def smote(spark, sf_dir):
    rows, columns = _training_rows(spark, sf_dir)
    return rounded(resampling.smote(rows, "row_id", columns, strategy=resampling.STRATEGIES["aggressive"]))


def tomek_links(spark, sf_dir):
    rows, columns = _training_rows(spark, sf_dir)
    return resampling.tomek_links(rows, "row_id", columns)


def anova_topk(spark, sf_dir):
    columns = [*schema.STAGE_B_FEATURES, "symptom_score"]
    return rounded(encoding.anova_topk(survey(spark, sf_dir), columns), 4)


def _labelled(spark, sf_dir):
    """Labelled survey rows with the two rule scores as probabilities and a split."""
    renamed = survey(spark, sf_dir).withColumnsRenamed(FEATURE_TO_REQUEST)
    scored = scoring.rule_scores(renamed).filter(F.col(LABEL).isNotNull())
    return scored.selectExpr(
        "row_id", f"{LABEL} AS y", "score_a / 100D AS prob_a", "score_b / 100D AS prob_b",
        "age_band", "gender",
    )


def _split(spark, sf_dir):
    return splitting.stratified_split(_labelled(spark, sf_dir), "row_id", "y")


def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("row_id", "y", "split")


def split_report(spark, sf_dir):
    return splitting.split_report(_split(spark, sf_dir), "y")


def stratified_folds(spark, sf_dir):
    return splitting.folds(_labelled(spark, sf_dir), "row_id", "y").select("row_id", "y", "fold")


def fold_sizes(spark, sf_dir):
    """Folds of the labelled documents, three per quality."""
    return splitting.fold_report(splitting.folds(_documents(spark, sf_dir), "doc_id", "quality", 3), "quality")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag", "l_extendedprice / (l_extendedprice + 50000D) AS score", "int(l_discount > 0.05D) AS deep"
    )


def binary_metrics_documents(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(
        table(spark, sf_dir, "labels"), "doc_id"
    )
    scored = with_exprs(joined, {"score": "n_chars / (n_chars + 2000D)"})
    return rounded(metrics.binary_metrics(scored, "score", "quality", 0.5, ("lang",)))


def _documents(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(
        table(spark, sf_dir, "labels"), "doc_id"
    )
    return with_exprs(joined, {"score": "n_chars / (n_chars + 2000D)"})


def split_documents(spark, sf_dir):
    split = splitting.stratified_split(
        _documents(spark, sf_dir), "doc_id", "toxic", splitting.SHARES["70/15/15"]
    )
    return split.select("doc_id", "toxic", "split")


def _curve(grid, score="prob_b"):
    return lambda s, d: metrics.threshold_curve(_labelled(s, d), score, "y", grid)


def threshold_curve(spark, sf_dir):
    return rounded(_curve(metrics.F1_GRID)(spark, sf_dir))


def _chosen(pick, grid, score="prob_b"):
    return lambda s, d: rounded(pick(_curve(grid, score)(s, d)))


def _by_split(spark, sf_dir, score):
    return metrics.binary_metrics(_split(spark, sf_dir), score, "y", 0.5, ("split",))


def overfit_check(spark, sf_dir):
    both = _by_split(spark, sf_dir, "prob_a").withColumn("stage", F.lit("A")).unionByName(
        _by_split(spark, sf_dir, "prob_b").withColumn("stage", F.lit("B"))
    )
    return rounded(comparison.overfit_check(both, ["stage"]))


def _long_scores(spark, sf_dir):
    """One run per candidate score, numbered."""
    candidates = "stack(3, 1, prob_a, 2, prob_b, 3, (prob_a + prob_b) / 2D) AS (iteration, score)"
    return _labelled(spark, sf_dir).selectExpr("y", candidates)


def best_checkpoint(spark, sf_dir):
    runs = metrics.binary_metrics(_long_scores(spark, sf_dir), "score", "y", 0.5, ("iteration",))
    staged = runs.select(F.lit("B").alias("stage"), "iteration", "roc_auc")
    return rounded(comparison.best_checkpoint(staged, ["stage"], "iteration"))


def model_comparison(spark, sf_dir):
    base, better = (_by_split(spark, sf_dir, c) for c in ("prob_a", "prob_b"))
    return rounded(comparison.model_comparison(base, better, ["split"]))


def comparison_report(spark, sf_dir):
    """Rule score of stage A at 0.5 against that of stage B at 0.3, with thresholds and confusion counts."""
    split = _split(spark, sf_dir)
    base, better = (
        metrics.binary_metrics(split, score, "y", cut, ("split",)).withColumns({"threshold": F.lit(cut), "stage": F.lit("A/B")})
        for score, cut in (("prob_a", 0.5), ("prob_b", 0.3))
    )
    return rounded(comparison.comparison_report(base, better, ["stage", "split"]))


def comparison_summary(spark, sf_dir):
    base, better = (_by_split(spark, sf_dir, c) for c in ("prob_a", "prob_b"))
    return rounded(comparison.improvement_summary(comparison.model_comparison(base, better, ["split"])), 4)


def subgroup_metrics(spark, sf_dir):
    return rounded(
        metrics.binary_metrics(_labelled(spark, sf_dir), "prob_b", "y", 0.5, ("age_band", "gender"))
    )


def quality_alerts(spark, sf_dir):
    found = quality.missing_rates(survey(spark, sf_dir))
    limits = {"systolic": 0.3, "diastolic": 0.6, "age": 0.2, "bmi": 0.25, LABEL: 0.001}
    return monitoring.quality_alerts(found, limits)


def _half(spark, sf_dir):
    half = "CASE WHEN ts < TIMESTAMP_NTZ'2024-01-16 00:00:00' THEN 'base' ELSE 'current' END"
    return with_exprs(table(spark, sf_dir, "events"), {"snapshot": half, "props_k": "double(get_json_object(props, '$.k'))"})


def drift_psi(spark, sf_dir):
    return rounded(monitoring.drift(_half(spark, sf_dir), "snapshot", ["value", "user_id", "props_k"]))


def drift_types(spark, sf_dir):
    named = _half(spark, sf_dir).withColumn("feature", F.lit("event_type"))
    return rounded(monitoring.psi(named, "snapshot", "event_type", ["feature"]))


def monitor_monthly(spark, sf_dir):
    return rounded(monitoring.by_month(table(spark, sf_dir, "events"), "ts", "value", ["event_type"], 20.0))


def registry_latest(spark, sf_dir):
    """Two registry entries, one per stage, for each order priority and month, then the latest version."""
    month = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM")
    entries = table(spark, sf_dir, "orders").groupBy("o_orderpriority", month.alias("month")).agg(
        F.max("o_orderdate").alias("created_at"),
        F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 6).alias("roc_auc"),
    )
    rows = entries.selectExpr(
        "concat(o_orderpriority, '/', month) AS model_version",
        "created_at",
        "CASE WHEN o_orderpriority < '3' THEN 'improved' ELSE 'base' END AS channel",
        "sha2(o_orderpriority, 256) AS dataset_hash",
        "explode(array('A', 'B')) AS stage",
        "roc_auc",
        "CAST(NULL AS DOUBLE) AS pr_auc",
        "0.5D AS threshold",
        "CAST(NULL AS STRING) AS artifact_path",
        "CAST(NULL AS STRING) AS report_path",
    )
    out = files.new_folder(spark, "registry")
    registry.append(rows, out)
    latest = registry.latest(registry.read(spark, out))
    return latest.select("model_version", "created_at", "dataset_hash", "stage", "roc_auc", "threshold", "status")


QUERIES = {
    "missing_analysis": lambda s, d: profiling.missing_analysis(survey(s, d), schema.STAGE_B_FEATURES),
    "class_distribution": lambda s, d: profiling.class_distribution(survey(s, d)),
    "majority_baseline": lambda s, d: profiling.majority_baseline(survey(s, d)),
    "feature_stats": feature_stats,
    "feature_stats_lineitem": feature_stats_lineitem,
    "label_correlations": label_correlations,
    "correlation_top": correlation_top,
    "correlation_lineitem": correlation_lineitem,
    "leak_alarm": leak_alarm,
    "column_profile": column_profile,
    "categorical_top5": categorical_top5,
    "categorical_top5_part": categorical_top5_part,
    "factorize": factorize,
    "mutual_info_binned": mutual_info_binned,
    "mutual_info_nearest": mutual_info_nearest,
    "label_conflicts": label_conflicts,
    "features_base": _features("base"),
    "features_medical": _features("medical", ("activity_composite",)),
    "features_safe": _features("safe"),
    "features_quick": _features("quick"),
    "features_wide": _features("wide", ("_log", "_std")),
    "target_encode": target_encode,
    "target_encode_lineitem": target_encode_lineitem,
    "model_matrix": model_matrix,
    "median_impute": median_impute,
    "mode_impute": mode_impute,
    "knn_impute": knn_impute,
    "smote": smote,
    "tomek_links": tomek_links,
    "scale_standard": scale_standard,
    "scale_robust": scale_robust,
    "anova_topk": anova_topk,
    "class_weights": lambda s, d: encoding.class_weights(survey(s, d)),
    "stratified_split": stratified_split,
    "split_report": split_report,
    "stratified_folds": stratified_folds,
    "fold_sizes": fold_sizes,
    "binary_metrics": lambda s, d: rounded(metrics.binary_metrics(_labelled(s, d), "prob_b", "y", 0.5)),
    "binary_metrics_lineitem": lambda s, d: rounded(
        metrics.binary_metrics(_lines(s, d), "score", "deep", 0.4, ("l_returnflag",))
    ),
    "binary_metrics_documents": binary_metrics_documents,
    "confusion_matrix": lambda s, d: metrics.confusion_matrix(_labelled(s, d), "prob_b", "y", 0.6, ("gender",)),
    "threshold_curve": threshold_curve,
    "threshold_recall": _chosen(metrics.max_recall, metrics.RECALL_GRID),
    "threshold_f1": _chosen(metrics.max_f1, metrics.F1_GRID),
    "threshold_f1_narrow": _chosen(metrics.max_f1, metrics.NARROW_F1_GRID),
    "threshold_screening": _chosen(metrics.screening_threshold, metrics.SCREENING_GRID, "prob_a"),
    "threshold_triage": _chosen(metrics.triage_threshold, metrics.TRIAGE_GRID),
    "threshold_youden": lambda s, d: rounded(metrics.youden_threshold(_labelled(s, d), "prob_b", "y")),
    "threshold_youden_lineitem": lambda s, d: rounded(metrics.youden_threshold(_lines(s, d), "score", "deep")),
    "calibration_documents": lambda s, d: rounded(
        metrics.calibration_bins(_documents(s, d), "score", "quality", keys=("source",))
    ),
    "class_weights_documents": lambda s, d: encoding.class_weights(_documents(s, d), "toxic"),
    "split_documents": split_documents,
    "overfit_check": overfit_check,
    "best_checkpoint": best_checkpoint,
    "model_comparison": model_comparison,
    "comparison_report": comparison_report,
    "stage_features": lambda s, d: encoding.feature_report(survey(s, d)),
    "comparison_summary": comparison_summary,
    "subgroup_metrics": subgroup_metrics,
    "calibration_bins": lambda s, d: rounded(metrics.calibration_bins(_labelled(s, d), "prob_b", "y")),
    "quality_alerts": quality_alerts,
    "drift_psi": drift_psi,
    "drift_types": drift_types,
    "monitor_monthly": monitor_monthly,
    "registry_latest": registry_latest,
    "dataset_content": lambda s, d: files.content_fingerprint(
        table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    ),
    "dataset_hash": lambda s, d: files.fingerprint(s, d, "orders.parquet"),
}
