"""Frames of metrics: overfitting checks, best checkpoints, model comparison.

Metric frames hold a row per run and split, not per record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["roc_auc", "pr_auc", "precision", "recall", "f1"]
REPORTED = [*METRICS, "threshold", "tn", "fp", "fn", "tp"]


def overfit_check(
    metrics: DataFrame, keys: list[str], max_gap: float = 0.20, min_test: float = 0.50,
    bands: tuple[float, float] = (0.10, 0.15),
) -> DataFrame:
    """Validation minus test AUC, whether to stop and why, and the train-test gap band."""
    def auc(split: str):
        return F.max(F.when(F.col("split") == split, F.col("roc_auc")))

    wide = metrics.groupBy(*keys).agg(
        auc("train").alias("train_auc"), auc("val").alias("val_auc"), auc("test").alias("test_auc")
    )
    gap = F.col("val_auc") - F.col("test_auc")
    low = F.col("test_auc") < min_test
    train_gap = F.col("train_auc") - F.col("test_auc")
    return wide.select(
        *keys,
        "train_auc",
        "val_auc",
        "test_auc",
        gap.alias("gap"),
        (gap > max_gap).alias("overfitting"),
        F.when(gap > max_gap, "gap").when(low, "low_test").alias("stop_reason"),
        F.when(train_gap < bands[0], "low").when(train_gap < bands[1], "medium").otherwise("high").alias(
            "train_gap_band"
        ),
    )


def best_checkpoint(runs: DataFrame, keys: list[str], order: str, metric: str = "roc_auc") -> DataFrame:
    """Runs that beat every earlier run of their key (starting from 0)."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.coalesce(F.max(metric).over(before), F.lit(0.0)), F.lit(0.0))
    return runs.withColumn("best_before", best).filter(F.col(metric) > F.col("best_before"))


def model_comparison(
    base: DataFrame, improved: DataFrame, keys: list[str], metrics: list[str] = METRICS
) -> DataFrame:
    """(keys, metric, base, improved, diff, diff_pct, arrow); metrics NULL in either are left out."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *metrics).unpivot(keys, metrics, "metric", name)

    both = long(base, "base").join(long(improved, "improved"), [*keys, "metric"])
    diff = F.col("improved") - F.col("base")
    share = F.when(F.col("base") > 0, diff / F.col("base") * 100).otherwise(0.0)
    arrow = F.when(diff > 0, "up").when(diff < 0, "down").otherwise("same")
    known = both.filter(F.col("base").isNotNull() & F.col("improved").isNotNull())
    return known.withColumns({"diff": diff, "diff_pct": share, "arrow": arrow})


def comparison_report(base: DataFrame, improved: DataFrame, keys: list[str]) -> DataFrame:
    """``model_comparison`` with the thresholds and the confusion counts at them, all as doubles, per stage and split."""
    def doubles(df: DataFrame) -> DataFrame:
        return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in REPORTED])

    return model_comparison(doubles(base), doubles(improved), keys, REPORTED)


def improvement_summary(compared: DataFrame) -> DataFrame:
    usable = compared.filter(F.col("base") > 0)
    return usable.agg(
        F.avg("diff_pct").alias("avg_improvement"),
        F.count(F.when(F.col("diff_pct") > 0, 1)).alias("improved"),
        F.count(F.lit(1)).alias("compared"),
    )
