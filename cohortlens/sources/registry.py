"""Model registry: appended rows and a view of the latest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import schema

REGISTRY_SCHEMA = (
    "model_version string, created_at timestamp_ntz, channel string, dataset_hash string, "
    "stage string, roc_auc double, pr_auc double, threshold double, "
    "artifact_path string, report_path string"
)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path)


def latest(
    entries: DataFrame,
    by: str = "created_at",
    channel: str = "channel",
    preferred: tuple[str, str] = ("improved", "base"),
    fallback: str = schema.FALLBACK_VERSION,
    version: str = "model_version",
    stage: str = "stage",
) -> DataFrame:
    """The newest version of the preferred channel, else of the other, with a row for each of its stages.

    Without any entry: one row with the fallback version and no stage. Only one candidate per channel leaves
    a task, however long the registry is; the stages then come from that version's entries.
    """
    newest = [F.max(F.when(F.col(channel) == name, F.struct(by, version))).alias(name) for name in preferred]
    picks = [F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("c"), F.col(f"{name}.{version}").alias("v"))) for name in preferred]
    pick = entries.agg(*newest).select(F.coalesce(*picks).alias("pick"))  # one row
    fields = [c for c in entries.columns if c not in (channel, version, stage)]
    parts = entries.groupBy(channel, version, stage) if stage in entries.columns else entries.groupBy(channel, version)
    stages = parts.agg(F.max_by(F.struct(*fields), F.col(by)).alias("entry"))
    same = (stages[channel] == F.col("pick.c")) & (stages[version] == F.col("pick.v"))
    found = stages.join(F.broadcast(pick), same, "right")
    named = [F.col(stage)] if stage in entries.columns else []
    return found.select(
        F.coalesce("pick.v", F.lit(fallback)).alias(version),
        *named,
        *[F.col(f"entry.{c}").alias(c) for c in fields],
        F.when(F.col("pick").isNull(), "fallback").otherwise("loaded").alias("status"),
    )
