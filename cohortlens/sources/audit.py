"""Append-only audit log as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AUDIT_SCHEMA = (
    "request_id string, timestamp timestamp_ntz, mode_used string, model_version string, "
    "risk_score double, risk_level string, confidence string, missing_fields_count int, "
    "trigger_symptom boolean, triage_level string"
)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)
