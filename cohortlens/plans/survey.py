"""The survey that the driver tables stand for, derived row by row from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.operators.standardize import standardize

# Integer arithmetic only, so that the same text gives the same rows in any SQL engine.
RAW_SURVEY_SQL = """
SELECT
  o_orderkey AS row_id,
  CASE WHEN (o_orderkey * 7 + o_custkey * 3) % 23 = 0 THEN NULL ELSE 15 + (o_orderkey * 7 + o_custkey * 3) % 34 END AS age,
  CASE (o_orderkey + o_custkey) % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'm' WHEN 2 THEN 'f' WHEN 3 THEN 'M' ELSE 'F' END AS gender,
  110 + (o_orderkey * 13 + o_custkey) % 125 AS height,
  25 + (o_orderkey * 17 + o_custkey * 5) % 110 AS weight,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST((o_orderkey * 11 + o_custkey) % 131 AS DOUBLE) / 10.0 END AS sleep_duration,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE (o_orderkey * 3 + o_custkey) % 7 END AS sleep_quality,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST((o_orderkey * 5 + o_custkey * 2) % 261 AS DOUBLE) / 10.0 END AS average_screen_time,
  (o_orderkey + o_custkey * 7) % 6 AS stress_level,
  35 + (o_orderkey * 19 + o_custkey) % 90 AS heart_rate,
  (o_orderkey * 101 + o_custkey * 37) % 21000 AS daily_steps,
  (o_orderkey * 23 + o_custkey) % 181 AS physical_activity,
  CASE o_orderkey % 6
    WHEN 0 THEN CONCAT(CAST(90 + o_custkey % 60 AS STRING), '/', CAST(55 + o_orderkey % 45 AS STRING))
    WHEN 1 THEN CONCAT(CAST(90 + o_custkey % 60 AS STRING), ' / ', CAST(55 + o_orderkey % 45 AS STRING))
    WHEN 2 THEN CONCAT(CAST(90 + o_custkey % 60 AS STRING), '-', CAST(55 + o_orderkey % 45 AS STRING))
    WHEN 3 THEN 'invalid'
    WHEN 4 THEN NULL
    ELSE '300/200' END AS blood_pressure,
  CASE (o_orderkey * 3 + o_custkey) % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'n' WHEN 2 THEN 'Yes' WHEN 3 THEN 'N' ELSE '?' END AS smoking,
  CASE WHEN (o_orderkey * 3 + o_custkey * 5) % 13 < 5 THEN 'Y' ELSE 'N' END AS sleep_disorder,
  CASE WHEN (o_orderkey * 7 + o_custkey * 2) % 12 < 6 THEN 'Y' ELSE 'N' END AS wake_up_during_night,
  CASE WHEN (o_orderkey * 11 + o_custkey * 3) % 14 < 7 THEN 'Y' ELSE 'N' END AS feel_sleepy_during_day,
  CASE WHEN (o_orderkey + o_custkey * 9) % 8 < 5 THEN 'Y' ELSE 'N' END AS caffeine_consumption,
  CASE WHEN (o_orderkey * 13 + o_custkey * 4) % 10 < 3 THEN 'Y' ELSE 'N' END AS alcohol_consumption,
  CASE WHEN (o_orderkey * 17 + o_custkey) % 16 < 5 THEN 'true' ELSE 'false' END AS medical_issue,
  CASE WHEN (o_orderkey * 19 + o_custkey * 6) % 15 < 5 THEN 'Y' ELSE 'N' END AS ongoing_medication,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN (o_orderkey * 23 + o_custkey * 7) % 9 < 6 THEN 'Y' ELSE 'N' END AS smart_device_before_bed,
  CASE WHEN (o_orderkey * 29 + o_custkey * 8) % 7 < 3 THEN 'Y' ELSE 'N' END AS blue_light_filter,
  CASE WHEN (o_orderkey * 5 + o_custkey * 11) % 9 < 4 THEN 'Y' ELSE 'N' END AS discomfort_eye_strain,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN (o_orderkey * 7 + o_custkey * 13) % 10 < 3 THEN 'Y' ELSE 'N' END AS redness_in_eye,
  CASE WHEN (o_orderkey * 2 + o_custkey * 17) % 11 < 4 THEN 'Y' ELSE 'N' END AS itchiness_irritation_in_eye,
  CASE WHEN o_orderkey % 211 = 0 THEN NULL
       WHEN (CASE WHEN (o_orderkey * 5 + o_custkey * 11) % 9 < 4 THEN 15 ELSE 0 END
           + CASE WHEN (o_orderkey * 2 + o_custkey * 17) % 11 < 4 THEN 10 ELSE 0 END
           + (o_orderkey * 31 + o_custkey * 41) % 100) >= 45 THEN 'Y' ELSE 'N' END AS dry_eye_disease
FROM orders
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = RAW_SURVEY_SQL.replace("FROM orders", "FROM {orders}")
    return spark.sql(text, orders=table(spark, sf_dir, "orders"))


def survey(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return standardize(raw_survey(spark, sf_dir), **options)
