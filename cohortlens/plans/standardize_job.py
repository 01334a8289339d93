"""Standardization job: raw CSV to the standardized table and its quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.operators.quality import full_report
from cohortlens.operators.standardize import standardize
from cohortlens.sources import files


def run(spark: SparkSession, source: str, out: str, **options) -> DataFrame:
    """Write ``clean_assessments`` and ``data_quality_report`` below ``out``.

    Two actions: the write, and a one-pass report over what was written.
    """
    table = f"{out}/clean_assessments"
    files.write_parquet(standardize(files.read_csv(spark, source), **options), table)
    stored = files.read_parquet(spark, table)
    files.write_json(full_report(stored).coalesce(1), f"{out}/data_quality_report")
    return stored
