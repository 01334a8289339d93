"""KPI batch: one scan of the survey, five small tables, one snapshot."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import schema
from cohortlens.operators import rates
from cohortlens.session import materialize
from cohortlens.sources import files


def write_kpis(df: DataFrame, out: str, csv: bool = False) -> DataFrame:
    """Write every KPI below ``out`` and return the snapshot.

    The long-form cells are written once and re-read for the five tables, so neither the
    survey is scanned nor a KPI computed twice. The cells number a few hundred at most:
    one file per KPI.
    """
    cells = materialize(rates.kpi_cells(df))
    for name, stored in schema.KPI_TABLES.items():
        own = rates.kpi_table(cells, name)
        files.write_parquet(own, f"{out}/{stored}")
        if csv:
            files.write_csv(own, f"{out}/{stored}_csv")
    snapshot = rates.kpi_snapshot(cells)
    files.write_json(snapshot.coalesce(1), f"{out}/snapshot")
    return snapshot


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return files.read_parquet(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def kpi_catalogue(spark: SparkSession, out: str) -> DataFrame:
    """name, table, available, row_count for every published KPI."""
    parts = []
    for name, stored in schema.KPI_TABLES.items():
        found = _stored(spark, f"{out}/{stored}")
        here = found is not None
        if here:
            part = found.agg(F.count(F.lit(1)).alias("row_count"))
        else:
            part = spark.range(1).select(F.lit(None).cast("bigint").alias("row_count"))
        parts.append(
            part.select(
                F.lit(name).alias("name"),
                F.lit(stored).alias("table"),
                F.lit(here).alias("available"),
                "row_count",
            )
        )
    out_df = parts[0]
    for part in parts[1:]:
        out_df = out_df.unionByName(part)
    return out_df


def read_kpi(spark: SparkSession, out: str, name: str) -> DataFrame:
    if name not in schema.KPI_TABLES:
        raise KeyError(f"unknown KPI {name!r}; known: {sorted(schema.KPI_TABLES)}")
    found = _stored(spark, f"{out}/{schema.KPI_TABLES[name]}")
    if found is None:
        raise FileNotFoundError(f"KPI {name!r} has not been built at {out}")
    return found
