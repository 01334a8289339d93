"""Data-quality report. Every figure comes from one map-side combined aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import schema


def _null_share(column: str) -> Column:
    return F.expr(f"avg(CASE WHEN `{column}` IS NULL THEN 1D ELSE 0D END)")


def long_form(row: DataFrame, columns: list[str], name: str, value: str, keys=()) -> DataFrame:
    """Aggregated columns to (name, value) rows; the input has a row per group only."""
    ids = [F.col(k) for k in keys]
    quoted = [F.col(f"`{c}`") for c in columns]
    return row.unpivot(ids, quoted, name, value)


def quality_report(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    """One row: size, class balance, pressure parse rate, mean validity."""
    have = set(df.columns)
    zero = F.lit(0.0)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.avg(label) if label in have else zero).alias("positive_rate"),
        (F.avg("bp_parse_ok") if "bp_parse_ok" in have else zero).alias("bp_parse_ok_rate"),
        F.avg("validity_ratio").alias("avg_validity_ratio"),
    ).withColumn("column_count", F.lit(len(df.columns)).cast("bigint"))


def missing_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, missing_rate), all columns counted in a single pass."""
    columns = columns or df.columns
    row = df.agg(*[_null_share(c).alias(c) for c in columns])
    return long_form(row, columns, "column_name", "missing_rate")


def missing_top(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    rates = missing_rates(df, columns)
    return rates.orderBy(F.desc("missing_rate"), F.asc("column_name")).limit(k)


def out_of_range_counts(df: DataFrame, rules=tuple(schema.RANGE_RULES)) -> DataFrame:
    """Rows whose flag is 0, that is outside or missing, and how many rows have no value now.

    A value outside its range was taken out, so ``n_missing`` holds both kinds.
    """
    present = [c for c in rules if f"{c}_in_range" in df.columns]
    pairs = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.coalesce(F.sum(1 - F.col(f"{c}_in_range")), F.lit(0)).alias("out_of_range"),
            F.count(F.when(F.col(c).isNull(), 1)).alias("n_missing"),
        )
        for c in present
    ]
    return df.agg(F.array(*pairs).alias("counts")).select(F.inline("counts"))


def validity_histogram(
    df: DataFrame, column: str = "validity_ratio", bins: list[float] = schema.VALIDITY_BINS
) -> DataFrame:
    """Counts per [low, high) bin, empty bins kept as zero."""
    names = [f"{low:.1f}-{high:.1f}" for low, high in zip(bins, bins[1:])]
    value = F.col(column)
    row = df.agg(
        *[
            F.count(F.when((value >= low) & (value < high), 1)).alias(name)
            for name, low, high in zip(names, bins, bins[1:])
        ]
    )
    return long_form(row, names, "bin", "n")


def full_report(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    """The nested one-row report that the standardization job writes as JSON."""
    rules = [c for c in schema.RANGE_RULES if f"{c}_in_range" in df.columns]
    bins = schema.VALIDITY_BINS
    value = F.col("validity_ratio")
    rate = F.avg(label) if label in df.columns else F.lit(0.0)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(df.columns).alias("columns"),
        F.struct(rate.alias("positive_rate")).alias("class_balance"),
        F.create_map(
            *[part for c in df.columns for part in (F.lit(c), _null_share(c))]
        ).alias("missing_rate_by_column"),
        F.avg("bp_parse_ok").alias("bp_parse_ok_rate"),
        F.avg("validity_ratio").alias("avg_validity_ratio"),
        F.array(
            *[
                F.struct(
                    F.lit(f"{low:.1f}-{high:.1f}").alias("bin"),
                    F.count(F.when((value >= low) & (value < high), 1)).alias("n"),
                )
                for low, high in zip(bins, bins[1:])
            ]
        ).alias("validity_ratio_histogram_bins"),
        F.create_map(
            *[part for c in rules for part in (F.lit(c), F.sum(1 - F.col(f"{c}_in_range")))]
        ).alias("out_of_range_counts_by_column"),
        F.create_map(
            *[part for c in rules for part in (F.lit(c), F.count(F.when(F.col(c).isNull(), 1)))]
        ).alias("missing_counts_by_column"),
    )
