"""Grouped positive rates and the KPI batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import schema


def _known(dims: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in dims])


def with_rate(cells: DataFrame) -> DataFrame:
    return cells.withColumn("rate", F.col("positives") / F.col("n"))


def rate_by(df: DataFrame, dims: list[str], label: str = schema.LABEL) -> DataFrame:
    """n, positives and rate per cell; NULL labels count as negative, NULL dims are left out."""
    cells = df.filter(_known(dims)).groupBy(*dims)
    counted = cells.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.col(label), F.lit(0))).cast("bigint").alias("positives"),
    )
    return with_rate(counted).orderBy(*dims)


def quality_by(df: DataFrame, dims: list[str]) -> DataFrame:
    def share(test: Column) -> Column:
        return F.avg(F.when(test, 1.0).otherwise(0.0))

    unparsed = F.coalesce(F.col("bp_parse_ok"), F.lit(0)) == 0
    return (
        df.filter(_known(dims))
        .groupBy(*dims)
        .agg(
            F.count(F.lit(1)).alias("n"),
            share(F.col("average_screen_time").isNull()).alias("missing_rate_screen_time"),
            share(F.col("sleep_quality").isNull()).alias("missing_rate_sleep_quality"),
            share(unparsed).alias("missing_rate_bp"),
            F.avg(F.coalesce(F.col("validity_ratio"), F.lit(0.0))).alias("avg_validity_ratio"),
        )
        .orderBy(*dims)
    )


def base_cells(df: DataFrame, dims: list[str], label: str = schema.LABEL) -> DataFrame:
    """Additive measures per combination of all KPI dimensions.

    The dimensions are banded, so the number of combinations has a fixed bound; one
    scan of the survey feeds every KPI, which then only re-adds these cells.
    """
    return df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.col(label), F.lit(0))).cast("bigint").alias("positives"),
        F.count(F.when(F.col("average_screen_time").isNull(), 1)).alias("no_screen_time"),
        F.count(F.when(F.col("sleep_quality").isNull(), 1)).alias("no_sleep_quality"),
        F.count(F.when(F.coalesce(F.col("bp_parse_ok"), F.lit(0)) == 0, 1)).alias("no_bp"),
        F.sum(F.coalesce(F.col("validity_ratio"), F.lit(0.0))).alias("validity_sum"),
    )


def kpi_cells(
    df: DataFrame,
    kpis: dict[str, list[str]] = schema.KPI_DIMENSIONS,
    label: str = schema.LABEL,
) -> DataFrame:
    """All KPI cells in long form: ``kpi``, every dimension (NULL where unused), measures."""
    sets = list(dict.fromkeys(tuple(d) for d in kpis.values()))
    dims = list(dict.fromkeys(d for s in sets for d in s))
    measures = ["n", "positives", "no_screen_time", "no_sleep_quality", "no_bp"]
    sums = [F.sum(m).cast("bigint").alias(m) for m in measures]
    sums.append(F.sum("validity_sum").alias("validity_sum"))
    grouped = (
        base_cells(df, dims, label)
        .groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims])
        .agg(F.grouping_id().alias("set_id"), *sums)
    )

    def set_id(used: tuple) -> int:
        return int("".join("0" if d in used else "1" for d in dims), 2)

    named = F.lit(None).cast("array<string>")
    for used in sets:
        names = [k for k, d in kpis.items() if tuple(d) == used]
        hit = (F.col("set_id") == set_id(used)) & _known(list(used))
        named = F.when(hit, F.array(*[F.lit(k) for k in names])).otherwise(named)
    long = grouped.withColumn("kpi", F.explode(named)).drop("set_id")
    return with_rate(long).select("kpi", *dims, *measures, "validity_sum", "rate")


def kpi_table(cells: DataFrame, name: str) -> DataFrame:
    """One KPI in its published shape and order from the long-form cells, as one partition."""
    if name not in schema.KPI_DIMENSIONS:
        raise KeyError(f"unknown KPI {name!r}; known: {sorted(schema.KPI_DIMENSIONS)}")
    dims = schema.KPI_DIMENSIONS[name]
    own = cells.filter(F.col("kpi") == name)
    if name == "data_quality_group":
        own = own.select(
            *dims,
            "n",
            (F.col("no_screen_time") / F.col("n")).alias("missing_rate_screen_time"),
            (F.col("no_sleep_quality") / F.col("n")).alias("missing_rate_sleep_quality"),
            (F.col("no_bp") / F.col("n")).alias("missing_rate_bp"),
            (F.col("validity_sum") / F.col("n")).alias("avg_validity_ratio"),
        )
    else:
        own = own.select(*dims, "n", "positives", "rate")
    return own.coalesce(1).sortWithinPartitions(*dims)


def kpi_snapshot(
    cells: DataFrame,
    kpis: dict[str, list[str]] = schema.KPI_DIMENSIONS,
    without_label: tuple[str, ...] = ("data_quality_group",),
    low_n: int = schema.LOW_N,
) -> DataFrame:
    """Per KPI: cells, totals, rate, smallest and largest cell. An empty KPI gives zeros."""
    counted = F.when(F.col("kpi").isin(*without_label), 0).otherwise(F.col("positives"))
    found = cells.groupBy("kpi").agg(
        F.count(F.lit(1)).alias("num_cells"),
        F.sum("n").alias("total_n"),
        F.sum(counted).alias("total_positives"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
    )
    rows = ", ".join(f"('{k}')" for k in kpis)
    names = cells.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS listed(kpi)")
    zero = F.lit(0).cast("bigint")
    filled = names.join(found, "kpi", "left").select(
        "kpi",
        *[
            F.coalesce(F.col(c), zero).alias(c)
            for c in ("num_cells", "total_n", "total_positives", "min_n", "max_n")
        ],
    )
    return filled.withColumn(
        "overall_rate", F.try_divide(F.col("total_positives"), F.col("total_n"))
    ).withColumn("has_low_n_cells", F.col("min_n") < low_n)


def flag_low_n(cells: DataFrame, low_n: int = schema.LOW_N) -> DataFrame:
    return cells.withColumn("low_n", F.col("n") < low_n)
