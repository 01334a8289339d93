"""Monitoring tables: prevalence, missing flags, alerts, drift, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schema
from cohortlens.operators.ranking import quantile_bin, running_totals
from cohortlens.operators.rates import with_rate


def single_dimension_rates(
    df: DataFrame, dims: list[str], label: str = schema.LABEL
) -> DataFrame:
    """(dimension, value, n, positives, rate) for several dimensions from one scan.

    Rows are first combined over all dimensions together, so only cells are unpivoted.
    """
    cells = df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(F.col(label), F.lit(0))).cast("bigint").alias("positives"),
    )
    text = cells.select(*[F.col(d).cast("string").alias(d) for d in dims], "n", "positives")
    long = text.unpivot(["n", "positives"], dims, "dimension", "value")
    summed = (
        long.filter(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    )
    return with_rate(summed)


def symptom_prevalence(
    df: DataFrame, symptoms: list[str] = schema.SYMPTOMS, label: str = schema.LABEL
) -> DataFrame:
    shares = df.filter(F.col(label).isNotNull()).groupBy(label)
    means = shares.agg(*[F.avg(c).alias(c) for c in symptoms])
    return means.unpivot([label], symptoms, "symptom", "prevalence")


def missing_indicators(df: DataFrame, key: str = "row_id") -> DataFrame:
    def flag(*columns: str):
        test = F.lit(False)
        for c in columns:
            test = test | F.col(c).isNull()
        return test.cast("int")

    return df.select(
        key,
        flag("systolic", "diastolic").alias("miss_bp"),
        flag("average_screen_time").alias("miss_screen_time"),
        flag("sleep_quality").alias("miss_sleep_quality"),
        flag(*schema.SYMPTOMS).alias("miss_symptom_group"),
    )


def quality_alerts(
    rates: DataFrame, limits: dict[str, float], default: float = 0.2
) -> DataFrame:
    """Columns whose missing rate exceeds their limit, with the limit."""
    listed = F.create_map(*[x for c, v in limits.items() for x in (F.lit(c), F.lit(float(v)))])
    limit = F.coalesce(F.try_element_at(listed, F.col("column_name")), F.lit(default))
    return rates.withColumn("max_rate", limit).filter(F.col("missing_rate") > F.col("max_rate"))


def by_month(df: DataFrame, time: str, value: str, keys: list[str], high: float) -> DataFrame:
    """Rows, missing share, mean and share above a bound per month and key."""
    month = F.date_trunc("month", F.col(time).cast("timestamp")).cast("timestamp_ntz")
    return df.groupBy(month.alias("month"), *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col(value).isNull(), 1.0).otherwise(0.0)).alias("missing_rate"),
        F.avg(value).alias("mean_value"),
        F.avg(F.when(F.col(value) > high, 1.0).otherwise(0.0)).alias("high_rate"),
    )


def psi(
    df: DataFrame, snapshot: str, bucket: str, keys: list[str], floor: float = 1e-6
) -> DataFrame:
    """Population stability index between the rows with snapshot 'base' and 'current'."""
    counts = df.groupBy(*keys, bucket).agg(
        F.count(F.when(F.col(snapshot) == "base", 1)).alias("base"),
        F.count(F.when(F.col(snapshot) == "current", 1)).alias("current"),
    )
    return psi_of_counts(counts, keys, floor)


def psi_of_counts(counts: DataFrame, keys: list[str], floor: float = 1e-6) -> DataFrame:
    """From one row per key and bucket with its ``base`` and ``current`` counts."""
    totals = counts.groupBy(*keys).agg(F.sum("base").alias("all_base"), F.sum("current").alias("all_current"))
    joined = counts.join(totals, keys)

    def share(part: str):
        return F.greatest(F.coalesce(F.try_divide(part, f"all_{part}"), F.lit(0.0)), F.lit(floor))

    term = (share("current") - share("base")) * F.ln(share("current") / share("base"))
    return joined.groupBy(*keys).agg(F.sum(term).alias("psi"))


def drift(df: DataFrame, snapshot: str, columns: list[str], bins: int = 10) -> DataFrame:
    """PSI per numeric column, binned at the deciles of the base snapshot; NULL is its own bin.

    One scan: bins follow from the number of base rows below each distinct value.
    """
    doubles = df.select(snapshot, *[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot([snapshot], columns, "feature", "value").select(
        snapshot, "feature", F.col("value").isNull().alias("absent"), F.coalesce("value", F.lit(0.0)).alias("value")
    )
    sums = {side: F.count(F.when(F.col(snapshot) == side, 1)) for side in ("base", "current")}
    totals = running_totals(long, "value", sums, keys=("feature", "absent"))
    place = F.when(F.col("absent"), -1).otherwise(quantile_bin("base", bins))
    counts = totals.groupBy("feature", place.alias("bin")).agg(
        *[F.sum(side).alias(side) for side in sums]
    )
    return psi_of_counts(counts, ["feature"])
