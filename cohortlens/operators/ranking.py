"""Exact running totals over ordered values, and quantiles from them.

No window ever covers more than one range slice: rows are first combined to distinct
values, range-partitioned by value, written once with their slice number, and only the
per-slice totals (as many rows as shuffle partitions) are added up in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.project import with_exprs
from cohortlens.session import materialize


def running_totals(
    df: DataFrame,
    value: str,
    sums: dict[str, Column],
    keys: tuple[str, ...] = (),
    descending: bool = False,
) -> DataFrame:
    """Per key and distinct value: each sum, its inclusive running total ``cum_*`` and ``all_*``.

    NULL values and NULL keys are left out. A value shared by many rows is one row here,
    so no value, however frequent, weighs on one task.
    """
    keys = list(keys)
    known = df
    for c in [*keys, value]:
        known = known.filter(F.col(c).isNotNull())
    distinct = known.groupBy(*keys, value).agg(*[s.alias(n) for n, s in sums.items()])
    by_value = F.desc(value) if descending else F.asc(value)
    ranged = distinct.repartitionByRange(*[F.asc(k) for k in keys], by_value)
    stored = materialize(ranged.withColumn("slice", F.spark_partition_id()))

    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = stored.groupBy(*keys, "slice").agg(*[F.sum(n).alias(n) for n in sums])
    offsets = per_slice.select(
        *keys,
        "slice",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums],
        *[F.sum(n).over(whole).alias(f"all_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys, "slice").orderBy(by_value)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stored.join(offsets, [*keys, "slice"]).select(
        *keys,
        value,
        *sums,
        *[(F.col(f"before_{n}") + F.sum(n).over(inside)).alias(f"cum_{n}") for n in sums],
        *[f"all_{n}" for n in sums],
    )


def long_values(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., feature, value) with values as double; NULL and NaN left out."""
    doubles = with_exprs(df.select(*keep, *columns), {c: f"nullif(double(`{c}`), double('NaN'))" for c in columns})
    return doubles.unpivot(list(keep), columns, "feature", "value").filter(F.col("value").isNotNull())


def quantiles(
    df: DataFrame, columns: list[str], probabilities: dict[str, float], moments: bool = False
) -> DataFrame:
    """Exact quantiles per column by linear interpolation, plus n and the distinct count.

    With ``moments`` also mean, sample deviation, min and max, from the same scan. A column
    without values has no row.
    """
    sums = {"n": F.count(F.lit(1))}
    if moments:
        sums["total"] = F.sum("value")
    totals = running_totals(long_values(df, columns), "value", sums, keys=("feature",))
    parts = []
    for name, p in probabilities.items():
        spot = F.lit(float(p)) * (F.col("all_n") - 1)
        for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            here = (F.col("cum_n") > rank) & (F.col("cum_n") - F.col("n") <= rank)
            parts.append(F.max(F.when(here, F.col("value"))).alias(f"{name}_{side}"))
    extra = []
    if moments:
        mean = F.col("all_total") / F.col("all_n")
        off = F.col("value") - mean
        parts += [
            F.max(mean).alias("mean"),
            F.sum(F.col("n") * off * off).alias("squares"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        ]
        std = F.sqrt(F.try_divide("squares", F.col("n") - 1)).alias("std")
        extra = ["mean", std, "min", "max"]
    found = totals.groupBy("feature").agg(
        F.max("all_n").alias("n"), F.count(F.lit(1)).alias("distinct_n"), *parts
    )
    out = []
    for name, p in probabilities.items():
        spot = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return found.select("feature", "n", "distinct_n", *extra, *out)


def quantile_bin(count: str, bins: int) -> Column:
    """Over running totals: how many of the bins - 1 discrete quantiles lie below the value.

    Quantile i is the smallest value with at least i/bins of the counted rows up to it, so
    it lies below a value exactly if that many rows do.
    """
    below = F.col(f"cum_{count}") - F.col(count)
    out = F.lit(0)
    for i in range(1, bins):
        need = F.greatest(F.lit(1), F.ceil(F.lit(i / bins) * F.col(f"all_{count}")))
        out = out + (below >= need).cast("int")
    return out


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Median per column; a column without values gets 0. One row per column is brought back."""
    rows = quantiles(df, columns, {"q50": 0.5}).collect()
    found = {r["feature"]: r["q50"] for r in rows}
    return {c: found.get(c, 0.0) for c in columns}


def approximate_medians(df: DataFrame, columns: list[str], accuracy: int = 10_000) -> dict[str, float]:
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in columns]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in columns}
