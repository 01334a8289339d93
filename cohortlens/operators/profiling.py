"""Profiles: missing values, classes, statistics, correlation, information, conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import schema
from cohortlens.operators import encoding, ranking
from cohortlens.operators.quality import long_form


def missing_analysis(df: DataFrame, columns: list[str], high: float = 50.0) -> DataFrame:
    """(feature, count, percentage, high_missing), all columns in one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.expr(f"count_if(`{c}` IS NULL)").alias(c) for c in columns],
    )
    long = long_form(row, columns, "feature", "missing", keys=["rows"])
    share = F.coalesce(F.try_divide(F.col("missing") * 100, F.col("rows")), F.lit(0.0))
    return long.select("feature", "missing", share.alias("percentage")).withColumn(
        "high_missing", F.col("percentage") > high
    )


def class_distribution(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    rows = df.filter(F.col(label).isNotNull())
    counted = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col(label) == 0, 1)).alias("class_0"),
        F.count(F.when(F.col(label) == 1, 1)).alias("class_1"),
    )
    total, zero, one = F.col("total"), F.col("class_0"), F.col("class_1")
    return counted.withColumns(
        {
            "percent_0": F.coalesce(F.try_divide(zero * 100, total), F.lit(0.0)),
            "percent_1": F.coalesce(F.try_divide(one * 100, total), F.lit(0.0)),
            "imbalance_ratio": F.coalesce(F.try_divide(zero, one), F.lit(0.0)),
        }
    )


def majority_baseline(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.try_divide(F.max("n"), F.sum("n")).alias("majority_accuracy"))


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, extremes, exact quartiles and distinct count per column.

    One scan; a column without values keeps its row with n = 0.
    """
    found = ranking.quantiles(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75}, moments=True)
    rows = ", ".join(f"('{c}')" for c in columns)
    listed = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS listed(feature)")
    return listed.join(found, "feature", "left").withColumns(
        {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n", "distinct_n")}
    )


def approximate_stats(df: DataFrame, columns: list[str], relative_error: float = 0.01) -> DataFrame:
    """The same in a single pass with approximate quartiles and distinct counts."""
    accuracy = int(1 / relative_error)
    row = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], accuracy).alias("quartiles"),
                F.approx_count_distinct(c).alias("distinct_n"),
            ).alias(c)
            for c in columns
        ]
    )
    return row.unpivot([], columns, "feature", "s").select("feature", "s.*")


def correlation_row(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Pearson correlation with the label per column; 0 where one side is constant."""
    y = F.col(label).cast("double")

    def corr(c: str) -> Column:
        x = F.when(y.isNotNull(), F.col(c).cast("double"))
        both = F.when(x.isNotNull(), y)
        value = F.try_divide(F.covar_pop(x, both), F.stddev_pop(x) * F.stddev_pop(both))
        return F.coalesce(value, F.lit(0.0)).alias(c)

    row = df.agg(*[corr(c) for c in columns])
    return long_form(row, columns, "feature", "correlation")


def label_correlations(
    df: DataFrame, columns: list[str], label: str = schema.LABEL
) -> DataFrame:
    """Every column's correlation after median fill, its sign, and its rank by strength.

    One row per column, hence the window over all of them.
    """
    labelled = df.filter(F.col(label).isNotNull())
    found = correlation_row(encoding.median_impute(labelled, columns), columns, label)
    sign = F.when(F.col("correlation") > 0, "positive").when(F.col("correlation") < 0, "negative")
    ranked = found.withColumns({"strength": F.abs("correlation"), "sign": sign.otherwise("none")})
    place = F.row_number().over(Window.orderBy(F.desc("strength"), "feature"))
    return ranked.withColumn("rank", place)


def correlation_top(df: DataFrame, columns: list[str], label: str = schema.LABEL, k: int = 15) -> DataFrame:
    found = correlation_row(df, columns, label).withColumn("strength", F.abs("correlation"))
    return found.orderBy(F.desc("strength"), "feature").limit(k).select("feature", "strength")


def leak_alarm(
    df: DataFrame, suspects: list[str], label: str = schema.LABEL, limit: float = 0.8
) -> DataFrame:
    found = correlation_row(df, suspects, label)
    return found.withColumn("alarm", F.abs("correlation") > limit)


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    kinds = dict(df.dtypes)
    columns = columns or df.columns
    counted = missing_analysis(df, columns)
    total = df.agg(F.count(F.lit(1))).scalar()
    kind = F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])]), F.col("feature"))
    return counted.select(
        F.col("feature").alias("column_name"),
        kind.alias("dtype"),
        (total - F.col("missing")).alias("non_null"),
        F.col("missing").alias("nulls"),
        F.col("percentage").alias("null_pct"),
    )


def categorical_top(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """Per text column its most frequent values and its distinct count.

    Spark keeps only k candidates per column and task before the window's exchange.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    long = df.select(*columns).unpivot([], columns, "feature", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    distinct = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct_n"))
    order = Window.partitionBy("feature").orderBy(F.desc("n"), F.asc("value"))
    top = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return top.join(distinct, "feature")


def mutual_information(
    df: DataFrame, columns: list[str], label: str = schema.LABEL, bins: int = 10
) -> DataFrame:
    """Plug-in mutual information (nats) of each column, cut at its quantiles, with a 0/1 label.

    One scan: the bin of a value follows from the number of rows below it, so the running
    totals give bins and class counts together; columns x bins rows go on from there.
    """
    long = ranking.long_values(df.filter(F.col(label).isNotNull()), columns, keep=(label,))
    sums = {"n": F.count(F.lit(1)), "pos": F.sum(F.col(label).cast("bigint"))}
    totals = ranking.running_totals(long, "value", sums, keys=("feature",))
    binned = totals.withColumn("bin", ranking.quantile_bin("n", bins))
    joint = binned.groupBy("feature", "bin").agg(
        F.sum("pos").alias("ones"), F.sum(F.col("n") - F.col("pos")).alias("zeros"),
        F.max("all_pos").alias("all_ones"), F.max("all_n").alias("all_n"),
    )
    all_n, in_bin = F.col("all_n").cast("double"), F.col("ones") + F.col("zeros")

    def term(cell: Column, in_class: Column) -> Column:
        share = cell / all_n * F.ln(cell * all_n / (in_bin * in_class))
        return F.when(cell > 0, share).otherwise(0.0)

    both = term(F.col("ones"), F.col("all_ones")) + term(F.col("zeros"), F.col("all_n") - F.col("all_ones"))
    return joint.groupBy("feature").agg(F.sum(both).alias("mutual_information"))


def label_conflicts(df: DataFrame, features: list[str], label: str = schema.LABEL) -> DataFrame:
    """How many distinct feature combinations carry both labels. NULL features leave a row out."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
    means = df.filter(known).groupBy(*features).agg(F.avg(label).alias("mean"))
    mixed = F.count(F.when((F.col("mean") > 0) & (F.col("mean") < 1), 1))
    found = means.agg(F.count(F.lit(1)).alias("combinations"), mixed.alias("conflicts"))
    share = F.try_divide(F.col("conflicts") * 100, F.col("combinations"))
    return found.withColumn("percentage", F.coalesce(share, F.lit(0.0)))
