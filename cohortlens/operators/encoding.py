"""Encodings, fills and scales. Fit steps bring back one row per column or category table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import schema
from cohortlens.functions import clean
from cohortlens.functions.project import with_exprs
from cohortlens.operators import ranking
from cohortlens.operators.lookup import attach
from cohortlens.session import materialize

def double_literal(value: float) -> str:
    return f"{float(value)!r}D"


def model_matrix(
    df: DataFrame, features: list[str], label: str = schema.LABEL, key: str = "row_id"
) -> DataFrame:
    """key, label and numeric features; text is read as a code, else as a number.

    Rows without a label are left out.
    """
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    have = [c for c in features if c in df.columns]
    wanted = df.filter(F.col(label).isNotNull()).select(key, label, *have)
    changed = {
        c: f"double(coalesce({clean.coded(c, schema.BINARY_CODES)}, try_cast(`{c}` AS DOUBLE)))"
        if c in text
        else f"double(`{c}`)"
        for c in have
    }
    return with_exprs(wanted, changed)


def check_features(features: list[str], stage: str, forbidden=schema.STAGE_A_FORBIDDEN) -> None:
    """Stage A may use no symptom."""
    leaked = [c for c in features if c in forbidden]
    if stage == "A" and leaked:
        raise ValueError(f"stage A must not use {leaked}")


def stage_features(df: DataFrame, stage: str) -> list[str]:
    listed = schema.STAGE_A_FEATURES if stage == "A" else schema.STAGE_B_FEATURES
    check_features(listed, stage)
    return [c for c in listed if c in df.columns]


def feature_report(df: DataFrame, stages: tuple[str, ...] = ("A", "B"), forbidden=schema.STAGE_A_FORBIDDEN) -> DataFrame:
    """(stage, place, feature, known, forbidden_in_a): the features of each stage in their order, rows that have them, and whether
    stage A must not use them. One scan, one aggregate row, whatever the number of features."""
    listed = [(s, i, c) for s in stages for i, c in enumerate(stage_features(df, s))]
    counted = df.agg(*[F.count(c).alias(c) for c in sorted({c for _, _, c in listed})])
    rows = [
        F.struct(
            F.lit(s).alias("stage"), F.lit(i).alias("place"), F.lit(c).alias("feature"), F.col(c).alias("known"),
            F.lit(c in forbidden).alias("forbidden_in_a"),
        )
        for s, i, c in listed
    ]
    return counted.select(F.inline(F.array(*rows)))


def fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return with_exprs(
        df, {c: f"coalesce(double(`{c}`), {double_literal(v)})" for c, v in values.items()}
    )


def median_impute(
    df: DataFrame, columns: list[str], fit_on: DataFrame | None = None, exact: bool = True
) -> DataFrame:
    """NULL to the median of ``fit_on`` (default: the rows themselves), 0 without values.

    With ``exact=False`` medians come from one pass with Spark's approximate percentile.
    """
    find = ranking.medians if exact else ranking.approximate_medians
    return fill(df, find(df if fit_on is None else fit_on, columns))


def mode_impute(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """NULL to the most frequent code, the smaller one on a tie. For coded columns."""
    source = df if fit_on is None else fit_on
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = source.select(F.inline(pairs)).filter("value IS NOT NULL").groupBy("feature", "value").count()
    best = counts.groupBy("feature").agg(F.max_by("value", F.struct("count", -F.col("value"))).alias("value"))
    kinds = dict(df.dtypes)
    known = {r["feature"]: r["value"] for r in best.collect()}  # one row per column
    return with_exprs(df, {c: f"coalesce(`{c}`, CAST({double_literal(v)} AS {kinds[c]}))" for c, v in known.items()})


def scale_standard(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    source = df if fit_on is None else fit_on
    row = source.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return _scaled(df, {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns})


def scale_robust(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - median) / interquartile range; a zero range counts as 1."""
    source = df if fit_on is None else fit_on
    found = ranking.quantiles(source, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).collect()
    return _scaled(df, {r["feature"]: (r["q50"], r["q75"] - r["q25"]) for r in found})


def _scaled(df: DataFrame, fitted: dict[str, tuple]) -> DataFrame:
    return with_exprs(
        df,
        {
            c: f"(double(`{c}`) - {double_literal(centre)}) / {double_literal(width or 1.0)}"
            for c, (centre, width) in fitted.items()
            if centre is not None
        },
    )


def target_counts(df: DataFrame, category: str, label: str) -> DataFrame:
    """category, n and hits over the labelled rows, NULL being a category; one scan, written once."""
    labelled = df.filter(F.col(label).isNotNull()).groupBy(category)
    return materialize(labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("hits")))


def target_encode(
    df: DataFrame, category: str, label: str, smoothing: float = 10.0, fit_on: DataFrame | None = None,
    **limits: int,
) -> DataFrame:
    """Add ``<category>_encoded``: the label mean of the category drawn towards the overall mean.

    Categories not seen in the fit, and NULL, get the overall mean.
    """
    counts = target_counts(df if fit_on is None else fit_on, category, label)
    overall = counts.agg(F.try_divide(F.sum("hits"), F.sum("n"))).scalar()
    value = (F.col("hits") + F.lit(smoothing) * overall) / (F.col("n") + F.lit(smoothing))
    table = counts.filter(F.col(category).isNotNull()).select(category, "n", value.alias("encoded"))
    joined = attach(df, table, category, **limits)
    return joined.withColumn(f"{category}_encoded", F.coalesce("encoded", overall)).drop("n", "encoded")


def factor_codes(
    df: DataFrame, columns: list[str], order: str, below: int = 10
) -> DataFrame:
    """(feature, value, code): codes by first appearance, for columns with few values.

    Columns with ``below`` or more distinct values are left out, so each window below
    runs over a handful of rows.
    """
    text = df.select(order, *[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([order], columns, "feature", "value").filter(F.col("value").isNotNull())
    first = long.groupBy("feature", "value").agg(F.min(order).alias("first_seen"))
    few = first.groupBy("feature").agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") < below)
    # One row per column.
    kept = first.join(F.broadcast(few), "feature")
    by_first = Window.partitionBy("feature").orderBy("first_seen", "value")
    return kept.select("feature", "value", (F.row_number().over(by_first) - 1).alias("code"))


def factorize(df: DataFrame, columns: list[str], order: str, below: int = 10) -> DataFrame:
    """Replace text by its code (-1 for NULL) and drop columns with too many values."""
    codes = factor_codes(df, columns, order, below).collect()  # below * columns rows at most
    known: dict[str, list] = {}
    for row in codes:
        known.setdefault(row["feature"], []).append((row["value"], row["code"]))
    out = df
    for c in columns:
        if c not in known:
            out = out.drop(c)
            continue
        value, coded = F.col(c).cast("string"), F.lit(-1)
        for text, code in known[c]:
            coded = F.when(value == text, F.lit(code)).otherwise(coded)
        out = out.withColumn(c, coded)
    return out


def class_weights(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    """n0, n1, n0/n1 and the balanced weight of each class, in one row."""
    zeros, ones = F.count(F.when(F.col(label) == 0, 1)), F.count(F.when(F.col(label) == 1, 1))
    row = df.agg(zeros.alias("n0"), ones.alias("n1"))
    n = F.col("n0") + F.col("n1")
    return row.select(
        "n0",
        "n1",
        F.try_divide("n0", "n1").alias("scale_pos_weight"),
        F.try_divide(n, F.col("n0") * 2).alias("weight_0"),
        F.try_divide(n, F.col("n1") * 2).alias("weight_1"),
    )


def with_class_weight(df: DataFrame, label: str = schema.LABEL, name: str = "weight") -> DataFrame:
    row = class_weights(df, label).first()
    one, zero = (double_literal(row[c] or 1.0) for c in ("weight_1", "weight_0"))
    return with_exprs(df, {name: f"CASE WHEN `{label}` = 1 THEN {one} ELSE {zero} END"})


def anova_f(df: DataFrame, columns: list[str], label: str = schema.LABEL) -> DataFrame:
    """(feature, f_value) from per-class counts, means and variances in one pass."""
    stats = [
        part
        for c in columns
        for part in (
            F.struct(
                F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var")
            ).alias(c),
        )
    ]
    per_class = df.filter(F.col(label).isNotNull()).groupBy(label).agg(*stats)
    long = per_class.unpivot([label], columns, "feature", "s").select("feature", "s.*")
    rows = F.collect_list(F.struct("n", "mean", "var"))  # one entry per class
    grouped = long.filter(F.col("n") > 0).groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("all_n"),
        F.sum(F.col("n") * F.col("mean")).alias("total"), rows.alias("classes"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
    )
    mean = F.col("total") / F.col("all_n")
    between = F.aggregate(
        F.col("classes"), F.lit(0.0), lambda a, c: a + c["n"] * (c["mean"] - mean) * (c["mean"] - mean)
    )
    f_value = F.try_divide(
        F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("all_n") - F.col("k"))
    )
    return grouped.select("feature", f_value.alias("f_value"))


def anova_topk(df: DataFrame, columns: list[str], label: str = schema.LABEL, k: int = 25) -> DataFrame:
    return anova_f(df, columns, label).orderBy(F.desc_nulls_last("f_value"), "feature").limit(k)
