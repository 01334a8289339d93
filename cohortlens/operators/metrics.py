"""Exact evaluation of binary scores: rank metrics, confusion, thresholds, calibration."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.ranking import running_totals



def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _counts(label: str) -> dict[str, Column]:
    return {"pos": F.sum(F.col(label).cast("bigint")), "n": F.count(F.lit(1))}


def _labelled(df: DataFrame, score: str, label: str, keys) -> DataFrame:
    return df.select(*keys, score, label).filter(
        F.col(score).isNotNull() & F.col(label).isNotNull()
    )


def confusion(tp: Column, fp: Column, pos: Column, neg: Column) -> dict[str, Column]:
    """Counts and the three ratios; ratios are 0 where they are not defined."""
    fn = pos - tp
    return {
        "tn": neg - fp,
        "fp": fp,
        "fn": fn,
        "tp": tp,
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(tp * 2, tp * 2 + fp + fn),
    }


def binary_metrics(
    df: DataFrame, score: str, label: str, threshold: float = 0.5, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Per key: ROC-AUC and average precision (NULL for one class), confusion at a threshold.

    All figures come from the distinct scores with their running totals from the highest
    score down.
    """
    keys = list(keys)
    ranked = running_totals(
        _labelled(df, score, label, keys), score, _counts(label), tuple(keys), descending=True
    )
    hit = F.col(score) >= F.lit(float(threshold))
    neg = F.col("n") - F.col("pos")
    area = neg * (F.col("cum_pos") - F.col("pos") / 2)
    step = F.col("pos") * (F.col("cum_pos") / F.col("cum_n"))
    zero = F.lit(0).cast("bigint")
    sums = ranked.groupBy(*keys).agg(
        F.coalesce(F.sum("pos"), zero).alias("p"),
        F.coalesce(F.sum(neg), zero).alias("q"),
        F.sum(area).alias("area"),
        F.sum(step).alias("step"),
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), zero).alias("hit_p"),
        F.coalesce(F.sum(F.when(hit, neg)), zero).alias("hit_q"),
    )
    p, q = F.col("p"), F.col("q")
    both = (p > 0) & (q > 0)
    cells = confusion(F.col("hit_p"), F.col("hit_q"), p, q)
    return sums.select(
        *keys,
        (p + q).alias("rows"),
        F.when(both, F.try_divide(F.col("area"), p.cast("double") * q)).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("step"), p)).alias("pr_auc"),
        *[c.alias(name) for name, c in cells.items()],
    )


def confusion_matrix(
    df: DataFrame, score: str, label: str, threshold: float = 0.5, keys: tuple[str, ...] = ()
) -> DataFrame:
    """tn, fp, fn, tp; all zero when the rows hold a single class."""
    y, hit = F.col(label), F.col(score) >= F.lit(float(threshold))

    def number(test: Column) -> Column:
        return F.count(F.when(test, 1))

    two = (number(y == 1) > 0) & (number(y == 0) > 0)
    cells = {
        "tn": (y == 0) & ~hit,
        "fp": (y == 0) & hit,
        "fn": (y == 1) & ~hit,
        "tp": (y == 1) & hit,
    }
    rows = _labelled(df, score, label, keys).groupBy(*keys)
    return rows.agg(
        *[F.when(two, number(test)).otherwise(0).alias(name) for name, test in cells.items()]
    )


def grid(start: float, stop: float, step: float = 0.01) -> list[float]:
    """Rounded thresholds from start up to and without stop."""
    return [round(start + i * step, 2) for i in range(round((stop - start) / step))]


# --- fixed values: the threshold grids -------------------------------------
RECALL_GRID = grid(0.10, 0.90)
F1_GRID = grid(0.10, 0.90)
NARROW_F1_GRID = grid(0.20, 0.70)
SCREENING_GRID = grid(0.10, 0.50)
TRIAGE_GRID = grid(0.20, 0.60)


def threshold_curve(
    df: DataFrame, score: str, label: str, thresholds: list[float], keys: tuple[str, ...] = ()
) -> DataFrame:
    """Confusion and ratios at every threshold from one aggregate over score buckets.

    The bucket count is the grid's, so the window below runs over that many rows per key.
    """
    keys = list(keys)
    value = F.col(score).cast("double")
    rows = _labelled(df, score, label, keys).withColumn(
        "point", F.when(F.isnan(value), F.lit(float("-inf"))).otherwise(value)
    )
    splits = [float("-inf"), *thresholds, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="point", outputCol="bucket").transform(rows)
    counted = bucketed.groupBy(*keys, F.col("bucket").cast("int").alias("bucket")).agg(
        *[c.alias(n) for n, c in _counts(label).items()]
    )
    listed = F.array(*[F.lit(t) for t in thresholds])
    # At most one entry per bucket.
    entry = F.collect_list(F.struct("bucket", F.struct("pos", "n").alias("c")))
    every = counted.groupBy(*keys).agg(
        F.sum("pos").alias("p"), F.sum("n").alias("all_n"), F.map_from_entries(entry).alias("cells")
    )
    points = every.select(*keys, "p", "all_n", "cells", F.posexplode(listed).alias("at", "threshold"))
    here = F.try_element_at("cells", F.col("at") + 1)
    joined = points.select(
        *keys, "threshold", "p", "all_n", F.col("at").alias("bucket"),
        F.coalesce(here["pos"], F.lit(0)).alias("pos"), F.coalesce(here["n"], F.lit(0)).alias("n"),
    )
    from_top = Window.partitionBy(*keys).orderBy(F.desc("bucket"))
    from_top = from_top.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tp, predicted = F.sum("pos").over(from_top), F.sum("n").over(from_top)
    summed = joined.select(*keys, "threshold", "p", "all_n", tp.alias("hit_p"), predicted.alias("hit"))
    p, q = F.col("p"), F.col("all_n") - F.col("p")
    cells = confusion(F.col("hit_p"), F.col("hit") - F.col("hit_p"), p, q)
    return summed.select(*keys, "threshold", *[c.alias(n) for n, c in cells.items()])


def _first_max(measure: Column, allowed: Column | None = None) -> Column:
    """(measure, -threshold) of the highest measure, the lowest threshold winning ties."""
    key = F.struct(measure.alias("measure"), (-F.col("threshold")).alias("minus"))
    return F.max(F.when(allowed, key) if allowed is not None else key)


def best_threshold(
    curve: DataFrame, measure: Column, default: float, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Lowest threshold with the highest positive measure, else the default."""
    top = curve.groupBy(*keys).agg(_first_max(measure).alias("top"))
    found = F.when(F.col("top.measure") > 0, -F.col("top.minus")).otherwise(F.lit(default))
    return top.select(
        *keys, found.alias("threshold"), F.coalesce(F.col("top.measure"), F.lit(0.0)).alias("measure")
    )


def max_recall(curve: DataFrame, keys=()) -> DataFrame:
    return best_threshold(curve, F.col("recall"), 0.5, keys)


def max_f1(curve: DataFrame, keys=()) -> DataFrame:
    return best_threshold(curve, F.col("f1"), 0.5, keys)


def triage_threshold(curve: DataFrame, keys=()) -> DataFrame:
    mix = 0.5 * F.col("f1") + 0.3 * F.col("recall") + 0.2 * F.col("precision")
    return best_threshold(curve, mix, 0.4, keys)


def screening_threshold(
    curve: DataFrame, target: float = 0.995, default: float = 0.5, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Best precision among thresholds that reach the target recall; a later threshold
    takes over only with a strictly higher mix of recall, precision and F1."""
    mix = 0.5 * F.col("recall") + 0.3 * F.col("precision") + 0.2 * F.col("f1")
    reaches = F.col("recall") >= target
    key = F.struct(
        F.col("precision").alias("measure"), (-F.col("threshold")).alias("minus"), mix.alias("mix")
    )
    both = curve.groupBy(*keys).agg(
        F.max(F.when(reaches, key)).alias("kept"), _first_max(mix, ~reaches).alias("later")
    )
    overtaken = F.col("kept").isNull() | (F.col("later.measure") > F.col("kept.mix"))
    chosen = F.when(
        F.col("later").isNotNull() & overtaken, -F.col("later.minus")
    ).otherwise(-F.col("kept.minus"))
    return both.select(*keys, F.coalesce(chosen, F.lit(default)).alias("threshold"))


def youden_threshold(
    df: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Observed score with the largest tpr - fpr; the highest score wins ties."""
    ranked = running_totals(
        _labelled(df, score, label, keys), score, _counts(label), keys, descending=True
    )
    tpr = F.try_divide(F.col("cum_pos"), F.col("all_pos"))
    fpr = F.try_divide(F.col("cum_n") - F.col("cum_pos"), F.col("all_n") - F.col("all_pos"))
    top = ranked.groupBy(*keys).agg(
        F.max(F.struct((tpr - fpr).alias("j"), F.col(score).alias("at"))).alias("top")
    )
    return top.select(*keys, F.col("top.at").alias("threshold"), F.col("top.j").alias("youden_j"))


def calibration_bins(
    df: DataFrame, score: str, label: str, bins: int = 10, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Mean score against observed rate per equal-width bin of [0, 1]."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    rows = _labelled(df, score, label, keys).withColumn("bin", place)
    return rows.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        F.avg(label).alias("rate"),
    )
