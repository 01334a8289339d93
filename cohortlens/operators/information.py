"""Mutual information between a continuous column and a class by nearest neighbours (Ross, 2014).

For every value the distance to its k-th nearest neighbour of the same class is compared with how many rows of any class lie within that
distance. In one dimension both follow from order alone: rows are combined to distinct values, numbered in their class by
running totals, and cut into blocks of equal numbers of values that also hold the k values beyond either border, so that each block finds
its neighbours by itself. The ends of the intervals are put among the values, and one more running total counts the
rows between them. A value shared by a third of all rows is one row throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import schema
from cohortlens.operators import ranking
from cohortlens.session import materialize, ship

K = 3
BLOCK = 8192  # distinct values of a class compared by one task at a time
FOUND = "feature string, class string, value double, n bigint, in_class bigint, k bigint, low double, high double, same boolean"


def digamma(x: Column) -> Column:
    """The digamma function of x >= 1, to some 1e-14: its asymptotic series ten steps up, and the steps back."""
    up = x + 10
    series = F.ln(up) - 1 / (2 * up) - 1 / (12 * up**2) + 1 / (120 * up**4) - 1 / (252 * up**6)
    return series - sum((1 / (x + i) for i in range(1, 10)), 1 / x)


def reach(values: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted distinct values with counts: (low, high, same) of the open interval up to the k-th nearest other one.

    Its ends are the neighbours themselves where they lie at the distance. ``same`` says that the distance is 0. Ends beyond the values given
    are infinite.
    """
    copies = np.minimum(counts, k + 1)
    flat, at = np.repeat(values, copies), np.cumsum(copies) - copies
    padded = np.concatenate([np.full(k, -np.inf), flat, np.full(k, np.inf)])
    gaps = np.stack([np.maximum(values - padded[at + k - j], padded[at + 2 * k - j] - values) for j in range(k + 1)])
    far = gaps.min(axis=0)
    low, high = values - far, values + far
    for j in range(k + 1):
        left, right = padded[at + k - j], padded[at + 2 * k - j]
        best = gaps[j] == far
        low = np.where(best & (values - left == far), left, low)
        high = np.where(best & (right - values == far), right, high)
    return low, high, far == 0


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("value")
    k = int(frame["k"].iloc[0])
    low, high, same = reach(frame["value"].to_numpy(), frame["n"].to_numpy(), k)
    out = frame.assign(low=low, high=high, same=same)[~frame["border"].to_numpy()]
    return out[["feature", "class", "value", "n", "in_class", "k", "low", "high", "same"]]


def nearest_information(df: DataFrame, columns: list[str], label: str = schema.LABEL, k: int = K) -> DataFrame:
    """(feature, rows, mutual_information) in nats, not negative, over the rows that have label and column.

    Where a class has no more than k rows, all others of it are its neighbours; a class of one row is left out. A column without
    values has no row. Values at distance 0 are counted with their equals only; no noise is added.
    """
    ship(df.sparkSession)
    long = ranking.long_values(df.filter(F.col(label).isNotNull()), columns, keep=(label,))
    long = long.select("feature", F.col(label).cast("string").alias("class"), "value")
    sums = {"n": F.count(F.lit(1)), "place": F.max(F.lit(1))}
    totals = ranking.running_totals(long, "value", sums, keys=("feature", "class")).filter("all_n > 1")
    rows = totals.select(
        "feature", "class", "value", "n", F.col("all_n").alias("in_class"), F.least(F.lit(k), F.col("all_n") - 1).cast("bigint").alias("k"),
        F.col("cum_place").cast("bigint").alias("place"),
    )
    rows = materialize(rows)
    home = F.floor((F.col("place") - 1) / BLOCK)
    near = F.sequence(F.floor((F.col("place") - 1 - k) / BLOCK), F.floor((F.col("place") - 1 + k) / BLOCK))
    spread = rows.withColumn("block", F.explode(near)).withColumn("border", F.col("block") != home).drop("place")
    found = materialize(spread.groupBy("feature", "class", "block").applyInPandas(_block, FOUND))

    ends = [F.struct(F.col(c).alias("value"), F.lit(0).cast("bigint").alias("n")) for c in ("low", "high")]
    points = rows.select("feature", "value", "n")
    marks = points.unionByName(found.filter("NOT same").select("feature", F.inline(F.array(*ends))).distinct())
    counted = ranking.running_totals(marks, "value", {"n": F.sum("n")}, keys=("feature",))
    upto = materialize(counted.select("feature", "value", F.col("cum_n").alias("upto"), (F.col("cum_n") - F.col("n")).alias("below"), "all_n"))
    at_low = upto.select("feature", F.col("value").alias("low"), F.col("upto").alias("upto_low"))
    at_high = upto.select("feature", F.col("value").alias("high"), F.col("below").alias("below_high"))
    equal = upto.select("feature", "value", (F.col("upto") - F.col("below")).alias("equal"), "all_n")
    joined = found.join(equal, ["feature", "value"]).join(at_low, ["feature", "low"], "left").join(at_high, ["feature", "high"], "left")
    within = F.when(F.col("same"), F.col("equal")).otherwise(F.col("below_high") - F.col("upto_low")).cast("double")
    part = F.col("n") * (digamma(F.col("k").cast("double")) - digamma(F.col("in_class").cast("double")) - digamma(within))
    summed = joined.groupBy("feature").agg(F.max("all_n").alias("rows"), F.sum(part).alias("parts"))
    total = F.col("rows").cast("double")
    return summed.select("feature", "rows", F.greatest(digamma(total) + F.col("parts") / total, F.lit(0.0)).alias("mutual_information"))
