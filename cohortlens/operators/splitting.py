"""Stratified splits with exact quotas, decided by a seeded hash of the row id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import schema
from cohortlens.operators.lookup import bounded
from cohortlens.session import materialize

# --- fixed values: the split shares in use ---------------------------------
SHARES = {
    "60/20/20": {"test": 0.20, "val": 0.20},
    "64/16/20": {"test": 0.20, "val": 0.16},
    "70/15/15": {"test": 0.15, "val": 0.15},
}
DIGITS = 4  # hex digits per level of the count tree: 65,536 branches
FEW = 20_000  # rows of a bucket that are put in order at once; of larger ones the next level is counted


def hashed(df: DataFrame, key: str, seed: int | str = schema.SEED) -> DataFrame:
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    return df.withColumn("row_hash", F.md5(text))


def _boundaries(counted: DataFrame, places) -> DataFrame:
    """(class, prefix, name, place, n): the bucket each boundary lies in, its place inside and the bucket's rows.

    ``counted`` has ``n`` per class and bucket, ``places`` maps a class's total to an array of (name, place).
    """
    whole = Window.partitionBy("class", "within")
    running = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumns({"before": F.sum("n").over(running) - F.col("n"), "total": F.sum("n").over(whole)})
    hits = F.filter(places(F.col("total")), lambda b: (b["place"] > F.col("before")) & (b["place"] <= F.col("before") + F.col("n")))
    inside = F.transform(hits, lambda b: F.struct(b["name"].alias("name"), (b["place"] - F.col("before")).alias("place")))
    return placed.select("class", F.col("bucket").alias("prefix"), "n", F.inline(inside))


def _cut_hashes(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Per class and share boundary the hash of the last row inside; ``rows`` are (class, row_hash), written.

    A tree of counts by hash prefix: the first level is one scan with partial sums. Only where a boundary's bucket still has
    more than ``FEW`` rows is the next level counted, inside that bucket; then its rows are put in order.
    """
    share, bounds = 0.0, []
    for name, part in shares.items():
        share += part
        bounds.append((name, round(share, 12)))

    def quotas(total):
        return F.array(*[F.struct(F.lit(n).alias("name"), F.floor(F.lit(s) * total + 0.5).alias("place")) for n, s in bounds])

    digits = DIGITS
    first = rows.groupBy("class", F.lit("").alias("within"), F.substring("row_hash", 1, digits).alias("bucket"))
    wanted = materialize(_boundaries(first.agg(F.count(F.lit(1)).alias("n")), quotas))

    def inside(columns: list[str]):
        spots = wanted.groupBy("class", "prefix").agg(F.collect_list(F.struct("name", "place")).alias("spots"))  # one per boundary
        near = rows.withColumn("prefix", F.substring("row_hash", 1, digits))
        return near.join(bounded(spots), ["class", "prefix"]).select("class", "prefix", "spots", *columns)

    while (wanted.agg(F.max("n")).first()[0] or 0) > FEW and digits < 32:
        found = inside(["row_hash"])
        digits += DIGITS
        deeper = found.groupBy("class", F.col("prefix").alias("within"), "spots", F.substring("row_hash", 1, digits).alias("bucket"))
        wanted = materialize(_boundaries(deeper.agg(F.count(F.lit(1)).alias("n")), lambda total: F.col("spots")))
    order = Window.partitionBy("class", "prefix").orderBy("row_hash")
    near = inside(["row_hash"]).withColumn("at", F.row_number().over(order))
    hit = near.select("class", "row_hash", "at", F.inline("spots")).filter(F.col("at") == F.col("place"))
    return hit.groupBy("class").agg(
        *[F.max(F.when(F.col("name") == name, F.col("row_hash"))).alias(f"cut_{name}") for name in shares]
    )


def _assigned(df: DataFrame, key: str, label: str, shares: dict[str, float], rest: str, seed: int | str, name: str) -> DataFrame:
    """``df`` without NULL labels plus ``name``: the share each row falls in, exactly the rounded quota per class."""
    labelled = df.filter(F.col(label).isNotNull())
    if not shares:
        return labelled.withColumn(name, F.lit(rest))
    rows = hashed(labelled, key, seed)
    narrow = materialize(rows.select(F.col(label).alias("class"), "row_hash"))
    cuts = materialize(_cut_hashes(narrow, shares))
    joined = rows.join(bounded(cuts), rows[label] == cuts["class"], "left")
    part = None
    for one in shares:
        inside = F.col("row_hash") <= F.col(f"cut_{one}")
        part = F.when(inside, one) if part is None else part.when(inside, one)
    return joined.withColumn(name, part.otherwise(rest)).drop("row_hash", "class", *[f"cut_{one}" for one in shares])


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    shares: dict[str, float] = SHARES["60/20/20"],
    rest: str = "train",
    seed: int = schema.SEED,
) -> DataFrame:
    """Add ``split``: per class exactly the rounded share of rows, by order of the id hash.

    ``key`` must be unique. Rows without a label are left out. The input is worked out twice: once for class and hash, which
    are written, and once for the result, whose rows are not shuffled as long as the cuts, one row per
    class, are few enough to be broadcast.
    """
    return _assigned(df, key, label, shares, rest, seed, "split")


def hash_split(
    df: DataFrame, key: str, shares: dict[str, float], rest: str = "train", seed: int = schema.SEED
) -> DataFrame:
    """Split by hash range alone: one pass, shares hold on average only."""
    point = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10)
    place = point.cast("double") / float(16**8)
    split, share = None, 0.0
    for name, part in shares.items():
        share += part
        split = F.when(place < share, name) if split is None else split.when(place < share, name)
    return df.withColumn("split", split.otherwise(rest))


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = schema.SEED) -> DataFrame:
    """Add ``fold`` from 0 to k - 1: per class, fold sizes differ by one row at most. Rows without a label are left out."""
    if k < 2:
        return df.filter(F.col(label).isNotNull()).withColumn("fold", F.lit(0))
    shares = {str(i): 1 / k for i in range(k - 1)}
    return _assigned(df, key, label, shares, str(k - 1), f"fold{seed}", "fold").withColumn("fold", F.col("fold").cast("int"))


def fold_report(folded: DataFrame, label: str) -> DataFrame:
    return folded.groupBy("fold", F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def split_report(split: DataFrame, label: str) -> DataFrame:
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(label).cast("bigint").alias("positives"),
        F.avg(label).alias("positive_rate"),
    )
