"""Oversampling of the minority class and removal of borderline pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import schema
from cohortlens.operators.neighbours import row_neighbours
from cohortlens.operators.splitting import stratified_split
from cohortlens.session import materialize

# --- fixed values: minority share of the majority after oversampling -------
STRATEGIES = {"default": 1.0, "advanced": 0.7, "aggressive": 0.8}


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a seeded hash."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(16**8)


def smote(
    df: DataFrame, key: str, columns: list[str], label: str = schema.LABEL, strategy: float = 1.0,
    k: int = 5, seed: int = schema.SEED,
) -> DataFrame:
    """Rows plus synthetic minority rows until minority / majority reaches ``strategy``.

    A synthetic row lies between a minority row and one of its k nearest minority rows.
    Which rows serve, with which neighbour and where between them follows from the seed and
    the row key. The neighbour comes with its values, so that no row is joined to its partner, however many
    rows are equal and share it. Keys are not negative; a synthetic row gets a negative key of its own.
    """
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    few, minority, many = sizes.agg(F.min(F.struct("n", label)).alias("least"), F.max("n").alias("most")).select("least.*", "most").first() or (0, None, 0)
    wanted = max(0, round(strategy * (many or 0)) - (few or 0))
    kept = df.select(key, label, *columns).withColumn("synthetic", F.lit(0))
    if (few or 0) < 2 or not wanted:
        return kept
    base = df.filter(F.col(label) == minority).select(key, label, *columns)
    least, most = base.agg(F.min(key), F.max(key)).first()
    if least < 0 or most * (wanted // few + 2) + wanted // few + 1 >= 1 << 63:
        raise ValueError("keys must not be negative, nor so large that keys of synthetic rows do not fit")
    near = materialize(row_neighbours(base, key, columns, k))
    # Everyone serves wanted // few times; an exact hash quota serves once more.
    quota = stratified_split(near, key, label, {"extra": (wanted % few) / few}, "plain", seed)
    times = F.lit(wanted // few) + F.when(F.col("split") == "extra", 1).otherwise(0)
    copies = quota.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int")))))
    at = F.floor(_unit(F.lit(seed), F.lit("near"), F.col(key), F.col("copy")) * F.size("neighbours"))
    picked = copies.withColumns(
        {
            "other": F.element_at("neighbours", at.cast("int") + 1)["vector"],
            "gap": _unit(F.lit(seed), F.lit("gap"), F.col(key), F.col("copy")),
        }
    )
    between = [(F.col(c) + F.col("gap") * (F.col("other")[i] - F.col(c))).alias(c) for i, c in enumerate(columns)]
    own = -(F.col(key).cast("bigint") * (wanted // few + 2) + F.col("copy"))
    made = picked.select(own.alias(key), label, *between, F.lit(1).alias("synthetic"))
    return kept.unionByName(made)


def tomek_links(df: DataFrame, key: str, columns: list[str], label: str = schema.LABEL) -> DataFrame:
    """(low, high): pairs of unlike label that are each other's nearest row."""
    near = row_neighbours(df.select(key, label, *columns), key, columns, 1)
    # Both sides of the join are this table: kept, the search is done once.
    nearest = materialize(near.select(F.col(key).alias("a"), F.get("neighbours", F.lit(0))["id"].alias("b"), F.col(label).alias("y")))
    back = nearest.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("y").alias("other_y"))
    pairs = nearest.join(back, ["a", "b"]).filter((F.col("y") != F.col("other_y")) & (F.col("a") < F.col("b")))
    return pairs.select(F.col("a").alias("low"), F.col("b").alias("high"))


def remove_links(df: DataFrame, key: str, links: DataFrame) -> DataFrame:
    gone = links.select(F.explode(F.array("low", "high")).alias(key))
    return df.join(gone, key, "left_anti")


def smote_tomek(
    df: DataFrame, key: str, columns: list[str], label: str = schema.LABEL, strategy: float = 1.0,
    k: int = 5, seed: int = schema.SEED,
) -> DataFrame:
    """Oversample, then drop both rows of every borderline pair."""
    grown = smote(df, key, columns, label, strategy, k, seed)
    return remove_links(grown, key, tomek_links(grown, key, columns, label))
