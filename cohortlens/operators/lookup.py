"""Attach one row per key to a large table without a hot task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import materialize

BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
SALTS = 32


def fits(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``rows`` rows; looks at no more than that."""
    return table.limit(rows + 1).count() <= rows


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(table) if fits(table, rows) else table


def _estimated_bytes(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def attach(
    df: DataFrame,
    table: DataFrame,
    key: str,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Left join of ``table`` (unique on ``key``) to ``df``.

    A table within ``broadcast_rows`` rows and ``BROADCAST_BYTES`` is broadcast. Beyond that, rows with a NULL key, which match
    nothing, are not shuffled at all, and keys with more than 1/(4 * salts) of the rows of ``df``, at most
    4 * salts of them, whether the table has them or not, are spread over several tasks: their table rows are
    repeated once per salt and the data rows take a salt from the hash of their other columns, which must
    tell the rows apart (a row id does). The table is written once first, so that neither the
    check nor the join works it out again.
    """
    table = materialize(table)
    if fits(table, broadcast_rows) and _estimated_bytes(table) <= BROADCAST_BYTES:
        return df.join(F.broadcast(table), key, "left")
    keyed = df.filter(F.col(key).isNotNull())
    counts = keyed.groupBy(F.col(key).alias("hot_key")).agg(F.count(F.lit(1)).alias("rows"))
    counts = materialize(counts)
    total = counts.agg(F.sum("rows")).first()[0] or 0
    marks = F.broadcast(counts.filter(F.col("rows") * (4 * salts) > total).select("hot_key"))
    marked = keyed.join(marks, F.col(key) == F.col("hot_key"), "left")
    others = [F.col(c) for c in df.columns if c != key]
    spread = F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")
    salted = marked.withColumn("salt", F.when(F.col("hot_key").isNotNull(), spread).otherwise(0)).drop("hot_key")
    flagged = table.join(marks, F.col(key) == F.col("hot_key"), "left")
    copies = F.when(F.col("hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = flagged.withColumn("salt", F.explode(copies)).drop("hot_key")
    joined = salted.join(repeated, [key, "salt"], "left").drop("salt")
    return joined.unionByName(df.filter(F.col(key).isNull()), allowMissingColumns=True)
