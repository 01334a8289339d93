"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), a > b. Only minima are aggregated, never neighbour lists."""
    out = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        out = out.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = out.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = out.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        both = F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))
        moved = joined.select(F.inline(both))
    return moved.filter("a != b").distinct()


def _digest(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    row = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(mixed, 20)).alias("s"), F.bit_xor(mixed).alias("x")).first()
    return row["n"], row["s"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Self-loops and repeated edges have no effect, NULL ends are left out, no edges give no rows.
    """
    ends = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    now = stored(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, after = None, _digest(now)
    while after != before and after[0]:
        now = stored(_star(_star(now, True), False), "edges")
        before, after = after, _digest(now)
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
