"""What a dashboard asks of finished KPI cells: pages, roll-ups, pivots, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.rates import with_rate


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    changed = {c: F.when(~F.isnan(c), F.col(c)) for c in floats}
    return df.withColumns(changed) if changed else df


def page(cells: DataFrame, number: int = 1, size: int = 100) -> tuple[DataFrame, dict]:
    """Rows of one page, ordered from the first column on, and the paging facts."""
    if number < 1:
        raise ValueError("page numbers start at 1")
    if not 1 <= size <= 1000:
        raise ValueError("page size lies between 1 and 1000")
    total = cells.count()
    pages = -(-total // size)
    rows = cells.orderBy(*cells.columns).offset((number - 1) * size).limit(size)
    facts = {
        "page": number,
        "page_size": size,
        "total_rows": total,
        "total_pages": pages,
        "has_next": number < pages,
        "has_prev": number > 1,
    }
    return clean_numbers(rows), facts


def rollup_by(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Re-add n and positives over fewer keys and take the rate again (0 for no rows)."""
    summed = cells.groupBy(*keys).agg(
        F.sum("n").cast("bigint").alias("n"),
        F.sum("positives").cast("bigint").alias("positives"),
    )
    rate = F.coalesce(F.try_divide(F.col("positives"), F.col("n")), F.lit(0.0))
    return summed.withColumn("rate", rate).orderBy(*keys)


def overview(rate_cells: DataFrame, quality_cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row of totals; mean group validity both unweighted and by group size."""
    both = rate_cells.join(quality_cells.drop("n"), keys, "full")
    weighted = F.sum(F.col("avg_validity_ratio") * F.col("n"))
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_n"),
        F.coalesce(F.sum("positives"), F.lit(0)).alias("total_positives"),
        F.coalesce(F.try_divide(F.sum("positives"), F.sum("n")), F.lit(0.0)).alias("overall_rate"),
        F.coalesce(F.avg("avg_validity_ratio"), F.lit(0.0)).alias("avg_validity_unweighted"),
        F.coalesce(F.try_divide(weighted, F.sum("n")), F.lit(0.0)).alias("avg_validity_weighted"),
    )


def top_missing(quality_cells: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    prefix = "missing_rate_"
    fields = [c for c in quality_cells.columns if c.startswith(prefix)]
    long = quality_cells.unpivot([*keys, "n"], fields, "field", "rate")
    named = long.withColumn("field", F.regexp_replace("field", f"^{prefix}", ""))
    order = [F.desc("rate"), F.asc("field"), *[F.asc(c) for c in keys]]
    return named.orderBy(*order).limit(k)


def heatmap(cells: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Row totals and one rate and count column per listed value of the column key."""
    picked = [
        part
        for v in values
        for part in (
            F.max(F.when(F.col(column) == v, F.col("rate"))).alias(f"rate_{v}"),
            F.coalesce(F.max(F.when(F.col(column) == v, F.col("n"))), F.lit(0)).alias(f"n_{v}"),
        )
    ]
    return cells.groupBy(row).agg(F.sum("n").alias("row_n"), *picked).orderBy(row)


def intensity(cells: DataFrame) -> DataFrame:
    """Rate relative to the highest rate; 0 when there is none above 0."""
    top = cells.agg(F.max("rate")).scalar()
    share = F.try_divide(F.col("rate"), top)
    return cells.withColumn("intensity", F.coalesce(share, F.lit(0.0)))


def wide(cells: DataFrame, row: str, column: str, names: dict, measure: str = "rate") -> DataFrame:
    """One row per key with the measure spread over named values of a second key."""
    spread = [
        F.max(F.when(F.col(column) == v, F.col(measure))).alias(name) for v, name in names.items()
    ]
    return cells.groupBy(row).agg(*spread).orderBy(row)


def merge_keys(cells: DataFrame, key: str, mapping: dict[str, str], others=()) -> DataFrame:
    """Replace sparse keys by wider ones and add their cells up."""
    merged = cells.replace(mapping, subset=[key])
    return with_rate(
        merged.groupBy(key, *others).agg(
            F.sum("n").cast("bigint").alias("n"),
            F.sum("positives").cast("bigint").alias("positives"),
        )
    )
