"""One projection for many computed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_exprs(df: DataFrame, changed: dict[str, str]) -> DataFrame:
    """Replace or append columns given as SQL text, keeping the column order."""
    if not changed:
        return df
    columns = df.columns
    kept = [f"{changed[c]} AS `{c}`" if c in changed else f"`{c}`" for c in columns]
    have = set(columns)
    added = [f"{text} AS `{c}`" for c, text in changed.items() if c not in have]
    return df.selectExpr(*kept, *added)
