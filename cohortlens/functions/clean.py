"""SQL expressions for raw survey values.

They are text so that a step of many columns reaches Spark as one projection.
"""

from __future__ import annotations

import re

from cohortlens import schema


def snake_case(name: str) -> str:
    """Header to identifier: every run of other characters becomes one underscore."""
    words = re.findall(r"[0-9a-zA-Z]+", name)
    return "_".join(words).lower()


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def coded(column: str, codes: dict[str, int], allow_numeric: bool = False) -> str:
    """Text code to INT, any case; unknown text is NULL or, on request, read as a number."""
    whens = " ".join(
        f"WHEN upper(`{column}`) IN ({quoted(k for k, v in codes.items() if v == value)}) THEN {value}"
        for value in sorted(set(codes.values()), reverse=True)
    )
    other = f" ELSE try_cast(`{column}` AS INT)" if allow_numeric else ""
    return f"CASE {whens}{other} END"


def number(column: str, kind: str = "double") -> str:
    """Text to number; anything unreadable is NULL."""
    return f"try_cast(`{column}` AS {kind})"


def pressure_parts(column: str, patterns: tuple = schema.PRESSURE) -> tuple[str, str, str]:
    """(systolic, diastolic, ok) from one (pattern, group) pair each."""
    systolic, diastolic = (
        f"try_cast(nullif(regexp_extract(`{column}`, r'{pattern}', {group}), '') AS BIGINT)"
        for pattern, group in patterns
    )
    return systolic, diastolic, f"int({systolic} IS NOT NULL AND {diastolic} IS NOT NULL)"


def band(column: str, bands: tuple, null_band: str = "null") -> str:
    """Label by exclusive upper cuts. A NULL input gives NULL or the last band."""
    if null_band not in ("null", "last"):
        raise ValueError("null_band must be 'null' or 'last'")
    cuts, last = bands
    whens = " ".join(f"WHEN `{column}` < {upper} THEN '{label}'" for upper, label in cuts)
    if null_band == "last":
        return f"CASE {whens} ELSE '{last}' END"
    return f"CASE {whens} WHEN `{column}` IS NOT NULL THEN '{last}' END"


def total(terms: list[str], nulls: str = "zero") -> str:
    """Row-wise sum; a NULL counts as zero or makes the sum NULL."""
    if nulls not in ("zero", "null"):
        raise ValueError("nulls must be 'zero' or 'null'")
    return " + ".join(f"coalesce({t}, 0)" if nulls == "zero" else t for t in terms)
