"""Raw survey to standardized table: one lazy plan, no shuffle, no action.

Each step is a single projection over the columns that are present, so the whole
chain collapses into one code-generated stage over the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortlens import schema
from cohortlens.functions import clean
from cohortlens.functions.project import with_exprs


def rename_columns(df: DataFrame) -> DataFrame:
    """snake_case every header; two headers may not meet in one name."""
    names = [clean.snake_case(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"headers collide after renaming: {twice}")
    return df.toDF(*names)


def repair_aliases(df: DataFrame) -> DataFrame:
    """Accept the other spelling of the strain column and keep the raw pressure text."""
    if "discomfort_eyestrain" in df.columns and "discomfort_eye_strain" not in df.columns:
        df = df.withColumnRenamed("discomfort_eyestrain", "discomfort_eye_strain")
    if "blood_pressure" in df.columns:
        df = with_exprs(df, {"blood_pressure_raw": "blood_pressure"})
    return df


def map_codes(
    df: DataFrame,
    binary: list[str] = schema.BINARY_COLUMNS,
    gender: str = "gender",
    codes: dict[str, int] = schema.BINARY_CODES,
    allow_numeric: bool = False,
) -> DataFrame:
    have = set(df.columns)
    changed = {c: clean.coded(c, codes, allow_numeric) for c in binary if c in have}
    if gender in have:
        changed[gender] = clean.coded(gender, schema.GENDER_CODES, allow_numeric)
    return with_exprs(df, changed)


def cast_numbers(df: DataFrame, columns: list[str] | None = None, kind: str = "double") -> DataFrame:
    """Read text columns among the rule columns as numbers."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    wanted = schema.RANGE_RULES if columns is None else columns
    return with_exprs(df, {c: clean.number(c, kind) for c in wanted if c in text})


def parse_pressure(
    df: DataFrame, column: str = "blood_pressure", patterns: tuple = schema.PRESSURE
) -> DataFrame:
    if column in df.columns:
        systolic, diastolic, ok = clean.pressure_parts(column, patterns)
    else:
        systolic = diastolic = "CAST(NULL AS BIGINT)"
        ok = "0"
    return with_exprs(df, {"systolic": systolic, "diastolic": diastolic, "bp_parse_ok": ok})


def validate_ranges(df: DataFrame, rules: dict[str, tuple] = schema.RANGE_RULES) -> DataFrame:
    """Flag, blank and rate: ``<c>_in_range``, NULL outside, ``validity_ratio``."""
    have = set(df.columns)
    inside = {
        c: f"`{c}` BETWEEN {low} AND {high}" for c, (low, high) in rules.items() if c in have
    }
    flags = {f"{c}_in_range": f"CASE WHEN {test} THEN 1 ELSE 0 END" for c, test in inside.items()}
    changed = dict(flags)
    changed.update({c: f"CASE WHEN {test} THEN `{c}` END" for c, test in inside.items()})
    hits = " + ".join(flags.values())
    changed["validity_ratio"] = f"({hits}) / {len(inside)}D" if inside else "1.0D"
    return with_exprs(df, changed)


def derive(df: DataFrame, null_band: str = "null", null_symptom: str = "zero") -> DataFrame:
    """bmi, the three bands and the symptom score, each when its inputs exist."""
    have = set(df.columns)
    changed: dict[str, str] = {}
    if {"weight", "height"} <= have:
        changed["bmi"] = "try_divide(double(weight), (height / 100D) * (height / 100D))"
    for source, name, bands in (
        ("age", "age_band", schema.AGE_BANDS),
        ("average_screen_time", "screen_time_band", schema.SCREEN_BANDS),
        ("sleep_duration", "sleep_duration_band", schema.SLEEP_BANDS),
    ):
        if source in have:
            changed[name] = clean.band(source, bands, null_band)
    symptoms = [c for c in schema.SYMPTOMS if c in have]
    changed["symptom_score"] = (
        clean.total(symptoms, null_symptom) if symptoms else "CAST(NULL AS INT)"
    )
    return with_exprs(df, changed)


def standardize(
    df: DataFrame,
    null_band: str = "null",
    null_symptom: str = "zero",
    allow_numeric: bool = False,
    pressure: tuple = schema.PRESSURE,
) -> DataFrame:
    df = repair_aliases(rename_columns(df))
    df = map_codes(df, allow_numeric=allow_numeric)
    df = parse_pressure(cast_numbers(df), patterns=pressure)
    return derive(validate_ranges(df), null_band, null_symptom)
