"""Shared SQL text: the raw survey and its standardized form, written for the SQL check."""

from __future__ import annotations

from cohortlens.plans.survey import RAW_SURVEY_SQL

YES = "('Y', 'YES', 'TRUE')"
NO = "('N', 'NO', 'FALSE')"
# --- fixed values: columns, ranges and stage lists of the survey contract ---
BINARY = [
    "sleep_disorder", "wake_up_during_night", "feel_sleepy_during_day", "caffeine_consumption",
    "alcohol_consumption", "smoking", "medical_issue", "ongoing_medication",
    "smart_device_before_bed", "blue_light_filter", "discomfort_eye_strain", "redness_in_eye",
    "itchiness_irritation_in_eye", "dry_eye_disease",
]
RANGES = {
    "age": (18, 45), "sleep_quality": (1, 5), "stress_level": (1, 5), "sleep_duration": (0, 24),
    "average_screen_time": (0, 24), "heart_rate": (40, 220), "daily_steps": (0, 50000),
    "physical_activity": (0, 600), "height": (120, 230), "weight": (30, 250),
    "systolic": (70, 250), "diastolic": (40, 150),
}
STAGE_A = [
    "sleep_duration", "sleep_quality", "sleep_disorder", "wake_up_during_night",
    "feel_sleepy_during_day", "average_screen_time", "smart_device_before_bed",
    "blue_light_filter", "stress_level", "daily_steps", "physical_activity",
    "caffeine_consumption", "alcohol_consumption", "smoking", "age", "gender", "bmi", "systolic",
    "diastolic", "heart_rate", "medical_issue", "ongoing_medication",
]
SYMPTOMS = ["discomfort_eye_strain", "redness_in_eye", "itchiness_irritation_in_eye"]
STAGE_B = STAGE_A + SYMPTOMS

RAW = f"raw AS ({RAW_SURVEY_SQL})"


def yes_no(c: str) -> str:
    return f"CASE WHEN upper({c}) IN {YES} THEN 1 WHEN upper({c}) IN {NO} THEN 0 END"


PARSED = (
    "parsed AS (SELECT row_id, age, sleep_quality, stress_level, sleep_duration, "
    "average_screen_time, heart_rate, daily_steps, physical_activity, height, weight, "
    "blood_pressure, blood_pressure AS blood_pressure_raw, "
    "CASE upper(gender) WHEN 'F' THEN 0 WHEN 'M' THEN 1 END AS gender, "
    + ", ".join(f"{yes_no(c)} AS {c}" for c in BINARY)
    + r", TRY_CAST(nullif(regexp_extract(blood_pressure, '(\d+)\s*[/-]\s*(\d+)', 1), '') AS BIGINT) AS systolic"
    + r", TRY_CAST(nullif(regexp_extract(blood_pressure, '(\d+)\s*[/-]\s*(\d+)', 2), '') AS BIGINT) AS diastolic"
    + r", CASE WHEN regexp_matches(coalesce(blood_pressure, ''), '(\d+)\s*[/-]\s*(\d+)') THEN 1 ELSE 0 END AS bp_parse_ok"
    + " FROM raw)"
)


def ranged_body() -> str:
    flags = ", ".join(
        f"CASE WHEN {c} >= {lo} AND {c} <= {hi} THEN 1 ELSE 0 END AS {c}_in_range"
        for c, (lo, hi) in RANGES.items()
    )
    values = ", ".join(
        f"CASE WHEN {c} >= {lo} AND {c} <= {hi} THEN {c} END AS {c}"
        for c, (lo, hi) in RANGES.items()
    )
    return f"SELECT * REPLACE ({values}), {flags} FROM parsed"


def banding(source: str, cuts: list, last: str, null_band: str) -> str:
    whens = " ".join(f"WHEN {source} < {u} THEN '{b}'" for u, b in cuts)
    end = f"ELSE '{last}'" if null_band == "last" else f"WHEN {source} IS NOT NULL THEN '{last}'"
    return f"CASE {whens} {end} END"


def std_cte(null_band: str = "null", null_symptom: str = "zero") -> str:
    """``raw``, ``parsed``, ``ranged`` and ``std`` as the head of a WITH clause."""
    ratio = " + ".join(f"{c}_in_range" for c in RANGES)
    age = banding("age", [(25, "18-24"), (30, "25-29"), (35, "30-34"), (40, "35-39")], "40-45", null_band)
    screen = banding(
        "average_screen_time", [(2, "0-2"), (4, "2-4"), (6, "4-6"), (8, "6-8"), (10, "8-10")], "10+", null_band
    )
    sleep = banding("sleep_duration", [(6, "<6"), (7, "6-7"), (8, "7-8"), (9, "8-9")], "9+", null_band)
    symptom = " + ".join(c if null_symptom == "null" else f"coalesce({c}, 0)" for c in SYMPTOMS)
    return (
        f"WITH {RAW}, {PARSED}, ranged AS ({ranged_body()}), std AS (SELECT *, "
        f"({ratio}) / 12.0::DOUBLE AS validity_ratio, "
        "weight::DOUBLE / ((height / 100.0::DOUBLE) * (height / 100.0::DOUBLE)) AS bmi, "
        f"{age} AS age_band, {screen} AS screen_time_band, {sleep} AS sleep_duration_band, "
        f"{symptom} AS symptom_score FROM ranged)"
    )


STD = std_cte()
STD_COLUMNS = (
    ["row_id", "age", "sleep_quality", "stress_level", "sleep_duration", "average_screen_time",
     "heart_rate", "daily_steps", "physical_activity", "height", "weight", "blood_pressure",
     "blood_pressure_raw", "gender"]
    + BINARY
    + ["systolic", "diastolic", "bp_parse_ok"]
    + [f"{c}_in_range" for c in RANGES]
    + ["validity_ratio", "bmi", "age_band", "screen_time_band", "sleep_duration_band", "symptom_score"]
)


def on_std(body: str, **options) -> str:
    return f"{std_cte(**options)} {body}"


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)
