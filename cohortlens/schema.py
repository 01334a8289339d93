"""Column groups, rules and tables that the operators take as defaults.

Everything here is a fixed value of the data contract; operators accept other
columns, rules and cuts as parameters.
"""

from __future__ import annotations

# --- fixed values: codes in the raw survey ---------------------------------
BINARY_CODES = {"Y": 1, "N": 0, "YES": 1, "NO": 0, "TRUE": 1, "FALSE": 0}
GENDER_CODES = {"F": 0, "M": 1}
# (pattern, group) for systolic, then for diastolic
PRESSURE = ((r"(\d+)\s*[/-]\s*(\d+)", 1), (r"(\d+)\s*[/-]\s*(\d+)", 2))
LOOSE_PRESSURE = ((r"(\d{2,3})", 1), (r"\d{2,3}\D+(\d{2,3})", 1))
YES_NO_CODES = {"Y": 1, "N": 0}

# --- fixed values: inclusive valid ranges ----------------------------------
RANGE_RULES = {
    "age": (18, 45),
    "sleep_quality": (1, 5),
    "stress_level": (1, 5),
    "sleep_duration": (0, 24),
    "average_screen_time": (0, 24),
    "heart_rate": (40, 220),
    "daily_steps": (0, 50000),
    "physical_activity": (0, 600),
    "height": (120, 230),
    "weight": (30, 250),
    "systolic": (70, 250),
    "diastolic": (40, 150),
}

# --- fixed values: column groups -------------------------------------------
LABEL = "dry_eye_disease"
SYMPTOMS = ["discomfort_eye_strain", "redness_in_eye", "itchiness_irritation_in_eye"]
BINARY_COLUMNS = [
    "sleep_disorder",
    "wake_up_during_night",
    "feel_sleepy_during_day",
    "caffeine_consumption",
    "alcohol_consumption",
    "smoking",
    "medical_issue",
    "ongoing_medication",
    "smart_device_before_bed",
    "blue_light_filter",
    *SYMPTOMS,
    LABEL,
]
STAGE_A_FEATURES = [
    "sleep_duration",
    "sleep_quality",
    "sleep_disorder",
    "wake_up_during_night",
    "feel_sleepy_during_day",
    "average_screen_time",
    "smart_device_before_bed",
    "blue_light_filter",
    "stress_level",
    "daily_steps",
    "physical_activity",
    "caffeine_consumption",
    "alcohol_consumption",
    "smoking",
    "age",
    "gender",
    "bmi",
    "systolic",
    "diastolic",
    "heart_rate",
    "medical_issue",
    "ongoing_medication",
]
STAGE_B_FEATURES = [*STAGE_A_FEATURES, *SYMPTOMS]
STAGE_A_FORBIDDEN = [*SYMPTOMS, "discomfort_eyestrain", "symptom_score"]

# --- fixed values: upper cut (exclusive) -> band, then the open last band ---
AGE_BANDS = ([(25, "18-24"), (30, "25-29"), (35, "30-34"), (40, "35-39")], "40-45")
SCREEN_BANDS = (
    [(2, "0-2"), (4, "2-4"), (6, "4-6"), (8, "6-8"), (10, "8-10")],
    "10+",
)
SLEEP_BANDS = ([(6, "<6"), (7, "6-7"), (8, "7-8"), (9, "8-9")], "9+")
MERGED_AGE_BANDS = {
    "18-24": "18-29",
    "25-29": "18-29",
    "30-34": "30-39",
    "35-39": "30-39",
    "40-45": "40-45",
}

VALIDITY_BINS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.01]
LOW_N = 10
SEED = 42

# --- fixed values: published KPI names and the tables that hold them -------
KPI_TABLES = {
    "age_gender": "agg_ded_by_age_gender",
    "screen_sleep": "agg_ded_by_screen_sleep",
    "symptom_score": "agg_ded_by_symptom_score",
    "stress_sleepband": "agg_ded_by_stress_sleepband",
    "data_quality_group": "agg_data_quality_by_group",
}
KPI_DIMENSIONS = {
    "age_gender": ["age_band", "gender"],
    "screen_sleep": ["screen_time_band", "sleep_quality"],
    "symptom_score": ["symptom_score"],
    "stress_sleepband": ["stress_level", "sleep_duration_band"],
    "data_quality_group": ["age_band", "gender"],
}

# --- fixed values: request contract ----------------------------------------
REQUEST_RANGES = {
    "age": (18, 45),
    "gender": (0, 1),
    "height": (120, 230),
    "weight": (30, 250),
    "sleep_duration": (0, 24),
    "sleep_quality": (1, 5),
    "sleep_disorder": (0, 1),
    "wake_up_during_night": (0, 1),
    "feel_sleepy_during_day": (0, 1),
    "average_screen_time": (0, 24),
    "smart_device_before_bed": (0, 1),
    "bluelight_filter": (0, 1),
    "stress_level": (1, 5),
    "daily_steps": (0, 50000),
    "physical_activity": (0, 600),
    "caffeine_consumption": (0, 1),
    "alcohol_consumption": (0, 1),
    "smoking": (0, 1),
    "systolic": (70, 250),
    "diastolic": (40, 150),
    "heart_rate": (40, 220),
    "medical_issue": (0, 1),
    "ongoing_medication": (0, 1),
    "discomfort_eyestrain": (0, 1),
    "redness_in_eye": (0, 1),
    "itchiness_irritation_in_eye": (0, 1),
}
REQUEST_SYMPTOMS = ["discomfort_eyestrain", "redness_in_eye", "itchiness_irritation_in_eye"]
REQUEST_TO_FEATURE = {
    "bluelight_filter": "blue_light_filter",
    "discomfort_eyestrain": "discomfort_eye_strain",
}
CRITICAL_FIELDS = ["sleep_quality", "average_screen_time", "sleep_duration", "stress_level"]

# --- fixed values: decision constants --------------------------------------
LEVEL_CUTS = {"A": (40, 69), "B": (35, 69)}
SYMPTOM_TRIGGER = 65
FALLBACK_VERSION = "fallback_rule_v1"
MODE_A = "A_only_screening"
MODE_B = "B_with_symptoms"
