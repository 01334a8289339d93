"""Feature sets as tables of name -> (inputs, SQL expression).

A feature is added when all its inputs exist; the whole set becomes one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlens.functions.project import with_exprs

SYMPTOMS = ("discomfort_eye_strain", "redness_in_eye", "itchiness_irritation_in_eye")


def _flag(test: str) -> str:
    """A NULL comparison counts as 0."""
    return f"int(coalesce({test}, false))"


def _pow(c: str, n: int) -> str:
    return " * ".join([c] * n)


# --- fixed values: feature formulas ----------------------------------------
PRESSURE_SET = {
    "map": (("systolic", "diastolic"), "(systolic + 2 * diastolic) / 3D"),
    "pulse_pressure": (("systolic", "diastolic"), "systolic - diastolic"),
}
BASE = {
    "screen_sleep_interaction": (("average_screen_time", "sleep_duration"), "average_screen_time * sleep_duration"),
    "stress_sleep_quality": (("stress_level", "sleep_quality"), "stress_level * sleep_quality"),
    "bmi_age": (("bmi", "age"), "bmi * age"),
    "screen_to_sleep_ratio": (("average_screen_time", "sleep_duration"), "try_divide(average_screen_time, sleep_duration + 1)"),
    "steps_per_hour": (("daily_steps",), "daily_steps / 24D"),
    "screen_time_squared": (("average_screen_time",), "average_screen_time * average_screen_time"),
    "sleep_quality_squared": (("sleep_quality",), "sleep_quality * sleep_quality"),
    "stress_level_squared": (("stress_level",), "stress_level * stress_level"),
    "age_screen_interaction": (("age", "average_screen_time"), "age * average_screen_time"),
}
MEDICAL = {
    "digital_eye_strain": (("average_screen_time", "stress_level"), "average_screen_time * stress_level"),
    "unprotected_screen_exposure": (("average_screen_time", "blue_light_filter"), "average_screen_time * (1 - blue_light_filter)"),
    **PRESSURE_SET,
    "hypertension_risk": (("systolic", "diastolic"), "int(coalesce(systolic >= 130, false) OR coalesce(diastolic >= 80, false))"),
    "bmi_squared": (("bmi",), "bmi * bmi"),
    "obesity_flag": (("bmi",), _flag("bmi >= 30")),
    "overweight_flag": (("bmi",), _flag("bmi >= 25 AND bmi < 30")),
    "recovery_score": (("sleep_duration", "sleep_quality"), "sleep_duration * sleep_quality"),
    "sleep_efficiency": (("sleep_duration", "sleep_quality"), "try_divide(sleep_quality, sleep_duration + 1)"),
    "sleep_disruption": (("wake_up_during_night", "feel_sleepy_during_day"), "wake_up_during_night + feel_sleepy_during_day"),
    "substance_risk": (("caffeine_consumption", "alcohol_consumption", "smoking"), "caffeine_consumption + alcohol_consumption * 1.5D + smoking * 2"),
    "activity_composite": (("physical_activity", "daily_steps"), "physical_activity * log1p(daily_steps)"),
    "sedentary_flag": (("physical_activity", "daily_steps"), "int(coalesce(physical_activity < 30, false) OR coalesce(daily_steps < 5000, false))"),
    "age_squared": (("age",), "age * age"),
    "age_risk_65plus": (("age",), _flag("age >= 65")),
    "age_screen_interaction": (("age", "average_screen_time"), "age * average_screen_time"),
    "age_bmi_interaction": (("age", "bmi"), "age * bmi"),
    "medical_burden": (("medical_issue", "ongoing_medication"), "medical_issue + ongoing_medication"),
    "circadian_disruption": (("smart_device_before_bed", "sleep_quality"), "smart_device_before_bed * (10 - sleep_quality)"),
}
WEIGHTED_SYMPTOMS = "discomfort_eye_strain * 2 + redness_in_eye + itchiness_irritation_in_eye"
MEDICAL_B = {
    "symptom_severity": (SYMPTOMS, WEIGHTED_SYMPTOMS),
    "symptom_screen_interaction": ((*SYMPTOMS, "average_screen_time"), f"({WEIGHTED_SYMPTOMS}) * average_screen_time"),
}
SYMPTOM_SUM = " + ".join(f"coalesce({c}, 0)" for c in SYMPTOMS)
SAFE = {
    **PRESSURE_SET,
    "bmi_squared": (("bmi",), "bmi * bmi"),
    "screen_stress": (("average_screen_time", "stress_level"), "average_screen_time * stress_level"),
    "recovery": (("sleep_duration", "sleep_quality"), "sleep_duration * sleep_quality"),
    "symptom_total": (SYMPTOMS, SYMPTOM_SUM),
}
QUICK = {
    "digital_strain": (("average_screen_time", "stress_level"), "average_screen_time * stress_level"),
    **PRESSURE_SET,
    "recovery_score": (("sleep_duration", "sleep_quality"), "sleep_duration * sleep_quality"),
    "bmi_squared": (("bmi",), "bmi * bmi"),
    "obesity": (("bmi",), _flag("bmi >= 30")),
    "age_squared": (("age",), "age * age"),
    "age_screen": (("age", "average_screen_time"), "age * average_screen_time"),
}
QUICK_B = {"symptom_total": (SYMPTOMS, WEIGHTED_SYMPTOMS)}
CURVED = ["age", "bmi", "average_screen_time", "stress_level", "sleep_quality"]
PAIRS = [
    ("age", "bmi"), ("age", "average_screen_time"), ("age", "stress_level"),
    ("bmi", "physical_activity"), ("bmi", "daily_steps"),
    ("average_screen_time", "stress_level"), ("average_screen_time", "sleep_quality"),
    ("sleep_duration", "sleep_quality"), ("sleep_duration", "stress_level"),
    ("systolic", "diastolic"), ("systolic", "age"), ("systolic", "bmi"),
    ("caffeine_consumption", "stress_level"), ("smoking", "age"),
    ("physical_activity", "heart_rate"), ("daily_steps", "age"),
]
SYMPTOM_PARTNERS = ["average_screen_time", "stress_level", "age", "sleep_quality"]


def wide_set() -> dict:
    out: dict = {}
    for c in CURVED:
        out[f"{c}_squared"] = ((c,), _pow(c, 2))
        out[f"{c}_cubed"] = ((c,), _pow(c, 3))
        out[f"{c}_sqrt"] = ((c,), f"sqrt(abs({c}))")
        out[f"{c}_log"] = ((c,), f"log1p(abs({c}))")
    screen_sleep = ("average_screen_time", "sleep_duration")
    out["screen_sleep_ratio"] = (screen_sleep, "try_divide(average_screen_time, sleep_duration + 0.1D)")
    out["sleep_screen_ratio"] = (screen_sleep, "try_divide(sleep_duration, average_screen_time + 0.1D)")
    out["bp_ratio"] = (("systolic", "diastolic"), "try_divide(double(systolic), diastolic + 1)")
    out.update(PRESSURE_SET)
    out["activity_ratio"] = (("daily_steps", "physical_activity"), "try_divide(double(physical_activity), daily_steps / 1000D + 0.1D)")
    for a, b in PAIRS:
        out[f"{a}_x_{b}"] = ((a, b), f"{a} * {b}")
        out[f"{a}_plus_{b}"] = ((a, b), f"{a} + {b}")
        out[f"{a}_minus_{b}"] = ((a, b), f"{a} - {b}")
    known = " + ".join(f"int({c} IS NOT NULL)" for c in SYMPTOMS)
    mean = f"try_divide(double({SYMPTOM_SUM}), double({known}))"
    spread = " + ".join(f"coalesce(({c} - {mean}) * ({c} - {mean}), 0D)" for c in SYMPTOMS)
    out["symptom_sum"] = (SYMPTOMS, SYMPTOM_SUM)
    out["symptom_mean"] = (SYMPTOMS, mean)
    out["symptom_max"] = (SYMPTOMS, f"greatest({', '.join(SYMPTOMS)})")
    out["symptom_std"] = (SYMPTOMS, f"coalesce(sqrt(try_divide({spread}, double({known} - 1))), 0D)")
    for c in SYMPTOM_PARTNERS:
        out[f"symptom_sum_x_{c}"] = ((*SYMPTOMS, c), f"({SYMPTOM_SUM}) * {c}")
    out["age_bin_young"] = (("age",), _flag("age < 30"))
    out["age_bin_middle"] = (("age",), _flag("age >= 30 AND age < 50"))
    out["age_bin_senior"] = (("age",), _flag("age >= 50"))
    out["bmi_underweight"] = (("bmi",), _flag("bmi < 18.5D"))
    out["bmi_normal"] = (("bmi",), _flag("bmi >= 18.5D AND bmi < 25"))
    out["bmi_overweight"] = (("bmi",), _flag("bmi >= 25 AND bmi < 30"))
    out["bmi_obese"] = (("bmi",), _flag("bmi >= 30"))
    out["substance_total"] = (("caffeine_consumption", "alcohol_consumption", "smoking"), "caffeine_consumption + alcohol_consumption * 2 + smoking * 3")
    out["medical_burden"] = (("medical_issue", "ongoing_medication"), "medical_issue + ongoing_medication")
    out["sleep_composite"] = (
        ("sleep_duration", "sleep_quality", "wake_up_during_night", "feel_sleepy_during_day"),
        "sleep_duration * sleep_quality - wake_up_during_night * 2 - feel_sleepy_during_day",
    )
    return out


def feature_set(name: str, stage: str = "B") -> dict:
    if name == "base":
        return BASE
    if name == "medical":
        return {**MEDICAL, **MEDICAL_B} if stage == "B" else MEDICAL
    if name == "safe":
        return SAFE if stage == "B" else {k: v for k, v in SAFE.items() if k != "symptom_total"}
    if name == "quick":
        return {**QUICK, **QUICK_B} if stage == "B" else QUICK
    if name == "wide":
        full = wide_set()
        if stage == "B":
            return full
        return {k: v for k, v in full.items() if not set(v[0]) & set(SYMPTOMS)}
    raise KeyError(f"unknown feature set {name!r}")


def add_features(df: DataFrame, name: str, stage: str = "B") -> DataFrame:
    have = set(df.columns)
    usable = {n: text for n, (inputs, text) in feature_set(name, stage).items() if set(inputs) <= have}
    return with_exprs(df, usable)


def feature_names(df: DataFrame, name: str, stage: str = "B") -> list[str]:
    have = set(df.columns)
    return [n for n, (inputs, _) in feature_set(name, stage).items() if set(inputs) <= have]
