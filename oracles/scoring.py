"""SQL for scoring, audit and the streams."""

from __future__ import annotations

from oracles.base import RANGES, STAGE_B, STD, SYMPTOMS

BINARY_REQUEST = [
    "gender", "sleep_disorder", "wake_up_during_night", "feel_sleepy_during_day",
    "smart_device_before_bed", "blue_light_filter", "caffeine_consumption", "alcohol_consumption",
    "smoking", "medical_issue", "ongoing_medication", *SYMPTOMS,
]
# Contract order of the request fields.
ORDER = [
    "age", "gender", "height", "weight", "sleep_duration", "sleep_quality", "sleep_disorder",
    "wake_up_during_night", "feel_sleepy_during_day", "average_screen_time",
    "smart_device_before_bed", "blue_light_filter", "stress_level", "daily_steps",
    "physical_activity", "caffeine_consumption", "alcohol_consumption", "smoking", "systolic",
    "diastolic", "heart_rate", "medical_issue", "ongoing_medication", *SYMPTOMS,
]
OUTSIDE = {"blue_light_filter": "bluelight_filter", "discomfort_eye_strain": "discomfort_eyestrain"}
FAILED = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {c} < {RANGES.get(c, (0, 1))[0]} OR {c} > {RANGES.get(c, (0, 1))[1]} THEN '{OUTSIDE.get(c, c)}' END"
    for c in ORDER
) + ")"

BLANK = ", ".join(f"CASE WHEN row_id % 2 <> 0 THEN {s} END AS {s}" for s in SYMPTOMS)
REQ = f"{STD}, req AS (SELECT * REPLACE ({BLANK}) FROM std)"
COUNT = " + ".join(f"(CASE WHEN {s} = 1 THEN 1 ELSE 0 END)" for s in SYMPTOMS)
SCORED = f"""{REQ}, pts AS (SELECT *,
  CASE WHEN average_screen_time >= 8 THEN 30 WHEN average_screen_time >= 6 THEN 20 WHEN average_screen_time >= 4 THEN 10 ELSE 0 END
  + CASE WHEN sleep_quality <= 2 THEN 25 WHEN sleep_quality <= 3 THEN 15 ELSE 0 END
  + CASE WHEN sleep_duration < 6 THEN 15 WHEN sleep_duration < 7 THEN 10 ELSE 0 END
  + CASE WHEN stress_level >= 4 THEN 15 WHEN stress_level >= 3 THEN 10 ELSE 0 END
  + CASE WHEN smart_device_before_bed = 1 THEN 10 ELSE 0 END AS base, {COUNT} AS symptoms,
  CASE WHEN discomfort_eye_strain IS NULL AND redness_in_eye IS NULL AND itchiness_irritation_in_eye IS NULL THEN 'A' ELSE 'B' END AS stage
  FROM req), scored AS (SELECT *,
  CAST(least(100, base) AS DOUBLE) AS score_a, CAST(least(100, least(100, base) + 15 * symptoms) AS DOUBLE) AS score_b,
  CAST(least(100, least(100, base) + 15 * (symptoms - CASE WHEN discomfort_eye_strain = 1 THEN 1 ELSE 0 END)) AS DOUBLE) AS score_b_compat
  FROM pts), routed AS (SELECT *, CASE stage WHEN 'A' THEN score_a ELSE score_b END AS risk_score,
  CASE stage WHEN 'A' THEN 'A_only_screening' ELSE 'B_with_symptoms' END AS mode_used FROM scored),
  levelled AS (SELECT *, CASE WHEN risk_score < CASE stage WHEN 'A' THEN 40 ELSE 35 END THEN 'Low' WHEN risk_score < 69 THEN 'Medium' ELSE 'High' END AS risk_level,
  CASE WHEN stage = 'A' THEN risk_score >= 65 END AS trigger_symptom,
  list_filter([CASE WHEN sleep_quality IS NULL THEN 'sleep_quality' END, CASE WHEN average_screen_time IS NULL THEN 'average_screen_time' END,
    CASE WHEN sleep_duration IS NULL THEN 'sleep_duration' END, CASE WHEN stress_level IS NULL THEN 'stress_level' END,
    CASE WHEN stage = 'B' AND discomfort_eye_strain IS NULL THEN 'discomfort_eyestrain' END,
    CASE WHEN stage = 'B' AND redness_in_eye IS NULL THEN 'redness_in_eye' END,
    CASE WHEN stage = 'B' AND itchiness_irritation_in_eye IS NULL THEN 'itchiness_irritation_in_eye' END], lambda x: x IS NOT NULL) AS missing
  FROM routed), full_rows AS (SELECT *,
  CASE WHEN len(missing) / CASE stage WHEN 'A' THEN 4.0 ELSE 7.0 END <= 0.1 THEN 'High' WHEN len(missing) / CASE stage WHEN 'A' THEN 4.0 ELSE 7.0 END <= 0.3 THEN 'Medium' ELSE 'Low' END AS confidence,
  substr(md5(CAST(row_id AS VARCHAR)), 1, 12) AS request_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(row_id) AS timestamp FROM levelled)"""

FACTORS = (
    "concat_ws(',', CASE WHEN stage = 'B' AND symptoms > 0 THEN 'symptom_score:High:symptoms_reported:' || symptoms END, "
    "CASE WHEN average_screen_time >= 6 THEN 'average_screen_time:High:screen_time_high' END, "
    "CASE WHEN sleep_quality <= 3 THEN 'sleep_quality:High:sleep_quality_low' END, "
    "CASE WHEN stress_level >= 4 THEN 'stress_level:Medium:stress_high' END, "
    "CASE WHEN sleep_duration < 7 THEN 'sleep_duration:Medium:sleep_short' END)"
)
FACTOR_COUNT = (
    "(CASE WHEN stage = 'B' AND symptoms > 0 THEN 1 ELSE 0 END + CASE WHEN average_screen_time >= 6 THEN 1 ELSE 0 END "
    "+ CASE WHEN sleep_quality <= 3 THEN 1 ELSE 0 END + CASE WHEN stress_level >= 4 THEN 1 ELSE 0 END "
    "+ CASE WHEN sleep_duration < 7 THEN 1 ELSE 0 END)"
)
URGENCY = (
    "CASE WHEN risk_level = 'Low' THEN 'monitor' WHEN risk_level = 'High' AND stage = 'B' THEN 'visit_recommended' ELSE 'consider_visit' END"
)
TITLE = "lower('stage_' || stage || '_' || risk_level)"
THREE = "['discomfort_eyestrain', 'redness_in_eye', 'itchiness_irritation_in_eye']"
ASK = (
    "array_to_string(CASE stage || risk_level WHEN 'ALow' THEN missing[1:3] "
    f"WHEN 'AMedium' THEN CASE WHEN trigger_symptom THEN list_concat(missing[1:3], {THREE}) ELSE missing[1:3] END "
    f"WHEN 'AHigh' THEN list_concat({THREE}, missing[1:2]) "
    "WHEN 'BLow' THEN missing[1:2] WHEN 'BMedium' THEN missing[1:2] ELSE [] END, ',')"
)
ACTIONS = (
    "array_to_string(list_filter([CASE WHEN stage = 'B' AND symptoms > 0 THEN 'discuss_symptom_score' END, "
    "CASE WHEN average_screen_time >= 6 THEN 'discuss_average_screen_time' END, CASE WHEN sleep_quality <= 3 THEN 'discuss_sleep_quality' END, "
    "CASE WHEN stress_level >= 4 THEN 'discuss_stress_level' END, CASE WHEN sleep_duration < 7 THEN 'discuss_sleep_duration' END, "
    f"CASE WHEN {ASK} <> '' THEN 'complete_answers' END], lambda x: x IS NOT NULL), ',')"
)
AUDIT = (
    f"{SCORED} SELECT request_id, timestamp, mode_used, 'fallback_rule_v1' AS model_version, risk_score, risk_level, confidence, "
    "CAST(len(missing) AS INTEGER) AS missing_fields_count, trigger_symptom, "
    "CASE WHEN stage = 'B' THEN risk_level END AS triage_level FROM full_rows"
)

ORACLES = {
    "request_validation": f"{STD}, f AS (SELECT row_id, {FAILED} AS failed FROM parsed) SELECT row_id, failed = '' AS valid, failed FROM f",
    "request_features": f"{REQ} SELECT row_id, " + ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0) AS {c}" for c in STAGE_B) + " FROM req",
    "score_stage_a": f"{SCORED} SELECT row_id, score_a, score_a / 100.0::DOUBLE AS prob_a FROM scored",
    "score_stage_b": f"{SCORED} SELECT row_id, score_b, score_b_compat FROM scored",
    "route_and_score": f"{SCORED} SELECT row_id, mode_used, risk_score, risk_level, trigger_symptom FROM levelled",
    "missing_fields": f"{SCORED} SELECT row_id, array_to_string(missing, ',') AS missing, confidence FROM full_rows",
    "top_factors": f"{SCORED} SELECT row_id, {FACTORS} AS factors FROM full_rows",
    "next_step": f"{SCORED} SELECT row_id, {TITLE} AS title, {URGENCY} AS urgency, {ASK} AS ask, {ACTIONS} AS action_list FROM full_rows",
    "assessment_response": f"{SCORED} SELECT request_id, mode_used, 'fallback_rule_v1' AS model_version, risk_score, risk_level, confidence, "
    "CASE WHEN stage = 'A' THEN risk_score / 100.0::DOUBLE * 100.0::DOUBLE END AS risk_a, trigger_symptom, "
    "CASE WHEN stage = 'B' THEN risk_score / 100.0::DOUBLE END AS prob_b, CASE WHEN stage = 'B' THEN risk_level END AS triage_level, "
    f"{URGENCY} AS urgency, CAST({FACTOR_COUNT} AS INTEGER) AS factor_count, 3 AS disclaimer_count FROM full_rows",
    "score_model": f"{SCORED} SELECT row_id, mode_used, CASE stage WHEN 'A' THEN 'rule' ELSE 'model' END AS score_source, "
    "CASE WHEN stage = 'A' THEN risk_score END AS rule_score, CASE WHEN stage = 'A' THEN risk_level END AS rule_level, TRUE AS in_range FROM levelled",
    "audit_log": AUDIT,
    "stream_scoring": AUDIT,
    "stream_audit_monitor": f"{SCORED}, w AS (SELECT time_bucket(INTERVAL 6 HOUR, timestamp) AS start, mode_used, COUNT(*) AS n, "
    "COUNT(CASE WHEN risk_level = 'High' THEN 1 END) AS high, AVG(CASE WHEN risk_level = 'High' THEN 1.0::DOUBLE ELSE 0.0 END) AS high_rate, "
    "AVG(CASE WHEN len(missing) > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS incomplete_rate FROM full_rows GROUP BY 1, 2) "
    "SELECT start, start + INTERVAL 6 HOUR AS \"end\", mode_used, n, high, high_rate, incomplete_rate FROM w "
    "WHERE start + INTERVAL 6 HOUR <= (SELECT MAX(timestamp) FROM full_rows) - INTERVAL 1 HOUR",
    "stream_monitor_final": "SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, COUNT(*) AS n, "
    "COUNT(CASE WHEN value IS NULL THEN 1 END) AS missing, AVG(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0 END) AS high_rate FROM events GROUP BY ALL",
    "stream_monitor": "WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, COUNT(*) AS n, "
    "COUNT(CASE WHEN value IS NULL THEN 1 END) AS missing, AVG(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0 END) AS high_rate "
    "FROM events GROUP BY 1, 2) "
    "SELECT start, start + INTERVAL 1 DAY AS \"end\", event_type, n, missing, high_rate FROM w "
    "WHERE start + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', MAX(ts)) FROM events) - INTERVAL 1 HOUR",
}
