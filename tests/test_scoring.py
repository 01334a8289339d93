from __future__ import annotations

import json

import pytest

from cohortlens import schema
from cohortlens.models import artefacts
from cohortlens.operators import scoring
from cohortlens.plans import assess_job, training
from cohortlens.plans.survey import survey
from cohortlens.sources import audit


def requests(spark, rows):
    text = ", ".join(
        f"{c} {'double' if c in ('sleep_duration', 'average_screen_time') else 'int'}"
        for c in schema.REQUEST_RANGES
    )
    full = [(f"r{i}", *[row.get(c) for c in schema.REQUEST_RANGES]) for i, row in enumerate(rows)]
    return spark.createDataFrame(full, f"request_id string, {text}").selectExpr(
        "*", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS timestamp"
    )


SF_DIR = "/root/testdata/sf0.001"
A = {"age": 30, "average_screen_time": 8.5, "sleep_quality": 3, "sleep_duration": 6.5, "stress_level": 4}
B = {
    "age": 30, "average_screen_time": 8.5, "sleep_quality": 3, "discomfort_eyestrain": 1,
    "redness_in_eye": 1, "itchiness_irritation_in_eye": 0,
}


def test_known_requests(spark):
    rows = [A, B, {"average_screen_time": 8.0}, {}, {**A, "sleep_duration": 7.5, "average_screen_time": 8.0}]
    got = {r["request_id"]: r for r in scoring.assess(requests(spark, rows)).collect()}
    a, b, few, none, plain = (got[f"r{i}"] for i in range(5))
    assert (a["mode_used"], a["risk_score"], a["risk_level"], a["confidence"]) == (schema.MODE_A, 70.0, "High", "High")
    assert a["trigger_symptom"] and a["missing_fields"] == []
    assert a["ask_for_more_info"] == schema.REQUEST_SYMPTOMS
    assert [f["feature"] for f in a["top_factors"]] == [
        "average_screen_time", "sleep_quality", "stress_level", "sleep_duration"
    ]
    assert (b["mode_used"], b["risk_score"], b["confidence"]) == (schema.MODE_B, 75.0, "Medium")
    assert b["missing_fields"] == ["sleep_duration", "stress_level"] and b["urgency"] == "visit_recommended"
    assert b["top_factors"][0]["note"] == "symptoms_reported:2"
    assert (few["risk_score"], few["risk_level"], few["confidence"]) == (30.0, "Low", "Low")
    assert (none["risk_score"], none["risk_level"], none["mode_used"]) == (0.0, "Low", schema.MODE_A)
    assert (plain["risk_score"], plain["risk_level"], plain["trigger_symptom"]) == (60.0, "Medium", False)
    compat = scoring.assess(requests(spark, [B]), reference_compat=True).first()
    assert compat["risk_score"] == 60.0


def test_model_probability_wins_unless_null(spark):
    df = requests(spark, [A, A]).selectExpr("*", "CASE request_id WHEN 'r0' THEN 0.2D END AS p")
    got = {r["request_id"]: r["risk_score"] for r in scoring.route(df, model_probability="p").collect()}
    assert got == {"r0": 20.0, "r1": 70.0}


def test_validation_splits_rows(spark):
    good, bad = scoring.split_requests(requests(spark, [A, {**A, "age": 17, "gender": 2}, {}]))
    assert {r["request_id"] for r in good.collect()} == {"r0", "r2"}
    assert bad.first()["failed_fields"] == ["age", "gender"]


def test_response_always_has_disclaimers_and_one_mode(spark, tmp_path):
    response = scoring.respond(scoring.assess(requests(spark, [A, B, {}])))
    for row in map(json.loads, response.toJSON().collect()):
        assert row["disclaimers"] and row["model_version"] == schema.FALLBACK_VERSION
        assert ("screening" in row) != ("triage" in row)
    for _ in range(2):
        audit.append(scoring.audit_rows(response), f"{tmp_path}/audit")
    stored = audit.read(spark, f"{tmp_path}/audit")
    assert stored.count() == 6
    personal = set(schema.REQUEST_RANGES) & set(stored.columns)
    assert not personal


def test_scoring_is_narrow(spark):
    plan = scoring.assess(requests(spark, [A]))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Python" not in plan


def test_title_and_actions_follow_from_the_row(spark):
    rows = scoring.assess(requests(spark, [A, {}])).select("stage", "risk_level", "title", "actions", "top_factors", "ask_for_more_info").collect()
    for r in rows:
        assert r["title"] == f"stage_{r['stage']}_{r['risk_level']}".lower()
        about = [f"discuss_{f['feature']}" for f in r["top_factors"]]
        assert r["actions"] == about + ["complete_answers"] * bool(r["ask_for_more_info"])


def test_codes_are_neutral_names():
    codes = [urgency for _, _, urgency, *_ in scoring.NEXT_STEPS]
    codes += [c for listed in scoring.DISCLAIMERS.values() for c in listed]
    assert all(c.replace("_", "").isalpha() and c == c.lower() for c in codes)


def test_features_fill_zero(spark):
    row = scoring.to_features(requests(spark, [{"height": 180, "weight": 81}, {}])).collect()
    assert row[0]["bmi"] == pytest.approx(25.0) and row[1]["bmi"] == 0.0
    assert row[0]["blue_light_filter"] == 0.0


def test_artefact_round_trip_and_fallback(spark, tmp_path):
    """A stage with a registered model is scored by it, the other by rule; nothing is joined."""
    data = survey(spark, SF_DIR)
    training.train_version(data, f"{tmp_path}/reg", f"{tmp_path}/art", "v7", ("B",), maxIter=3, maxDepth=2)
    models = assess_job.registered_models(spark, f"{tmp_path}/reg")
    assert set(models) == {"B"} and models["B"][1].version == "v7" and set(models["B"][1].medians) >= {"age", "bmi"}
    scored = assess_job.score_requests(data, models)
    sources = {(r["mode_used"], r["score_source"]) for r in scored.select("mode_used", "score_source").distinct().collect()}
    assert sources == {(schema.MODE_A, "rule"), (schema.MODE_B, "model")}
    model, fitted = models["B"]
    rows = scoring.to_features(assess_job.to_requests(data.limit(50)), fill=False)
    again = artefacts.probability(rows, model, fitted, "p").select("row_id", "p").collect()
    assert all(0 < r["p"] < 1 for r in again)
    stored = assess_job.run(data, f"{tmp_path}/audit", f"{tmp_path}/reg")
    assert {r["model_version"] for r in stored.select("model_version").distinct().collect()} == {"v7"}
    assert audit.read(spark, f"{tmp_path}/audit").count() == stored.count() == data.count()
