"""Survey rows as assessment requests, and the batch job that scores them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens import schema
from cohortlens.functions import risk
from cohortlens.functions.project import with_exprs
from cohortlens.models import artefacts
from cohortlens.operators import scoring
from cohortlens.session import materialize
from cohortlens.sources import audit, registry

FEATURE_TO_REQUEST = {v: k for k, v in schema.REQUEST_TO_FEATURE.items()}
# Every second record takes the screening path, which ignores symptoms.
SCREENING_PATH = "row_id % 2 = 0"


def to_requests(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Request columns with a 12-character id and a time taken from the key."""
    renamed = df.withColumnsRenamed({k: v for k, v in FEATURE_TO_REQUEST.items() if k in df.columns})
    wanted = [c for c in schema.REQUEST_RANGES if c in renamed.columns]
    return renamed.selectExpr(
        key,
        f"substr(md5(CAST({key} AS STRING)), 1, 12) AS request_id",
        f"TIMESTAMP_NTZ'2024-01-01 00:00:00' + {key} * INTERVAL '1' MINUTE AS timestamp",
        *wanted,
    )


def registered_models(spark: SparkSession, registry_path: str) -> dict:
    """(model, fitted) per stage of the newest registered version; stages without an artefact are left out."""
    newest = registry.latest(registry.read(spark, registry_path)).collect()  # one row per stage
    return {r["stage"]: artefacts.load(spark, r["artifact_path"]) for r in newest if r["artifact_path"]}


def with_probability(requests: DataFrame, models: dict) -> DataFrame:
    """Add ``model_probability``: that of the request's stage, NULL where the stage has no model.

    One projection over the requests; they are not joined to anything.
    """
    whole = requests.selectExpr("struct(*) AS request", "*")
    rows = scoring.to_features(whole, fill=False)
    for stage, (model, fitted) in sorted(models.items()):
        rows = artefacts.probability(rows, model, fitted, f"probability_{stage}")
    stage = f"CASE WHEN {risk.has_symptoms('request.')} THEN 'B' ELSE 'A' END"
    parts = " ".join(f"WHEN '{s}' THEN probability_{s}" for s in sorted(models))
    chosen = f"CASE {stage} {parts} END" if models else "CAST(NULL AS DOUBLE)"
    return rows.selectExpr("request.*", f"{chosen} AS model_probability")


def score_requests(df: DataFrame, models: dict | None = None, **options) -> DataFrame:
    """Requests scored by their stage's model where there is one, else by rule."""
    routed = scoring.blank_symptoms(to_requests(df), SCREENING_PATH)
    if models:
        routed, options = with_probability(routed, models), {**options, "model_probability": "model_probability"}
    return scoring.assess(routed, **options)


def run(df: DataFrame, audit_path: str, registry_path: str | None = None, **options) -> DataFrame:
    """Score, write the responses once, append the audit rows, return the stored responses."""
    models = registered_models(df.sparkSession, registry_path) if registry_path else {}
    versions = {fitted.version for _, fitted in models.values()}
    version = {"model_version": versions.pop()} if versions else {}
    response = materialize(scoring.respond(score_requests(df, models, **options), **version))
    audit.append(scoring.audit_rows(response), audit_path)
    return response


def flat_response(response: DataFrame) -> DataFrame:
    """The response after a trip through JSON, with its nested fields laid out flat."""
    shape = response.drop("timestamp").schema
    text = response.selectExpr("to_json(struct(*)) AS body")
    parsed = text.selectExpr(f"from_json(body, '{shape.simpleString()}') AS r")
    return with_exprs(
        parsed,
        {
            "request_id": "r.request_id",
            "mode_used": "r.mode_used",
            "model_version": "r.model_version",
            "risk_score": "r.risk_score",
            "risk_level": "r.risk_level",
            "confidence": "r.confidence",
            "risk_a": "r.screening.risk_A",
            "trigger_symptom": "r.screening.trigger_symptom",
            "prob_b": "r.triage.prob_B",
            "triage_level": "r.triage.triage_level",
            "urgency": "r.next_step.urgency",
            "factor_count": "size(r.top_factors)",
            "disclaimer_count": "size(r.disclaimers)",
        },
    ).drop("r")
