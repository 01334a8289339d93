"""Two-stage risk scoring of request records as column expressions.

Everything is a projection, so the same code runs over a batch or a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schema
from cohortlens.functions import risk
from cohortlens.functions.project import with_exprs

# --- fixed values: urgency and questions per stage and level ---------------
# stage, level, urgency, missing fields to ask, symptoms to ask
NEXT_STEPS = [
    ("A", "Low", "monitor", 3, "never"),
    ("A", "Medium", "consider_visit", 3, "if_triggered"),
    ("A", "High", "consider_visit", 2, "first"),
    ("B", "Low", "monitor", 2, "never"),
    ("B", "Medium", "consider_visit", 2, "never"),
    ("B", "High", "visit_recommended", 0, "never"),
]
# What a response must carry besides its score: codes, worded by whoever shows them.
DISCLAIMERS = {
    "A": ["diagnosis_notice", "care_notice", "screening_notice"],
    "B": ["diagnosis_notice", "care_notice", "triage_notice"],
}


def request_ranges_check(df: DataFrame, rules: dict = schema.REQUEST_RANGES) -> DataFrame:
    """Add ``failed_fields`` and ``valid``; NULL is allowed everywhere."""
    have = set(df.columns)
    tests = ", ".join(
        f"CASE WHEN NOT `{c}` BETWEEN {low} AND {high} THEN '{c}' END"
        for c, (low, high) in rules.items()
        if c in have
    )
    checked = with_exprs(df, {"failed_fields": f"array_compact(array({tests}))"})
    return with_exprs(checked, {"valid": "size(failed_fields) = 0"})


def split_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = request_ranges_check(df)
    return (
        checked.filter("valid").drop("valid", "failed_fields"),
        checked.filter("NOT valid").drop("valid"),
    )


def to_features(df: DataFrame, fill: bool = True) -> DataFrame:
    """Request names to feature names, bmi from height and weight, missing as 0."""
    renamed = df.withColumnsRenamed(
        {k: v for k, v in schema.REQUEST_TO_FEATURE.items() if k in df.columns}
    )
    bmi = "try_divide(double(weight), (height / 100D) * (height / 100D))"
    featured = with_exprs(renamed, {"bmi": bmi})
    if not fill:
        return featured
    wanted = [c for c in schema.STAGE_B_FEATURES if c in featured.columns]
    return with_exprs(featured, {c: f"coalesce(double({c}), 0D)" for c in wanted})


def blank_symptoms(df: DataFrame, when: str) -> DataFrame:
    """The screening path: symptoms are ignored on the rows where ``when`` holds."""
    return with_exprs(
        df, {c: f"CASE WHEN NOT ({when}) THEN {c} END" for c in schema.REQUEST_SYMPTOMS}
    )


def rule_scores(df: DataFrame, reference_compat: bool = False) -> DataFrame:
    return with_exprs(df, {"score_a": risk.score_a(), "score_b": risk.score_b(reference_compat)})


def route(df: DataFrame, model_probability: str | None = None, cuts=schema.LEVEL_CUTS,
          trigger: float = schema.SYMPTOM_TRIGGER, reference_compat: bool = False) -> DataFrame:
    """Stage, score and level. A model probability wins over the rule score unless NULL."""
    df = rule_scores(df, reference_compat)
    df = with_exprs(df, {"stage": f"CASE WHEN {risk.has_symptoms()} THEN 'B' ELSE 'A' END"})
    rule = "CASE WHEN stage = 'A' THEN score_a ELSE score_b END"
    source = "'rule'"
    if model_probability:
        rule = f"coalesce(`{model_probability}` * 100D, {rule})"
        source = f"CASE WHEN `{model_probability}` IS NULL THEN 'rule' ELSE 'model' END"
    df = with_exprs(df, {"risk_score": rule, "score_source": source})
    return with_exprs(
        df,
        {
            "mode_used": f"CASE WHEN stage = 'A' THEN '{schema.MODE_A}' ELSE '{schema.MODE_B}' END",
            "risk_level": risk.level("risk_score", "stage", cuts),
            "trigger_symptom": f"CASE WHEN stage = 'A' THEN risk_score >= {trigger} END",
        },
    )


def explain(routed: DataFrame) -> DataFrame:
    """Missing critical fields, confidence and the top factors."""
    found = with_exprs(routed, {"missing_fields": risk.missing_fields("stage")})
    return with_exprs(
        found,
        {
            "confidence": risk.confidence("missing_fields", "stage"),
            "top_factors": risk.top_factors("stage"),
        },
    )


def _next_step_table(spark) -> DataFrame:
    rows = ", ".join("('{}', '{}', '{}', {}, '{}')".format(*step) for step in NEXT_STEPS)
    names = "stage, risk_level, urgency, ask_missing, ask_symptoms"
    return spark.sql(f"SELECT * FROM VALUES {rows} AS steps({names})")


def advise(explained: DataFrame) -> DataFrame:
    """Join the six fixed next steps (broadcast: six rows), fill the ask list and derive title and actions.

    The title names stage and level; there is one action per factor that raised the risk, and one more if there is something to ask.
    """
    steps = F.broadcast(_next_step_table(explained.sparkSession))
    joined = explained.join(steps, ["stage", "risk_level"], "left")
    asked = with_exprs(joined, {"ask_for_more_info": risk.ask_list(), "title": "lower(concat('stage_', stage, '_', risk_level))"})
    about = "transform(top_factors, f -> concat('discuss_', f.feature))"
    actions = f"CASE WHEN size(ask_for_more_info) > 0 THEN concat({about}, array('complete_answers')) ELSE {about} END"
    return with_exprs(asked, {"actions": actions}).drop("ask_missing", "ask_symptoms")


def assess(df: DataFrame, **options) -> DataFrame:
    """Requests to scored, explained and advised rows."""
    return advise(explain(route(df, **options)))


def respond(assessed: DataFrame, request_id: str = "request_id", timestamp: str = "timestamp",
            model_version: str = schema.FALLBACK_VERSION) -> DataFrame:
    """The nested response contract, one row per request."""
    notes = " ".join(
        "WHEN stage = '{}' THEN array({})".format(stage, ", ".join(f"'{c}'" for c in codes))
        for stage, codes in DISCLAIMERS.items()
    )
    step = "'title', title, 'actions', actions, 'ask_for_more_info', ask_for_more_info, 'urgency', urgency"
    screening = "'risk_A', risk_score / 100D * 100D, 'trigger_symptom', trigger_symptom"
    triage = "'prob_B', risk_score / 100D, 'triage_level', risk_level"
    return assessed.selectExpr(
        f"`{request_id}` AS request_id",
        f"`{timestamp}` AS timestamp",
        "mode_used",
        f"'{model_version}' AS model_version",
        "risk_score",
        "risk_level",
        "confidence",
        "missing_fields",
        "top_factors",
        f"named_struct({step}) AS next_step",
        f"CASE {notes} END AS disclaimers",
        f"CASE WHEN stage = 'A' THEN named_struct({screening}) END AS screening",
        f"CASE WHEN stage = 'B' THEN named_struct({triage}) END AS triage",
    )


def audit_rows(response: DataFrame) -> DataFrame:
    """Eight common fields and the stage's own one; nothing personal."""
    return response.selectExpr(
        "request_id",
        "timestamp",
        "mode_used",
        "model_version",
        "risk_score",
        "risk_level",
        "confidence",
        "size(missing_fields) AS missing_fields_count",
        "screening.trigger_symptom AS trigger_symptom",
        "triage.triage_level AS triage_level",
    )
