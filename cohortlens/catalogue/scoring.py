"""Two-stage scoring, audit log and the two streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import schema
from cohortlens.functions.project import with_exprs
from cohortlens.operators import scoring
from cohortlens.operators import standardize as std
from cohortlens.plans import assess_job
from cohortlens.plans.survey import RAW_SURVEY_SQL, raw_survey, survey, table
from cohortlens.sources import audit, files
from cohortlens.streaming import jobs


def _requests(spark, sf_dir):
    requests = assess_job.to_requests(survey(spark, sf_dir))
    return scoring.blank_symptoms(requests, assess_job.SCREENING_PATH)


def request_validation(spark, sf_dir):
    parsed = std.parse_pressure(std.map_codes(raw_survey(spark, sf_dir)))
    checked = scoring.request_ranges_check(assess_job.to_requests(parsed))
    return with_exprs(checked, {"failed": "array_join(failed_fields, ',')"}).select(
        "row_id", "valid", "failed"
    )


def request_features(spark, sf_dir):
    return scoring.to_features(_requests(spark, sf_dir)).select("row_id", *schema.STAGE_B_FEATURES)


def score_stage_a(spark, sf_dir):
    scored = scoring.rule_scores(_requests(spark, sf_dir))
    return scored.selectExpr("row_id", "score_a", "score_a / 100D AS prob_a")


def score_stage_b(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    strict = scoring.rule_scores(requests).select("row_id", "score_b", *schema.REQUEST_RANGES)
    compat = scoring.rule_scores(strict.withColumnRenamed("score_b", "score"), reference_compat=True)
    return compat.selectExpr("row_id", "score AS score_b", "score_b AS score_b_compat")


def route_and_score(spark, sf_dir):
    return scoring.route(_requests(spark, sf_dir)).select(
        "row_id", "mode_used", "risk_score", "risk_level", "trigger_symptom"
    )


def missing_fields(spark, sf_dir):
    explained = scoring.explain(scoring.route(_requests(spark, sf_dir)))
    joined = with_exprs(explained, {"missing": "array_join(missing_fields, ',')"})
    return joined.select("row_id", "missing", "confidence")


def top_factors(spark, sf_dir):
    explained = scoring.explain(scoring.route(_requests(spark, sf_dir)))
    text = "array_join(transform(top_factors, f -> concat_ws(':', f.feature, f.strength, f.note)), ',')"
    return with_exprs(explained, {"factors": text}).select("row_id", "factors")


def next_step(spark, sf_dir):
    advised = assess_job.score_requests(survey(spark, sf_dir))
    text = {"ask": "array_join(ask_for_more_info, ',')", "action_list": "array_join(actions, ',')"}
    return with_exprs(advised, text).select("row_id", "title", "urgency", "ask", "action_list")


def assessment_response(spark, sf_dir):
    response = scoring.respond(assess_job.score_requests(survey(spark, sf_dir)))
    return assess_job.flat_response(response)


def audit_log(spark, sf_dir):
    out = files.new_folder(spark, "audit")
    assess_job.run(survey(spark, sf_dir), out)
    return audit.read(spark, out)


def _stream(spark, sf_dir, name):
    source = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _audit_stream(spark, sf_dir):
    raw = spark.sql(
        RAW_SURVEY_SQL.replace("FROM orders", "FROM {orders}"), orders=_stream(spark, sf_dir, "orders")
    )
    response = scoring.respond(assess_job.score_requests(std.standardize(raw)))
    return scoring.audit_rows(response)


def stream_scoring(spark, sf_dir):
    """The audit log again, written by a stream over the same records."""
    out = files.new_folder(spark, "audit-stream")
    jobs.start_audit(_audit_stream(spark, sf_dir), out, f"{out}-state").awaitTermination()
    return audit.read(spark, out)


def _closed_windows(spark, rows):
    out = files.new_folder(spark, "windows")
    jobs.start_windows(rows, out, f"{out}-state").awaitTermination()
    stored = spark.read.schema(rows.schema).parquet(out)
    return with_exprs(stored, {c: f"CAST(`{c}` AS TIMESTAMP_NTZ)" for c in ("start", "end")})


def stream_audit_monitor(spark, sf_dir):
    """Share of high risk and of incomplete answers per six hours of the audit stream."""
    measures = {
        "n": F.count(F.lit(1)),
        "high": F.count(F.when(F.col("risk_level") == "High", 1)),
        "high_rate": F.avg(F.when(F.col("risk_level") == "High", 1.0).otherwise(0.0)),
        "incomplete_rate": F.avg(F.when(F.col("missing_fields_count") > 0, 1.0).otherwise(0.0)),
    }
    rows = jobs.windowed(
        _audit_stream(spark, sf_dir), "timestamp", ["mode_used"], measures, width="6 hours"
    )
    return _closed_windows(spark, rows)


def _event_measures():
    return {
        "n": F.count(F.lit(1)),
        "missing": F.count(F.when(F.col("value").isNull(), 1)),
        "high_rate": F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)),
    }


def stream_monitor(spark, sf_dir):
    """Daily counts and means per event type, written when their window has closed."""
    rows = jobs.windowed(_stream(spark, sf_dir, "events"), "ts", ["event_type"], _event_measures())
    return _closed_windows(spark, rows)


def stream_monitor_final(spark, sf_dir):
    """The same with the windows that are still open at the end of the data."""
    closed = stream_monitor(spark, sf_dir)
    rest = jobs.open_windows(closed, table(spark, sf_dir, "events"), "ts", ["event_type"], _event_measures())
    return closed.unionByName(with_exprs(rest, {c: f"CAST(`{c}` AS TIMESTAMP_NTZ)" for c in ("start", "end")}))


QUERIES = {
    "request_validation": request_validation,
    "request_features": request_features,
    "score_stage_a": score_stage_a,
    "score_stage_b": score_stage_b,
    "route_and_score": route_and_score,
    "missing_fields": missing_fields,
    "top_factors": top_factors,
    "next_step": next_step,
    "assessment_response": assessment_response,
    "audit_log": audit_log,
    "stream_scoring": stream_scoring,
    "stream_monitor": stream_monitor,
    "stream_monitor_final": stream_monitor_final,
    "stream_audit_monitor": stream_audit_monitor,
}
