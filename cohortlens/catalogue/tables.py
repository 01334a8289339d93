"""Standardization, quality report, KPIs and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import schema
from cohortlens.functions import clean
from cohortlens.functions.project import with_exprs
from cohortlens.operators import monitoring, quality, rates, serving
from cohortlens.operators import standardize as std
from cohortlens.plans.kpi_job import kpi_catalogue, write_kpis
from cohortlens.plans.survey import raw_survey, survey, table
from cohortlens.session import shared_dir
from cohortlens.sources import files

RENAMED_BACK = {
    "row_id": "Row ID",
    "age": "Age",
    "sleep_duration": "Sleep duration",
    "average_screen_time": "Average screen time",
    "blood_pressure": "Blood pressure",
    "discomfort_eye_strain": "Discomfort Eye-strain",
    "redness_in_eye": "Redness in eye",
    "itchiness_irritation_in_eye": "Itchiness/Irritation in eye",
    "dry_eye_disease": " Dry Eye  Disease ",
}
AGE_GENDER = ["age_band", "gender"]
SCREEN_SLEEP = ["screen_time_band", "sleep_quality"]
STRESS_SLEEP = ["stress_level", "sleep_duration_band"]


def standardize_names(spark, sf_dir):
    raw = raw_survey(spark, sf_dir)
    headed = raw.select(*[F.col(c).alias(h) for c, h in RENAMED_BACK.items()])
    return std.rename_columns(headed)


def binary_map(spark, sf_dir):
    mapped = std.map_codes(raw_survey(spark, sf_dir))
    return mapped.select("row_id", "gender", *schema.BINARY_COLUMNS)


def binary_map_lenient(spark, sf_dir):
    raw = raw_survey(spark, sf_dir).select(
        "row_id", "smoking", F.col("stress_level").cast("string").alias("stress_text"), "medical_issue"
    )
    columns = ["smoking", "stress_text", "medical_issue"]
    return std.map_codes(raw, columns, codes=schema.YES_NO_CODES, allow_numeric=True)


def numeric_cast(spark, sf_dir):
    columns = ["age", "sleep_duration", "blood_pressure", "smoking"]
    raw = raw_survey(spark, sf_dir)
    text = raw.select("row_id", *[F.col(c).cast("string").alias(c) for c in columns])
    return std.cast_numbers(text, columns)


def bp_parse(spark, sf_dir):
    raw = raw_survey(spark, sf_dir).select("row_id", "blood_pressure")
    return std.parse_pressure(raw)


def bp_parse_loose(spark, sf_dir):
    raw = raw_survey(spark, sf_dir).select("row_id", "blood_pressure")
    return std.parse_pressure(raw, patterns=schema.LOOSE_PRESSURE).drop("blood_pressure")


def range_validate(spark, sf_dir):
    out = survey(spark, sf_dir)
    pairs = [c for rule in schema.RANGE_RULES for c in (rule, f"{rule}_in_range")]
    return out.select("row_id", *pairs, "validity_ratio")


def derive_bands(spark, sf_dir):
    return survey(spark, sf_dir).select(
        "row_id", "bmi", "age_band", "screen_time_band", "sleep_duration_band", "symptom_score"
    )


def bands_null_last(spark, sf_dir):
    out = survey(spark, sf_dir, null_band="last")
    return out.groupBy("age_band", "screen_time_band", "sleep_duration_band").agg(
        F.count(F.lit(1)).alias("n")
    )


def symptom_score_strict(spark, sf_dir):
    return survey(spark, sf_dir, null_symptom="null").select("row_id", "symptom_score")


def load_profile(spark, sf_dir):
    orders = files.read_view(spark, f"{sf_dir}/orders.parquet", "orders_input")
    return orders.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("o_orderkey").alias("first_key"),
        F.max("o_orderkey").alias("last_key"),
        F.count_distinct("o_custkey").alias("customers"),
    )


def _rounded(df, places=6, **columns):
    return df.withColumns({c: F.round(c, p or places) for c, p in columns.items()})


def quality_report(spark, sf_dir):
    return _rounded(quality.quality_report(survey(spark, sf_dir)), avg_validity_ratio=6)


def kpi_data_quality(spark, sf_dir):
    return _rounded(rates.quality_by(survey(spark, sf_dir), AGE_GENDER), avg_validity_ratio=6)


def _cells(dims):
    return lambda spark, sf_dir: rates.rate_by(survey(spark, sf_dir), dims)


def kpi_grouping_sets(spark, sf_dir):
    cells = rates.kpi_cells(survey(spark, sf_dir))
    return cells.drop("no_screen_time", "no_sleep_quality", "no_bp", "validity_sum")


def kpi_snapshot(spark, sf_dir):
    return rates.kpi_snapshot(rates.kpi_cells(survey(spark, sf_dir)))


def kpi_roundtrip(spark, sf_dir):
    out = files.new_folder(spark, "kpi")
    write_kpis(survey(spark, sf_dir), out)
    return files.read_parquet(spark, f"{out}/{schema.KPI_TABLES['age_gender']}")


def kpi_catalog(spark, sf_dir):
    out = files.new_folder(spark, "kpi")
    write_kpis(survey(spark, sf_dir), out)
    return kpi_catalogue(spark, out).drop("table")


def kpi_low_n(spark, sf_dir):
    return rates.flag_low_n(rates.rate_by(survey(spark, sf_dir), SCREEN_SLEEP))


def kpi_page(spark, sf_dir):
    cells = rates.rate_by(survey(spark, sf_dir), SCREEN_SLEEP)
    rows, facts = serving.page(cells, number=2, size=7)
    return rows.withColumns(
        {
            "page": F.lit(facts["page"]),
            "total_rows": F.lit(facts["total_rows"]).cast("bigint"),
            "total_pages": F.lit(facts["total_pages"]).cast("bigint"),
            "has_next": F.lit(facts["has_next"]),
            "has_prev": F.lit(facts["has_prev"]),
        }
    )


def rollup_by_key(spark, sf_dir):
    cells = rates.rate_by(survey(spark, sf_dir), SCREEN_SLEEP)
    return serving.rollup_by(cells, ["screen_time_band"])


def overview_totals(spark, sf_dir):
    data = survey(spark, sf_dir)
    quality_cells = _rounded(rates.quality_by(data, AGE_GENDER), avg_validity_ratio=6)
    totals = serving.overview(rates.rate_by(data, AGE_GENDER), quality_cells, AGE_GENDER)
    return _rounded(totals, avg_validity_unweighted=5, avg_validity_weighted=5)


def missing_top5_cells(spark, sf_dir):
    return serving.top_missing(rates.quality_by(survey(spark, sf_dir), AGE_GENDER), AGE_GENDER)


def heatmap_pivot(spark, sf_dir):
    cells = rates.rate_by(survey(spark, sf_dir), SCREEN_SLEEP)
    return serving.heatmap(cells, "screen_time_band", "sleep_quality", [1, 2, 3, 4, 5])


def heatmap_intensity(spark, sf_dir):
    return serving.intensity(rates.rate_by(survey(spark, sf_dir), STRESS_SLEEP))


def age_gender_wide(spark, sf_dir):
    cells = rates.rate_by(survey(spark, sf_dir), AGE_GENDER)
    return serving.wide(cells, "age_band", "gender", {0: "rate_female", 1: "rate_male"})


def kpi_single_dims(spark, sf_dir):
    dims = ["stress_level", "sleep_duration_band", "screen_time_band", "sleep_quality"]
    return monitoring.single_dimension_rates(survey(spark, sf_dir), dims)


def kpi_merged_bands(spark, sf_dir):
    cells = rates.rate_by(survey(spark, sf_dir), AGE_GENDER)
    return serving.merge_keys(cells, "age_band", schema.MERGED_AGE_BANDS, ["gender"])


def _line(spark, sf_dir):
    deep = F.when(F.col("l_discount") > 0.05, 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").withColumn("deep", deep)


def rates_lineitem(spark, sf_dir):
    return rates.rate_by(_line(spark, sf_dir), ["l_returnflag", "l_linestatus"], "deep")


def rollup_lineitem(spark, sf_dir):
    cells = rates.rate_by(_line(spark, sf_dir), ["l_returnflag", "l_linenumber"], "deep")
    return serving.rollup_by(cells, ["l_returnflag"])


def heatmap_lineitem(spark, sf_dir):
    cells = rates_lineitem(spark, sf_dir)
    return serving.heatmap(cells, "l_returnflag", "l_linestatus", ["F", "O"])


def bands_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    bands = ([(5, "0-5"), (20, "5-20"), (100, "20-100")], "100+")
    banded = with_exprs(events, {"value_band": clean.band("value", bands)})
    checked = std.validate_ranges(banded, {"value": (1, 200)})
    return checked.groupBy("event_type", "value_band").agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("value_in_range")).alias("out_of_range")
    )


def csv_roundtrip(spark, sf_dir):
    """Suppliers written as headed CSV and read back, every column as text."""
    out = files.new_folder(spark, "csv")
    files.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), out)
    return files.read_csv(spark, out)


QUERIES = {
    "standardize_names": standardize_names,
    "binary_map": binary_map,
    "binary_map_lenient": binary_map_lenient,
    "numeric_cast": numeric_cast,
    "bp_parse": bp_parse,
    "bp_parse_loose": bp_parse_loose,
    "range_validate": range_validate,
    "derive_bands": derive_bands,
    "bands_null_last": bands_null_last,
    "symptom_score_strict": symptom_score_strict,
    "standardize_full": survey,
    "load_profile": load_profile,
    "quality_report": quality_report,
    "missing_rates": lambda s, d: quality.missing_rates(survey(s, d)),
    "missing_top10": lambda s, d: quality.missing_top(survey(s, d)),
    "csv_roundtrip": csv_roundtrip,
    "out_of_range_counts": lambda s, d: quality.out_of_range_counts(survey(s, d)),
    "validity_histogram": lambda s, d: quality.validity_histogram(survey(s, d)),
    "kpi_age_gender": _cells(AGE_GENDER),
    "kpi_screen_sleep": _cells(SCREEN_SLEEP),
    "kpi_symptom_score": _cells(["symptom_score"]),
    "kpi_stress_sleepband": _cells(STRESS_SLEEP),
    "kpi_data_quality": kpi_data_quality,
    "kpi_grouping_sets": kpi_grouping_sets,
    "kpi_snapshot": kpi_snapshot,
    "kpi_roundtrip": kpi_roundtrip,
    "kpi_catalog": kpi_catalog,
    "kpi_low_n": kpi_low_n,
    "kpi_page": kpi_page,
    "rollup_by_key": rollup_by_key,
    "overview_totals": overview_totals,
    "missing_top5_cells": missing_top5_cells,
    "heatmap_pivot": heatmap_pivot,
    "heatmap_intensity": heatmap_intensity,
    "age_gender_wide": age_gender_wide,
    "kpi_single_dims": kpi_single_dims,
    "kpi_merged_bands": kpi_merged_bands,
    "symptom_prevalence": lambda s, d: monitoring.symptom_prevalence(survey(s, d)),
    "missing_indicators": lambda s, d: monitoring.missing_indicators(survey(s, d)),
    "rates_lineitem": rates_lineitem,
    "rollup_lineitem": rollup_lineitem,
    "heatmap_lineitem": heatmap_lineitem,
    "bands_events": bands_events,
}
