from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlens import schema
from cohortlens.functions.clean import snake_case
from cohortlens.operators import quality, standardize as std
from cohortlens.plans.standardize_job import run
from cohortlens.sources import files


def test_snake_case():
    assert snake_case("Discomfort Eye-strain") == "discomfort_eye_strain"
    assert snake_case("Blood pressure") == "blood_pressure"
    assert snake_case("  Gender__ ") == "gender"


def test_colliding_headers_fail(spark):
    df = spark.createDataFrame([(1, 2)], "`Heart rate` int, `heart-rate` int")
    with pytest.raises(ValueError, match="heart_rate"):
        std.rename_columns(df)


@pytest.mark.parametrize(
    "text, want",
    [
        ("120/80", (120, 80, 1)),
        ("137 / 89", (137, 89, 1)),
        ("110-70", (110, 70, 1)),
        ("invalid", (None, None, 0)),
        (None, (None, None, 0)),
        ("", (None, None, 0)),
        ("12/", (None, None, 0)),
        ("a120/80b", (120, 80, 1)),
        ("120/80/60", (120, 80, 1)),
        ("99999999999999999999/80", (None, 80, 0)),
    ],
)
def test_pressure(spark, text, want):
    df = spark.createDataFrame([(text,)], "blood_pressure string")
    assert std.parse_pressure(df).select("systolic", "diastolic", "bp_parse_ok").first() == want


def test_pressure_flag_stays_when_out_of_range(spark):
    df = std.standardize(spark.createDataFrame([("300/200",)], "`Blood pressure` string"))
    row = df.first()
    assert (row["bp_parse_ok"], row["systolic"], row["diastolic"]) == (1, None, None)
    assert row["blood_pressure_raw"] == "300/200"


def test_no_pressure_column(spark):
    row = std.parse_pressure(spark.createDataFrame([(1,)], "x int")).first()
    assert (row["systolic"], row["diastolic"], row["bp_parse_ok"]) == (None, None, 0)


def test_bands_and_symptoms(spark):
    rows = [
        (20, 1.5, 5.0, 1, 1, 0),
        (27, 3.5, 6.5, 0, 1, 1),
        (32, 5.5, 7.5, 1, 0, 0),
        (37, 7.5, 8.5, 0, 0, 1),
        (43, 9.5, 10.0, 1, 1, 1),
        (45, 12.0, 11.0, 1, 1, None),
        (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "age int, average_screen_time double, sleep_duration double, discomfort_eye_strain int, "
        "redness_in_eye int, itchiness_irritation_in_eye int",
    )
    got = std.derive(df).collect()
    assert [r["age_band"] for r in got] == ["18-24", "25-29", "30-34", "35-39", "40-45", "40-45", None]
    assert [r["screen_time_band"] for r in got] == ["0-2", "2-4", "4-6", "6-8", "8-10", "10+", None]
    assert [r["sleep_duration_band"] for r in got] == ["<6", "6-7", "7-8", "8-9", "9+", "9+", None]
    assert [r["symptom_score"] for r in got] == [2, 2, 1, 1, 3, 2, 0]
    last = std.derive(df, null_band="last", null_symptom="null").collect()[-1]
    assert (last["age_band"], last["screen_time_band"], last["symptom_score"]) == ("40-45", "10+", None)
    with pytest.raises(ValueError):
        std.derive(df, null_band="other")


def test_ranges(spark):
    df = spark.createDataFrame([(15,), (25,), (50,), (None,)], "age int")
    got = std.validate_ranges(df).collect()
    assert [r["age_in_range"] for r in got] == [0, 1, 0, 0]
    assert [r["age"] for r in got] == [None, 25, None, None]
    assert [r["validity_ratio"] for r in got] == [0.0, 1.0, 0.0, 0.0]
    assert std.validate_ranges(spark.createDataFrame([(1,)], "x int")).first()["validity_ratio"] == 1.0


def test_codes(spark):
    df = spark.createDataFrame([("y",), ("No",), ("TRUE",), ("1",), (" Y",), (None,)], "smoking string")
    assert [r[0] for r in std.map_codes(df).collect()] == [1, 0, 1, None, None, None]
    lenient = std.map_codes(df, allow_numeric=True).collect()
    assert [r[0] for r in lenient] == [1, 0, 1, 1, None, None]


def test_job_from_csv(spark, tmp_path):
    rows = [("30", "F", "Y", "120/80", "8.5", "3"), ("x", "m", "n", "bad", "", "9")]
    raw = spark.createDataFrame(
        rows, "`Age` string, Gender string, `Dry Eye Disease` string, `Blood pressure` string, "
        "`Average screen time` string, `Sleep quality` string"
    )
    files.write_csv(raw, f"{tmp_path}/raw")
    run(spark, f"{tmp_path}/raw", f"{tmp_path}/out")
    stored = files.read_parquet(spark, f"{tmp_path}/out/clean_assessments").orderBy("gender").collect()
    assert [r["age"] for r in stored] == [30.0, None]
    assert [r["screen_time_band"] for r in stored] == ["8-10", None]
    report = spark.read.json(f"{tmp_path}/out/data_quality_report").first()
    assert report["row_count"] == 2
    assert report["class_balance"]["positive_rate"] == 0.5
    assert report["bp_parse_ok_rate"] == 0.5
    assert report["out_of_range_counts_by_column"]["sleep_quality"] == 1
    assert report["missing_rate_by_column"]["age"] == 0.5
    assert sum(b["n"] for b in report["validity_ratio_histogram_bins"]) == 2


def test_empty_and_all_null(spark):
    names = ["Age", "Gender", "Blood pressure", "Dry Eye Disease", "Sleep duration"]
    text = ", ".join(f"`{n}` string" for n in names)
    empty = std.standardize(spark.createDataFrame([], text))
    assert empty.count() == 0
    report = quality.quality_report(empty).first()
    assert report["row_count"] == 0 and report["positive_rate"] is None
    assert {r["n"] for r in quality.validity_histogram(empty).collect()} == {0}
    nulls = std.standardize(spark.createDataFrame([(None,) * len(names)], text)).first()
    assert nulls["age_band"] is None and nulls["bp_parse_ok"] == 0


def test_whole_chain_is_one_stage_without_exchange(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("Age"))
    plan = std.standardize(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rules_cover_the_contract():
    assert len(schema.RANGE_RULES) == 12 and len(schema.BINARY_COLUMNS) == 14
    assert len(schema.STAGE_A_FEATURES) == 22
