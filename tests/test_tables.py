from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortlens import schema
from cohortlens.operators import rates, serving
from cohortlens.plans import kpi_job
from cohortlens.plans.survey import survey
from cohortlens.sources import audit, files, registry
from cohortlens.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('std')}/t"
    survey(spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


def test_cells_add_up(stored):
    cells = rates.rate_by(stored, ["screen_time_band", "sleep_quality"])
    known = stored.filter("screen_time_band IS NOT NULL AND sleep_quality IS NOT NULL")
    assert cells.agg(F.sum("n")).first()[0] == known.count()
    rolled = serving.rollup_by(cells, ["sleep_quality"]).collect()
    direct = rates.rate_by(known, ["sleep_quality"]).collect()
    assert [tuple(r) for r in rolled] == [tuple(r) for r in direct]


def test_batch_equals_single_queries(spark, stored, tmp_path):
    snapshot = {r["kpi"]: r for r in kpi_job.write_kpis(stored, str(tmp_path), csv=True).collect()}
    for name, dims in schema.KPI_DIMENSIONS.items():
        got = kpi_job.read_kpi(spark, str(tmp_path), name)
        single = rates.quality_by(stored, dims) if name == "data_quality_group" else rates.rate_by(stored, dims)
        assert got.columns == single.columns
        for a, b in zip(got.orderBy(*dims).collect(), single.collect()):
            assert list(a) == pytest.approx(list(b))
        assert snapshot[name]["num_cells"] == got.count()
    assert snapshot["data_quality_group"]["total_positives"] == 0
    csv = files.read_csv(spark, f"{tmp_path}/{schema.KPI_TABLES['age_gender']}_csv")
    assert csv.count() == snapshot["age_gender"]["num_cells"]
    assert kpi_job.kpi_catalogue(spark, str(tmp_path)).filter("available").count() == 5


def test_missing_and_unknown_kpis(spark, tmp_path):
    found = kpi_job.kpi_catalogue(spark, str(tmp_path)).collect()
    assert not any(r["available"] for r in found)
    with pytest.raises(KeyError):
        kpi_job.read_kpi(spark, str(tmp_path), "other")
    with pytest.raises(FileNotFoundError):
        kpi_job.read_kpi(spark, str(tmp_path), "age_gender")


def test_empty_snapshot(spark, stored):
    cells = rates.kpi_cells(stored.filter("age < 0"))
    for row in rates.kpi_snapshot(cells).collect():
        assert (row["num_cells"], row["min_n"], row["overall_rate"]) == (0, 0, None)
        assert row["has_low_n_cells"]


def test_pages(stored):
    cells = rates.rate_by(stored, ["stress_level", "sleep_duration_band"])
    total = cells.count()
    seen = []
    for number in range(1, -(-total // 7) + 1):
        rows, facts = serving.page(cells, number, 7)
        seen += rows.collect()
        assert facts["has_next"] == (number * 7 < total) and facts["has_prev"] == (number > 1)
    assert seen == cells.collect()
    rows, facts = serving.page(cells, 99, 7)
    assert rows.count() == 0 and not facts["has_next"]
    for number, size in ((0, 10), (1, 0), (1, 1001)):
        with pytest.raises(ValueError):
            serving.page(cells, number, size)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r["x"] for r in serving.clean_numbers(df).collect()] == [1.0, None, None]


def test_stored_bands_push_filters_and_prune(stored):
    plan = rates.rate_by(stored, ["age_band", "gender"])._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(age_band)" in plan and "IsNotNull(gender)" in plan
    assert "sleep_duration" not in plan
    assert "partial_count" in plan


def test_fingerprint(spark, tmp_path):
    one = files.fingerprint(spark, SF_DIR, "orders.parquet").first()
    with open(f"{SF_DIR}/orders.parquet", "rb") as source:
        assert one["sha256"] == hashlib.sha256(source.read()).hexdigest()
    spark.range(30).repartition(5).write.parquet(f"{tmp_path}/many")
    first, again = (files.fingerprint(spark, f"{tmp_path}/many").first() for _ in range(2))
    assert first["files"] == 5 and first == again
    spark.range(31).repartition(5).write.parquet(f"{tmp_path}/other")
    assert files.fingerprint(spark, f"{tmp_path}/other").first()["sha256"] != first["sha256"]


def test_registry_returns_every_stage_of_the_newest_version(spark):
    rows = [("v1", 1, "base", "A"), ("v2", 5, "base", "A"), ("v2", 6, "base", "B"), ("v1", 2, "base", "B")]
    df = spark.createDataFrame(rows, "model_version string, created_at int, channel string, stage string")
    found = registry.latest(df).collect()
    assert sorted((r["model_version"], r["stage"], r["created_at"]) for r in found) == [("v2", "A", 5), ("v2", "B", 6)]


def test_audit_stream_keeps_late_requests(spark, tmp_path):
    """Two runs of one checkpoint; the second batch is a day older than the first."""
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for name, hour in (("r1", "2024-05-02 10:00:00"), ("r2", "2024-05-01 09:00:00"), ("r3", "2024-05-02 11:00:00")):
        row = spark.sql(f"SELECT '{name}' AS request_id, timestamp_ntz'{hour}' AS timestamp, 0.5D AS risk_score")
        row.write.mode("append").parquet(source)
        stream = spark.readStream.schema(row.schema).parquet(source)
        jobs.start_audit(stream, out, state).awaitTermination()
    assert sorted(r["request_id"] for r in audit.read(spark, out).collect()) == ["r1", "r2", "r3"]


def test_registry_prefers_improved_then_base_then_fallback(spark):
    rows = [("v1", 1, "base"), ("v3", 3, "base"), ("i2", 2, "improved")]
    df = spark.createDataFrame(rows, "model_version string, created_at int, channel string")
    assert registry.latest(df).first()["model_version"] == "i2"
    assert registry.latest(df.filter("channel = 'base'")).first()["model_version"] == "v3"
    none = registry.latest(df.filter("created_at > 9")).first()
    assert (none["model_version"], none["status"]) == (schema.FALLBACK_VERSION, "fallback")
