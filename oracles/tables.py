"""SQL for standardization, quality report, KPIs and serving."""

from __future__ import annotations

from oracles.base import BINARY, RANGES, RAW, STD, STD_COLUMNS, SYMPTOMS, on_std, union, yes_no

HEADERS = {
    "Row ID": "row_id", "Age": "age", "Sleep duration": "sleep_duration",
    "Average screen time": "average_screen_time", "Blood pressure": "blood_pressure",
    "Discomfort Eye-strain": "discomfort_eye_strain", "Redness in eye": "redness_in_eye",
    "Itchiness/Irritation in eye": "itchiness_irritation_in_eye", " Dry Eye  Disease ": "dry_eye_disease",
}


def rate(dims: str, source: str = "std", label: str = "dry_eye_disease") -> str:
    known = " AND ".join(f"{d.strip()} IS NOT NULL" for d in dims.split(","))
    return (
        f"SELECT {dims}, COUNT(*) AS n, CAST(SUM(COALESCE({label}, 0)) AS BIGINT) AS positives, "
        f"CAST(SUM(COALESCE({label}, 0)) AS DOUBLE) / COUNT(*) AS rate "
        f"FROM {source} WHERE {known} GROUP BY {dims}"
    )


QUALITY = (
    "SELECT age_band, gender, COUNT(*) AS n, "
    "AVG(CASE WHEN average_screen_time IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS missing_rate_screen_time, "
    "AVG(CASE WHEN sleep_quality IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS missing_rate_sleep_quality, "
    "AVG(CASE WHEN bp_parse_ok = 0 OR bp_parse_ok IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS missing_rate_bp, "
    "round(AVG(COALESCE(validity_ratio, 0.0)), 6) AS avg_validity_ratio "
    "FROM std WHERE age_band IS NOT NULL AND gender IS NOT NULL GROUP BY age_band, gender"
)
KPIS = {
    "age_gender": ("age_band, gender", True),
    "screen_sleep": ("screen_time_band, sleep_quality", True),
    "symptom_score": ("symptom_score", True),
    "stress_sleepband": ("stress_level, sleep_duration_band", True),
    "data_quality_group": ("age_band, gender", False),
}
LINE = "line AS (SELECT *, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS deep FROM lineitem)"


def grouping_part(name: str) -> str:
    dims, _ = KPIS[name]
    used = [d.strip() for d in dims.split(",")]
    every = ["age_band", "gender", "screen_time_band", "sleep_quality", "symptom_score",
             "stress_level", "sleep_duration_band"]
    types = {"age_band": "VARCHAR", "gender": "INTEGER", "screen_time_band": "VARCHAR",
             "sleep_quality": "BIGINT", "symptom_score": "INTEGER", "stress_level": "BIGINT",
             "sleep_duration_band": "VARCHAR"}
    cols = ", ".join(d if d in used else f"CAST(NULL AS {types[d]}) AS {d}" for d in every)
    known = " AND ".join(f"{d} IS NOT NULL" for d in used)
    return (
        f"SELECT '{name}' AS kpi, {cols}, COUNT(*) AS n, "
        "CAST(SUM(COALESCE(dry_eye_disease, 0)) AS BIGINT) AS positives, "
        "CAST(SUM(COALESCE(dry_eye_disease, 0)) AS DOUBLE) / COUNT(*) AS rate "
        f"FROM std WHERE {known} GROUP BY {dims}"
    )


def snapshot_part(name: str) -> str:
    dims, labelled = KPIS[name]
    positives = "COALESCE(SUM(positives), 0)" if labelled else "0"
    return (
        f"SELECT '{name}' AS kpi, COUNT(*) AS num_cells, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS total_n, "
        f"CAST({positives} AS BIGINT) AS total_positives, "
        "COALESCE(MIN(n), 0) AS min_n, COALESCE(MAX(n), 0) AS max_n, "
        f"CAST({positives} AS DOUBLE) / NULLIF(SUM(n), 0) AS overall_rate, "
        f"COALESCE(MIN(n), 0) < 10 AS has_low_n_cells FROM ({rate(dims)})"
    )


MISSING_UNION = union(
    [
        f"SELECT '{c}' AS column_name, AVG(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS missing_rate FROM std"
        for c in STD_COLUMNS
    ]
)
BINS = [("0.0-0.2", 0.0, 0.2), ("0.2-0.4", 0.2, 0.4), ("0.4-0.6", 0.4, 0.6), ("0.6-0.8", 0.6, 0.8), ("0.8-1.0", 0.8, 1.01)]

HEAT_COLS = [1, 2, 3, 4, 5]
HEAT = (
    "SELECT screen_time_band, CAST(SUM(n) AS BIGINT) AS row_n, "
    + ", ".join(
        f"MAX(CASE WHEN sleep_quality = {v} THEN rate END) AS rate_{v}, "
        f"COALESCE(MAX(CASE WHEN sleep_quality = {v} THEN n END), 0) AS n_{v}"
        for v in HEAT_COLS
    )
    + f" FROM ({rate('screen_time_band, sleep_quality')}) GROUP BY screen_time_band"
)

ORACLES = {
    "standardize_names": f"WITH {RAW} SELECT " + ", ".join(f"{v}" for v in HEADERS.values()) + " FROM raw",
    "binary_map": f"WITH {RAW} SELECT row_id, CASE upper(gender) WHEN 'F' THEN 0 WHEN 'M' THEN 1 END AS gender, "
    + ", ".join(f"{yes_no(c)} AS {c}" for c in BINARY) + " FROM raw",
    "binary_map_lenient": f"WITH {RAW}, coded AS (SELECT row_id, smoking, CAST(stress_level AS VARCHAR) AS stress_text, medical_issue FROM raw) "
    "SELECT row_id, "
    + ", ".join(
        f"CASE WHEN upper({c}) = 'Y' THEN 1 WHEN upper({c}) = 'N' THEN 0 ELSE TRY_CAST({c} AS INTEGER) END AS {c}"
        for c in ("smoking", "stress_text", "medical_issue")
    ) + " FROM coded",
    "numeric_cast": f"WITH {RAW} SELECT row_id, TRY_CAST(CAST(age AS VARCHAR) AS DOUBLE) AS age, "
    "TRY_CAST(CAST(sleep_duration AS VARCHAR) AS DOUBLE) AS sleep_duration, "
    "TRY_CAST(blood_pressure AS DOUBLE) AS blood_pressure, TRY_CAST(smoking AS DOUBLE) AS smoking FROM raw",
    "bp_parse": on_std("SELECT row_id, blood_pressure, systolic, diastolic, bp_parse_ok FROM parsed"),
    "bp_parse_loose": f"WITH {RAW}, loose AS (SELECT row_id, "
    r"TRY_CAST(nullif(regexp_extract(blood_pressure, '(\d{2,3})', 1), '') AS BIGINT) AS systolic, "
    r"TRY_CAST(nullif(regexp_extract(blood_pressure, '\d{2,3}\D+(\d{2,3})', 1), '') AS BIGINT) AS diastolic FROM raw) "
    "SELECT *, CASE WHEN systolic IS NOT NULL AND diastolic IS NOT NULL THEN 1 ELSE 0 END AS bp_parse_ok FROM loose",
    "range_validate": on_std(
        "SELECT row_id, " + ", ".join(f"{c}, {c}_in_range" for c in RANGES) + ", validity_ratio FROM std"
    ),
    "derive_bands": on_std("SELECT row_id, bmi, age_band, screen_time_band, sleep_duration_band, symptom_score FROM std"),
    "bands_null_last": on_std(
        "SELECT age_band, screen_time_band, sleep_duration_band, COUNT(*) AS n FROM std GROUP BY ALL", null_band="last"
    ),
    "symptom_score_strict": on_std("SELECT row_id, symptom_score FROM std", null_symptom="null"),
    "standardize_full": on_std("SELECT " + ", ".join(STD_COLUMNS) + " FROM std"),
    "load_profile": "SELECT COUNT(*) AS n, MIN(o_orderkey) AS first_key, MAX(o_orderkey) AS last_key, "
    "COUNT(DISTINCT o_custkey) AS customers FROM orders",
    "quality_report": on_std(
        "SELECT COUNT(*) AS row_count, AVG(dry_eye_disease) AS positive_rate, AVG(bp_parse_ok) AS bp_parse_ok_rate, "
        f"round(AVG(validity_ratio), 6) AS avg_validity_ratio, CAST({len(STD_COLUMNS)} AS BIGINT) AS column_count FROM std"
    ),
    "missing_rates": on_std(MISSING_UNION),
    "missing_top10": on_std(f"SELECT * FROM ({MISSING_UNION}) ORDER BY missing_rate DESC, column_name LIMIT 10"),
    "csv_roundtrip": "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier",
    "out_of_range_counts": on_std(
        union([f"SELECT '{c}' AS column_name, CAST(SUM(1 - {c}_in_range) AS BIGINT) AS out_of_range, COUNT(*) - COUNT({c}) AS n_missing FROM std" for c in RANGES])
    ),
    "validity_histogram": on_std(
        union([f"SELECT '{b}' AS bin, COUNT(*) AS n FROM std WHERE validity_ratio >= {lo} AND validity_ratio < {hi}" for b, lo, hi in BINS])
    ),
    "kpi_age_gender": on_std(rate("age_band, gender")),
    "kpi_screen_sleep": on_std(rate("screen_time_band, sleep_quality")),
    "kpi_symptom_score": on_std(rate("symptom_score")),
    "kpi_stress_sleepband": on_std(rate("stress_level, sleep_duration_band")),
    "kpi_data_quality": on_std(QUALITY),
    "kpi_grouping_sets": on_std(union([grouping_part(k) for k in KPIS])),
    "kpi_snapshot": on_std(union([snapshot_part(k) for k in KPIS])),
    "kpi_roundtrip": on_std(rate("age_band, gender")),
    "kpi_catalog": on_std(
        union([f"SELECT '{k}' AS name, true AS available, COUNT(*) AS row_count FROM ({rate(d)})" for k, (d, _) in KPIS.items()])
    ),
    "kpi_low_n": on_std(f"SELECT *, n < 10 AS low_n FROM ({rate('screen_time_band, sleep_quality')})"),
    "kpi_page": on_std(
        f", cells AS ({rate('screen_time_band, sleep_quality')}), total AS (SELECT COUNT(*) AS t FROM cells), "
        "paged AS (SELECT * FROM cells ORDER BY 1, 2 LIMIT 7 OFFSET 7) "
        "SELECT paged.*, CAST(2 AS INTEGER) AS page, t AS total_rows, CAST((t + 6) // 7 AS BIGINT) AS total_pages, "
        "2 < (t + 6) // 7 AS has_next, true AS has_prev FROM paged, total"
    ),
    "rollup_by_key": on_std(
        "SELECT screen_time_band, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(positives) AS BIGINT) AS positives, "
        "COALESCE(CAST(SUM(positives) AS DOUBLE) / NULLIF(SUM(n), 0), 0.0) AS rate "
        f"FROM ({rate('screen_time_band, sleep_quality')}) GROUP BY screen_time_band"
    ),
    "overview_totals": on_std(
        f", r AS ({rate('age_band, gender')}), q AS ({QUALITY}) "
        "SELECT CAST(SUM(r.n) AS BIGINT) AS total_n, CAST(SUM(positives) AS BIGINT) AS total_positives, "
        "CAST(SUM(positives) AS DOUBLE) / SUM(r.n) AS overall_rate, "
        "round(AVG(avg_validity_ratio), 5) AS avg_validity_unweighted, "
        "round(SUM(avg_validity_ratio * q.n) / SUM(q.n), 5) AS avg_validity_weighted "
        "FROM r JOIN q USING (age_band, gender)"
    ),
    "missing_top5_cells": on_std(
        f", q AS ({QUALITY}) SELECT age_band, gender, n, field, rate FROM ("
        + union([f"SELECT age_band, gender, n, '{f}' AS field, missing_rate_{f} AS rate FROM q" for f in ("screen_time", "sleep_quality", "bp")])
        + ") ORDER BY rate DESC, field, age_band, gender LIMIT 5"
    ),
    "heatmap_pivot": on_std(HEAT),
    "heatmap_intensity": on_std(
        f", c AS ({rate('stress_level, sleep_duration_band')}) "
        "SELECT *, COALESCE(rate / NULLIF((SELECT MAX(rate) FROM c), 0), 0.0) AS intensity FROM c"
    ),
    "age_gender_wide": on_std(
        "SELECT age_band, MAX(CASE WHEN gender = 0 THEN rate END) AS rate_female, "
        f"MAX(CASE WHEN gender = 1 THEN rate END) AS rate_male FROM ({rate('age_band, gender')}) GROUP BY age_band"
    ),
    "kpi_single_dims": on_std(
        union(
            [
                f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, n, positives, rate FROM ({rate(d)})"
                for d in ("stress_level", "sleep_duration_band", "screen_time_band", "sleep_quality")
            ]
        )
    ),
    "kpi_merged_bands": on_std(
        ", m AS (SELECT *, CASE WHEN age_band IN ('18-24', '25-29') THEN '18-29' "
        "WHEN age_band IN ('30-34', '35-39') THEN '30-39' ELSE age_band END AS wide_band FROM std) "
        f"SELECT wide_band AS age_band, gender, n, positives, rate FROM ({rate('wide_band, gender', 'm')})"
        .replace("FROM m WHERE", "FROM m WHERE age_band IS NOT NULL AND")
    ),
    "symptom_prevalence": on_std(
        union(
            [
                f"SELECT dry_eye_disease, '{c}' AS symptom, AVG({c}) AS prevalence FROM std "
                "WHERE dry_eye_disease IS NOT NULL GROUP BY dry_eye_disease"
                for c in SYMPTOMS
            ]
        )
    ),
    "missing_indicators": on_std(
        "SELECT row_id, CAST(systolic IS NULL OR diastolic IS NULL AS INTEGER) AS miss_bp, "
        "CAST(average_screen_time IS NULL AS INTEGER) AS miss_screen_time, "
        "CAST(sleep_quality IS NULL AS INTEGER) AS miss_sleep_quality, "
        "CAST(discomfort_eye_strain IS NULL OR redness_in_eye IS NULL OR itchiness_irritation_in_eye IS NULL AS INTEGER) AS miss_symptom_group FROM std"
    ),
    "rates_lineitem": f"WITH {LINE} {rate('l_returnflag, l_linestatus', 'line', 'deep')}",
    "rollup_lineitem": f"WITH {LINE} SELECT l_returnflag, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(positives) AS BIGINT) AS positives, "
    f"CAST(SUM(positives) AS DOUBLE) / SUM(n) AS rate FROM ({rate('l_returnflag, l_linenumber', 'line', 'deep')}) GROUP BY l_returnflag",
    "heatmap_lineitem": f"WITH {LINE} SELECT l_returnflag, CAST(SUM(n) AS BIGINT) AS row_n, "
    + ", ".join(
        f"MAX(CASE WHEN l_linestatus = '{v}' THEN rate END) AS rate_{v}, "
        f"COALESCE(MAX(CASE WHEN l_linestatus = '{v}' THEN n END), 0) AS n_{v}" for v in ("F", "O")
    )
    + f" FROM ({rate('l_returnflag, l_linestatus', 'line', 'deep')}) GROUP BY l_returnflag",
    "bands_events": "SELECT event_type, CASE WHEN value < 5 THEN '0-5' WHEN value < 20 THEN '5-20' WHEN value < 100 THEN '20-100' "
    "WHEN value IS NOT NULL THEN '100+' END AS value_band, COUNT(*) AS n, "
    "CAST(SUM(CASE WHEN value >= 1 AND value <= 200 THEN 0 ELSE 1 END) AS BIGINT) AS out_of_range FROM events GROUP BY ALL",
}
