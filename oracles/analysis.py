"""SQL for profiles, features, splits, evaluation and monitoring."""

from __future__ import annotations

from oracles.base import RAW, STAGE_A, STAGE_B, STD, STD_COLUMNS, SYMPTOMS, union
from oracles.scoring import SCORED
from oracles.tables import MISSING_UNION

NUMERIC = [
    "age", "bmi", "sleep_duration", "sleep_quality", "average_screen_time", "stress_level",
    "heart_rate", "daily_steps", "physical_activity", "systolic", "diastolic",
]
Y = "dry_eye_disease"


def stats(source: str, columns: list[str], places: int = 6) -> str:
    return union(
        [
            f"SELECT '{c}' AS feature, round(AVG(CAST({c} AS DOUBLE)), {places}) + 0.0 AS mean, "
            f"round(stddev_samp(CAST({c} AS DOUBLE)), {places}) + 0.0 AS std, "
            f"round(CAST(MIN({c}) AS DOUBLE), {places}) AS min, round(CAST(MAX({c}) AS DOUBLE), {places}) AS max, "
            f"COUNT({c}) AS n, COUNT(DISTINCT {c}) AS distinct_n, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), {places}) AS q25, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), {places}) AS median, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), {places}) AS q75 FROM {source}"
            for c in columns
        ]
    )


def corr(x: str, y: str, source: str, name: str) -> str:
    """From moments, so that a constant side gives 0 in every engine."""
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return (
        f"SELECT '{name}' AS feature, round(COALESCE(covar_pop(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) / "
        f"NULLIF(stddev_pop(CAST({x} AS DOUBLE)) * stddev_pop(CAST({y} AS DOUBLE)), 0), 0.0), 6) + 0.0 AS correlation "
        f"FROM {source} WHERE {both}"
    )


FILLED = (
    ", med AS (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in STAGE_B)
    + f" FROM std WHERE {Y} IS NOT NULL), filled AS (SELECT row_id, {Y}, "
    + ", ".join(f"COALESCE(CAST({c} AS DOUBLE), m_{c}, 0.0::DOUBLE) AS {c}" for c in STAGE_B)
    + f" FROM std, med WHERE {Y} IS NOT NULL)"
)


def top_values(source: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT feature, value, n, CAST(place AS INTEGER) AS place, distinct_n FROM (SELECT '{c}' AS feature, {c} AS value, COUNT(*) AS n, "
            f"row_number() OVER (ORDER BY COUNT(*) DESC, {c}) AS place, COUNT(*) OVER () AS distinct_n "
            f"FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE place <= 5"
            for c in columns
        ]
    )


def code(c: str) -> str:
    return (
        f"COALESCE((SELECT CAST(k AS INTEGER) FROM (SELECT v, row_number() OVER (ORDER BY f, v) - 1 AS k FROM "
        f"(SELECT {c} AS v, MIN(row_id) AS f FROM raw WHERE {c} IS NOT NULL GROUP BY {c})) t WHERE t.v = raw.{c}), -1) AS {c}"
    )


def information(c: str) -> str:
    cuts = ", ".join(f"quantile_disc({c}, {i / 10})" for i in range(1, 10))
    return (
        f"SELECT '{c}' AS feature, round(SUM(n / t * ln(n * t / (b * k))), 6) + 0.0 AS mutual_information FROM ("
        f"SELECT n, SUM(n) OVER () AS t, SUM(n) OVER (PARTITION BY bin) AS b, SUM(n) OVER (PARTITION BY y) AS k FROM ("
        f"SELECT bin, y, CAST(COUNT(*) AS DOUBLE) AS n FROM (SELECT {Y} AS y, len(list_filter((SELECT list_distinct([{cuts}]) FROM std "
        f"WHERE {Y} IS NOT NULL), lambda e: e < {c})) AS bin FROM std WHERE {Y} IS NOT NULL AND {c} IS NOT NULL) GROUP BY 1, 2))"
    )


D = "::DOUBLE"
SYM = "discomfort_eye_strain * 2 + redness_in_eye + itchiness_irritation_in_eye"
SUM3 = " + ".join(f"coalesce({c}, 0)" for c in SYMPTOMS)
PRESSURE = {"map": f"(systolic + 2 * diastolic)::DOUBLE / 3.0{D}", "pulse_pressure": "systolic - diastolic"}


def flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


BASE = {
    "screen_sleep_interaction": "average_screen_time * sleep_duration",
    "stress_sleep_quality": "stress_level * sleep_quality",
    "bmi_age": "bmi * age",
    "screen_to_sleep_ratio": "average_screen_time / (sleep_duration + 1)",
    "steps_per_hour": f"daily_steps / 24.0{D}",
    "screen_time_squared": "average_screen_time * average_screen_time",
    "sleep_quality_squared": "sleep_quality * sleep_quality",
    "stress_level_squared": "stress_level * stress_level",
    "age_screen_interaction": "age * average_screen_time",
}
MEDICAL = {
    "digital_eye_strain": "average_screen_time * stress_level",
    "unprotected_screen_exposure": "average_screen_time * (1 - blue_light_filter)",
    **PRESSURE,
    "hypertension_risk": flag("systolic >= 130 OR diastolic >= 80"),
    "bmi_squared": "bmi * bmi",
    "obesity_flag": flag("bmi >= 30"),
    "overweight_flag": flag("bmi >= 25 AND bmi < 30"),
    "recovery_score": "sleep_duration * sleep_quality",
    "sleep_efficiency": "sleep_quality / (sleep_duration + 1)",
    "sleep_disruption": "wake_up_during_night + feel_sleepy_during_day",
    "substance_risk": f"caffeine_consumption + alcohol_consumption * 1.5{D} + smoking * 2",
    "activity_composite": f"round(physical_activity * ln(1.0{D} + daily_steps), 6)",
    "sedentary_flag": flag("physical_activity < 30 OR daily_steps < 5000"),
    "age_squared": "age * age",
    "age_risk_65plus": flag("age >= 65"),
    "age_screen_interaction": "age * average_screen_time",
    "age_bmi_interaction": "age * bmi",
    "medical_burden": "medical_issue + ongoing_medication",
    "circadian_disruption": "smart_device_before_bed * (10 - sleep_quality)",
    "symptom_severity": SYM,
    "symptom_screen_interaction": f"({SYM}) * average_screen_time",
}
SAFE = {
    **PRESSURE, "bmi_squared": "bmi * bmi", "screen_stress": "average_screen_time * stress_level",
    "recovery": "sleep_duration * sleep_quality", "symptom_total": SUM3,
}
QUICK = {
    "digital_strain": "average_screen_time * stress_level", **PRESSURE,
    "recovery_score": "sleep_duration * sleep_quality", "bmi_squared": "bmi * bmi", "obesity": flag("bmi >= 30"),
    "age_squared": "age * age", "age_screen": "age * average_screen_time", "symptom_total": SYM,
}
PAIRS = [
    "age bmi", "age average_screen_time", "age stress_level", "bmi physical_activity", "bmi daily_steps",
    "average_screen_time stress_level", "average_screen_time sleep_quality", "sleep_duration sleep_quality",
    "sleep_duration stress_level", "systolic diastolic", "systolic age", "systolic bmi",
    "caffeine_consumption stress_level", "smoking age", "physical_activity heart_rate", "daily_steps age",
]


def wide() -> dict:
    out = {}
    for c in ("age", "bmi", "average_screen_time", "stress_level", "sleep_quality"):
        out.update({
            f"{c}_squared": f"{c} * {c}", f"{c}_cubed": f"{c} * {c} * {c}",
            f"{c}_sqrt": f"sqrt(CAST({c} AS DOUBLE))", f"{c}_log": f"round(ln(1.0{D} + {c}), 6)",
        })
    out["screen_sleep_ratio"] = f"average_screen_time / (sleep_duration + 0.1{D})"
    out["sleep_screen_ratio"] = f"sleep_duration / (average_screen_time + 0.1{D})"
    out["bp_ratio"] = "systolic::DOUBLE / (diastolic + 1)"
    out.update(PRESSURE)
    out["activity_ratio"] = f"physical_activity::DOUBLE / (daily_steps / 1000.0{D} + 0.1{D})"
    for pair in PAIRS:
        a, b = pair.split()
        out.update({f"{a}_x_{b}": f"{a} * {b}", f"{a}_plus_{b}": f"{a} + {b}", f"{a}_minus_{b}": f"{a} - {b}"})
    values = "list_filter([" + ", ".join(f"{c}::DOUBLE" for c in SYMPTOMS) + "], lambda v: v IS NOT NULL)"
    out["symptom_sum"] = SUM3
    out["symptom_mean"] = f"({SUM3})::DOUBLE / NULLIF(len({values}), 0)"
    out["symptom_max"] = f"greatest({', '.join(SYMPTOMS)})"
    out["symptom_std"] = f"round(COALESCE(list_stddev_samp({values}), 0.0{D}), 6)"
    for c in ("average_screen_time", "stress_level", "age", "sleep_quality"):
        out[f"symptom_sum_x_{c}"] = f"({SUM3}) * {c}"
    out.update({
        "age_bin_young": flag("age < 30"), "age_bin_middle": flag("age >= 30 AND age < 50"),
        "age_bin_senior": flag("age >= 50"), "bmi_underweight": flag("bmi < 18.5"),
        "bmi_normal": flag("bmi >= 18.5 AND bmi < 25"), "bmi_overweight": flag("bmi >= 25 AND bmi < 30"),
        "bmi_obese": flag("bmi >= 30"),
        "substance_total": "caffeine_consumption + alcohol_consumption * 2 + smoking * 3",
        "medical_burden": "medical_issue + ongoing_medication",
        "sleep_composite": "sleep_duration * sleep_quality - wake_up_during_night * 2 - feel_sleepy_during_day",
    })
    return out


def features(listed: dict) -> str:
    return f"{STD} SELECT row_id, " + ", ".join(f"{x} AS {n}" for n, x in listed.items()) + " FROM std"


LABELLED = (
    f"{SCORED}, plain AS (SELECT *, {Y} AS y FROM std WHERE {Y} IS NOT NULL), points AS (SELECT row_id, y, age_band, gender, "
    "CAST(least(100, a) AS DOUBLE) / 100.0::DOUBLE AS prob_a, "
    "CAST(least(100, least(100, a) + 15 * s) AS DOUBLE) / 100.0::DOUBLE AS prob_b FROM (SELECT *, "
    "CASE WHEN average_screen_time >= 8 THEN 30 WHEN average_screen_time >= 6 THEN 20 WHEN average_screen_time >= 4 THEN 10 ELSE 0 END "
    "+ CASE WHEN sleep_quality <= 2 THEN 25 WHEN sleep_quality <= 3 THEN 15 ELSE 0 END "
    "+ CASE WHEN sleep_duration < 6 THEN 15 WHEN sleep_duration < 7 THEN 10 ELSE 0 END "
    "+ CASE WHEN stress_level >= 4 THEN 15 WHEN stress_level >= 3 THEN 10 ELSE 0 END "
    "+ CASE WHEN smart_device_before_bed = 1 THEN 10 ELSE 0 END AS a, "
    f"{SUM3} AS s FROM plain))"
)
SPLIT = (
    f"{LABELLED}, placed AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS r, "
    "COUNT(*) OVER (PARTITION BY y) AS c FROM points), parts AS (SELECT *, CASE WHEN r <= floor(0.2::DOUBLE * c + 0.5) THEN 'test' "
    "WHEN r <= floor(0.4::DOUBLE * c + 0.5) THEN 'val' ELSE 'train' END AS split FROM placed)"
)


def _fold(k: int, key: str, label: str, source: str) -> str:
    """Rows of ``source`` with ``fold``: quotas per class by the order of a hash."""
    steps = " ".join(f"WHEN r <= floor({round((i + 1) / k, 12)!r}::DOUBLE * c + 0.5) THEN {i}" for i in range(k - 1))
    return (
        f"SELECT *, CAST(CASE {steps} ELSE {k - 1} END AS INTEGER) AS fold FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {label} ORDER BY md5('fold42:' || {key})) AS r, COUNT(*) OVER (PARTITION BY {label}) AS c FROM {source})"
    )


def evaluate(source: str, score: str, y: str, threshold: float, keys: str = "") -> str:
    """rows, areas and confusion at a threshold, per key."""
    by = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    known = "".join(f" AND {k.strip()} IS NOT NULL" for k in keys.split(",") if k.strip())
    group = f"GROUP BY {keys}" if keys else ""
    t = f"{threshold}::DOUBLE"
    return (
        f"SELECT {by}CAST(p + q AS BIGINT) AS rows, round(CASE WHEN p > 0 AND q > 0 THEN area / (CAST(p AS DOUBLE) * q) END, 6) AS roc_auc, "
        "round(CASE WHEN p > 0 AND q > 0 THEN step / p END, 6) AS pr_auc, "
        "CAST(q - hq AS BIGINT) AS tn, CAST(hq AS BIGINT) AS fp, CAST(p - hp AS BIGINT) AS fn, CAST(hp AS BIGINT) AS tp, "
        "round(COALESCE(CAST(hp AS DOUBLE) / NULLIF(hp + hq, 0), 0.0), 6) AS precision, "
        "round(COALESCE(CAST(hp AS DOUBLE) / NULLIF(p, 0), 0.0), 6) AS recall, "
        "round(COALESCE(CAST(2 * hp AS DOUBLE) / NULLIF(hp + hq + p, 0), 0.0), 6) AS f1 FROM ("
        f"SELECT {by}SUM(pos) AS p, SUM(n - pos) AS q, SUM((n - pos) * (cp - pos / 2.0::DOUBLE)) AS area, "
        "SUM(pos * (CAST(cp AS DOUBLE) / cn)) AS step, "
        f"SUM(CASE WHEN {score} >= {t} THEN pos ELSE 0 END) AS hp, SUM(CASE WHEN {score} >= {t} THEN n - pos ELSE 0 END) AS hq FROM ("
        f"SELECT *, SUM(pos) OVER w AS cp, SUM(n) OVER w AS cn FROM (SELECT {by}{score}, CAST(SUM({y}) AS BIGINT) AS pos, COUNT(*) AS n "
        f"FROM {source} WHERE {score} IS NOT NULL AND {y} IS NOT NULL{known} GROUP BY {by}{score}) WINDOW w AS ({part}ORDER BY {score} DESC)) {group})"
    )


def grid(start: float, count: int) -> str:
    return "[" + ", ".join(f"{round(start + 0.01 * i, 2)}::DOUBLE" for i in range(count)) + "]"


def curve(start: float, count: int, score: str = "prob_b") -> str:
    return (
        f", grid AS (SELECT unnest({grid(start, count)}) AS threshold), hits AS (SELECT threshold, "
        f"COUNT(CASE WHEN y = 1 AND {score} >= threshold THEN 1 END) AS tp, COUNT(CASE WHEN y = 0 AND {score} >= threshold THEN 1 END) AS fp, "
        f"COUNT(CASE WHEN y = 1 AND {score} < threshold THEN 1 END) AS fn, COUNT(CASE WHEN y = 0 AND {score} < threshold THEN 1 END) AS tn "
        "FROM points, grid GROUP BY threshold), curve AS (SELECT *, COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0) AS precision, "
        "COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0) AS recall, "
        "COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1 FROM hits)"
    )


def best(start: float, count: int, measure: str, default: float) -> str:
    return (
        f"{LABELLED}{curve(start, count)}, m AS (SELECT threshold, {measure} AS measure FROM curve), "
        "top AS (SELECT * FROM m WHERE measure > 0 ORDER BY measure DESC, threshold LIMIT 1) "
        f"SELECT COALESCE((SELECT threshold FROM top), {default}::DOUBLE) AS threshold, "
        "round(COALESCE((SELECT measure FROM top), 0.0), 6) AS measure"
    )


SCREENING = (
    f"{LABELLED}{curve(0.10, 40, 'prob_a')}, mixed AS (SELECT *, 0.5::DOUBLE * recall + 0.3::DOUBLE * precision + 0.2::DOUBLE * f1 AS mix FROM curve), "
    "kept AS (SELECT threshold, mix FROM mixed WHERE recall >= 0.995 ORDER BY precision DESC, threshold LIMIT 1), "
    "later AS (SELECT threshold, mix FROM mixed WHERE recall < 0.995 ORDER BY mix DESC, threshold LIMIT 1) "
    "SELECT COALESCE(CASE WHEN (SELECT mix FROM later) > COALESCE((SELECT mix FROM kept), -1) THEN (SELECT threshold FROM later) "
    "ELSE (SELECT threshold FROM kept) END, 0.5::DOUBLE) AS threshold"
)


def youden(source: str, score: str, y: str) -> str:
    return (
        f"SELECT round({score}, 6) AS threshold, round(j, 6) AS youden_j FROM (SELECT {score}, CAST(SUM(pos) OVER w AS DOUBLE) / (SUM(pos) OVER ()) "
        f"- CAST(SUM(n - pos) OVER w AS DOUBLE) / (SUM(n - pos) OVER ()) AS j FROM (SELECT {score}, CAST(SUM({y}) AS BIGINT) AS pos, "
        f"COUNT(*) AS n FROM {source} WHERE {y} IS NOT NULL GROUP BY {score}) WINDOW w AS (ORDER BY {score} DESC)) ORDER BY j DESC, {score} DESC LIMIT 1"
    )


LINES = (
    "WITH lines AS (SELECT l_returnflag, l_extendedprice / (l_extendedprice + 50000.0::DOUBLE) AS score, "
    "CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS deep FROM lineitem)"
)
METRIC_NAMES = ("roc_auc", "pr_auc", "precision", "recall", "f1")
PER_SPLIT = (
    f"{SPLIT}, ea AS ({evaluate('parts', 'prob_a', 'y', 0.5, 'split')}), eb AS ({evaluate('parts', 'prob_b', 'y', 0.5, 'split')})"
).replace("round(", "(").replace(", 6) AS roc_auc", ") AS roc_auc").replace(", 6) AS pr_auc", ") AS pr_auc").replace(
    ", 6) AS precision", ") AS precision").replace(", 6) AS recall", ") AS recall").replace(", 6) AS f1", ") AS f1")
COMPARED = (
    f"{PER_SPLIT}, cmp AS ("
    + union([f"SELECT ea.split, '{m}' AS metric, ea.{m} AS base, eb.{m} AS improved FROM ea JOIN eb ON ea.split = eb.split" for m in METRIC_NAMES])
    + "), known AS (SELECT *, improved - base AS diff, CASE WHEN base > 0 THEN (improved - base) / base * 100 ELSE 0.0 END AS diff_pct FROM cmp "
    "WHERE base IS NOT NULL AND improved IS NOT NULL)"
)
def _unrounded(score: str, threshold: float) -> str:
    text = evaluate("parts", score, "y", threshold, "split").replace("round(", "(")
    for name in METRIC_NAMES:
        text = text.replace(f", 6) AS {name}", f") AS {name}")
    return text


_REPORT = f"{SPLIT}, ea AS ({_unrounded('prob_a', 0.5)}), eb AS ({_unrounded('prob_b', 0.3)})"
COMPARISON_REPORT = (
    f"{_REPORT}, cmp AS ("
    + union(
        [f"SELECT ea.split, '{m}' AS metric, CAST(ea.{m} AS DOUBLE) AS base, CAST(eb.{m} AS DOUBLE) AS improved FROM ea JOIN eb ON ea.split = eb.split"
         for m in (*METRIC_NAMES, "tn", "fp", "fn", "tp")]
        + ["SELECT split, 'threshold' AS metric, 0.5::DOUBLE AS base, 0.3::DOUBLE AS improved FROM ea"]
    )
    + "), known AS (SELECT *, improved - base AS diff, CASE WHEN base > 0 THEN (improved - base) / base * 100 ELSE 0.0 END AS diff_pct FROM cmp "
    "WHERE base IS NOT NULL AND improved IS NOT NULL) SELECT 'A/B' AS stage, split, metric, round(base, 6) AS base, round(improved, 6) AS improved, "
    "round(diff, 6) + 0.0 AS diff, round(diff_pct, 6) + 0.0 AS diff_pct, CASE WHEN diff > 0 THEN 'up' WHEN diff < 0 THEN 'down' ELSE 'same' END AS arrow FROM known"
)
STAGE_FEATURES = f"{STD} " + union(
    [f"SELECT '{stage}' AS stage, {i}::INTEGER AS place, '{c}' AS feature, COUNT({c}) AS known, {c in SYMPTOMS} AS forbidden_in_a FROM std"
     for stage, listed in (("A", STAGE_A), ("B", STAGE_B)) for i, c in enumerate(listed)]
)


def _digamma(x: str) -> str:
    up = f"({x} + 10)"
    back = " + ".join(f"1.0::DOUBLE / ({x} + {i})" for i in range(10))
    return f"(ln({up}) - 1 / (2 * {up}) - 1 / (12 * {up}**2) + 1 / (120 * {up}**4) - 1 / (252 * {up}**6) - ({back}))"


INFORMATION = (
    f"{STD}, long AS (" + union(
        [f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, {Y} AS y FROM std WHERE {c} IS NOT NULL AND {Y} IS NOT NULL"
         for c in ("age", "sleep_duration", "sleep_quality", "average_screen_time", "stress_level", "heart_rate", "daily_steps", "symptom_score")]
    ) + "), v AS (SELECT *, SUM(n) OVER (PARTITION BY feature, y) AS in_class, least(3, SUM(n) OVER (PARTITION BY feature, y) - 1) AS k "
    "FROM (SELECT feature, y, x, COUNT(*) AS n FROM long GROUP BY ALL)), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY feature, y ORDER BY x) AS place FROM v), "
    "near AS (SELECT *, place + unnest(range(-3, 4)) AS there FROM o), "  # no more than k values on either side matter
    "pairs AS (SELECT a.feature, a.y, a.x, a.k, b.x AS other, abs(b.x - a.x) AS gap, SUM(b.n - CASE WHEN a.x = b.x THEN 1 ELSE 0 END) OVER "
    "(PARTITION BY a.feature, a.y, a.x ORDER BY abs(b.x - a.x) RANGE UNBOUNDED PRECEDING) AS upto "
    "FROM near a JOIN o b ON a.feature = b.feature AND a.y = b.y AND a.there = b.place), "
    "d AS (SELECT feature, y, x, MIN(gap) AS d FROM pairs WHERE upto >= k GROUP BY ALL), "
    "ends AS (SELECT d.feature, d.y, d.x, d.d, COALESCE(MAX(CASE WHEN other < d.x AND d.x - other = d.d THEN other END), d.x - d.d) AS low, "
    "COALESCE(MAX(CASE WHEN other > d.x AND other - d.x = d.d THEN other END), d.x + d.d) AS high "
    "FROM d JOIN pairs ON d.feature = pairs.feature AND d.y = pairs.y AND d.x = pairs.x GROUP BY d.feature, d.y, d.x, d.d), "
    "u AS (SELECT feature, x, n, SUM(n) OVER (PARTITION BY feature ORDER BY x) AS upto FROM (SELECT feature, x, SUM(n) AS n FROM v GROUP BY ALL)), "
    "m AS (SELECT e.feature, e.y, e.x, CASE WHEN e.d = 0 THEN u.n ELSE h.upto - COALESCE(l.upto, 0) END AS m FROM ends e "
    "JOIN u ON e.feature = u.feature AND e.x = u.x ASOF LEFT JOIN u h ON e.feature = h.feature AND e.high > h.x ASOF LEFT JOIN u l ON e.feature = l.feature AND e.low >= l.x), "
    f"p AS (SELECT feature, SUM(n) AS total, SUM(n * ({_digamma('k')} - {_digamma('in_class')} - {_digamma('m')})) AS parts FROM v JOIN m USING (feature, y, x) GROUP BY ALL) "
    f"SELECT feature, CAST(total AS BIGINT) AS rows, round(greatest({_digamma('total')} + parts / total, 0.0), 6) + 0.0 AS mutual_information FROM p"
)
OVERFIT = (
    f"{PER_SPLIT}, m AS (SELECT 'A' AS stage, split, roc_auc FROM ea UNION ALL SELECT 'B', split, roc_auc FROM eb), "
    "wide AS (SELECT stage, MAX(CASE WHEN split = 'train' THEN roc_auc END) AS train_auc, MAX(CASE WHEN split = 'val' THEN roc_auc END) AS val_auc, "
    "MAX(CASE WHEN split = 'test' THEN roc_auc END) AS test_auc FROM m GROUP BY stage) "
    "SELECT stage, round(train_auc, 6) AS train_auc, round(val_auc, 6) AS val_auc, round(test_auc, 6) AS test_auc, "
    "round(val_auc - test_auc, 6) + 0.0 AS gap, val_auc - test_auc > 0.2 AS overfitting, "
    "CASE WHEN val_auc - test_auc > 0.2 THEN 'gap' WHEN test_auc < 0.5 THEN 'low_test' END AS stop_reason, "
    "CASE WHEN train_auc - test_auc < 0.10 THEN 'low' WHEN train_auc - test_auc < 0.15 THEN 'medium' ELSE 'high' END AS train_gap_band FROM wide"
)
RUNS = (
    f"{LABELLED}, runs AS (SELECT 1 AS iteration, y, prob_a AS score FROM points UNION ALL SELECT 2, y, prob_b FROM points "
    "UNION ALL SELECT 3, y, (prob_a + prob_b) / 2.0::DOUBLE FROM points)"
)
DOCS = (
    "WITH docs AS (SELECT d.doc_id, lang, quality, n_chars / (n_chars + 2000.0::DOUBLE) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)
TOXIC = "WITH docs AS (SELECT d.doc_id, source, quality, toxic, n_chars / (n_chars + 2000.0::DOUBLE) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
TOMEK_COLUMNS = ["age", "bmi", "sleep_duration", "average_screen_time", "stress_level", "daily_steps"]
TOMEK = (
    f"{STD}, placed AS (SELECT *, row_number() OVER (PARTITION BY {Y} ORDER BY md5('42:' || row_id)) AS r, COUNT(*) OVER (PARTITION BY {Y}) AS c "
    f"FROM std WHERE {Y} IS NOT NULL), train AS (SELECT row_id, {Y} AS y, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in TOMEK_COLUMNS)
    + " FROM placed WHERE r > floor(0.4::DOUBLE * c + 0.5)), med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in TOMEK_COLUMNS)
    + " FROM train), points AS (SELECT row_id, y, " + ", ".join(f"COALESCE({c}, m_{c}) AS {c}" for c in TOMEK_COLUMNS)
    + " FROM train, med), near AS (SELECT a.row_id AS id, ANY_VALUE(a.y) AS y, min({'d': sqrt("
    + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in TOMEK_COLUMNS)
    + "), 'id': b.row_id}).id AS other FROM points a JOIN points b ON a.row_id <> b.row_id GROUP BY a.row_id) "
    "SELECT p.id AS low, q.id AS high FROM near p JOIN near q ON p.other = q.id AND q.other = p.id WHERE p.y <> q.y AND p.id < q.id"
)
UNIT = "('0x' || substr(md5('42:{}:' || row_id || ':' || copy), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
SMOTE = (
    TOMEK[: TOMEK.index(", near AS")]
    + ", sizes AS (SELECT COUNT(CASE WHEN y = 0 THEN 1 END) AS few, COUNT(CASE WHEN y = 1 THEN 1 END) AS many FROM points), "
    "need AS (SELECT few, CAST(round(0.8::DOUBLE * many) AS BIGINT) - few AS wanted FROM sizes), small AS (SELECT * FROM points WHERE y = 0), "
    "near AS (SELECT a.row_id, min({'d': sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in TOMEK_COLUMNS)
    + "), 'id': b.row_id}, 5) AS near FROM small a JOIN small b ON a.row_id <> b.row_id GROUP BY a.row_id), "
    "ranked AS (SELECT small.*, near, wanted, few, row_number() OVER (ORDER BY md5('42:' || small.row_id)) AS r FROM small JOIN near USING (row_id), need), "
    "copies AS (SELECT *, unnest(range(1, wanted // few + CASE WHEN r <= wanted % few THEN 2 ELSE 1 END)) AS copy FROM ranked), "
    f"picked AS (SELECT *, near[1 + CAST(floor({UNIT.format('near')} * len(near)) AS INTEGER)].id AS other, {UNIT.format('gap')} AS gap FROM copies) "
    f"SELECT row_id, y AS {Y}, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in TOMEK_COLUMNS) + ", 0 AS synthetic FROM points UNION ALL "
    "SELECT -(p.row_id * (wanted // few + 2) + copy), p.y, " + ", ".join(f"round(p.{c} + gap * (o.{c} - p.{c}), 6) + 0.0" for c in TOMEK_COLUMNS)
    + ", 1 FROM picked p JOIN small o ON o.row_id = p.other"
)
KNN_COLUMNS = ["age", "sleep_duration", "sleep_quality", "average_screen_time", "stress_level", "heart_rate", "daily_steps", "physical_activity"]
KNN_SEEN = " + ".join(f"(CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN 0 ELSE 1 END)" for c in KNN_COLUMNS)
KNN = (
    f"{STD}, points AS (SELECT row_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in KNN_COLUMNS) + " FROM std), "
    "asking AS (SELECT * FROM points WHERE " + " OR ".join(f"{c} IS NULL" for c in KNN_COLUMNS) + "), "
    "pairs AS (SELECT a.row_id, b.row_id AS other, sqrt(("
    + " + ".join(f"COALESCE((a.{c} - b.{c}) * (a.{c} - b.{c}), 0.0)" for c in KNN_COLUMNS)
    + f") * (8.0::DOUBLE / NULLIF({KNN_SEEN}, 0))) AS d, "
    + ", ".join(f"CASE WHEN a.{c} IS NULL THEN b.{c} END AS {c}" for c in KNN_COLUMNS)
    + " FROM asking a, points b), near AS (SELECT row_id, "
    + ", ".join(f"list_avg(list_transform(min({{'d': d, 'id': other, 'v': {c}}}, 5) FILTER (WHERE {c} IS NOT NULL AND d IS NOT NULL), lambda x: x.v)) AS {c}" for c in KNN_COLUMNS)
    + " FROM pairs GROUP BY row_id) SELECT p.row_id, "
    + ", ".join(f"round(COALESCE(p.{c}, n.{c}, (SELECT AVG({c}) FROM points)), 6) + 0.0 AS {c}" for c in KNN_COLUMNS)
    + " FROM points p LEFT JOIN near n ON p.row_id = n.row_id"
)
HALF = (
    "WITH half AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'base' ELSE 'current' END AS snapshot, "
    "CAST(json_extract_string(props, '$.k') AS DOUBLE) AS props_k FROM events)"
)


def psi_of(bins: str, tail: str, name: str = "") -> str:
    label = f"'{name}' AS feature, " if name else ""
    share = "greatest(CAST({0} AS DOUBLE) / SUM({0}) OVER (), 1e-6)"
    return (
        f"SELECT {label}round(SUM((c - b) * ln(c / b)), 6) + 0.0 AS psi FROM (SELECT {share.format('nb')} AS b, {share.format('nc')} AS c FROM ("
        f"SELECT {bins} AS bin, COUNT(CASE WHEN snapshot = 'base' THEN 1 END) AS nb, COUNT(CASE WHEN snapshot = 'current' THEN 1 END) AS nc "
        f"FROM half {tail} GROUP BY 1))"
    )


def drift_part(c: str) -> str:
    cuts = ", ".join(f"quantile_disc({c}, {i / 10})" for i in range(1, 10))
    return psi_of(
        f"CASE WHEN {c} IS NULL THEN -1 ELSE len(list_filter((SELECT list_distinct([{cuts}]) FROM half WHERE snapshot = 'base'), lambda e: e < {c})) END",
        "", c,
    )


PROFILE_TYPES = {c: "bigint" for c in NUMERIC} | {
    "bmi": "double", "sleep_duration": "double", "average_screen_time": "double", "gender": "int",
    "age_band": "string", "blood_pressure_raw": "string", Y: "int",
}

ORACLES = {
    "missing_analysis": f"{STD} " + union([
        f"SELECT '{c}' AS feature, COUNT(*) - COUNT({c}) AS missing, (COUNT(*) - COUNT({c})) * 100 / CAST(COUNT(*) AS DOUBLE) AS percentage, "
        f"(COUNT(*) - COUNT({c})) * 100 / CAST(COUNT(*) AS DOUBLE) > 50 AS high_missing FROM std" for c in STAGE_B]),
    "class_distribution": f"{STD}, c AS (SELECT COUNT({Y}) AS total, COUNT(CASE WHEN {Y} = 0 THEN 1 END) AS class_0, COUNT(CASE WHEN {Y} = 1 THEN 1 END) AS class_1 FROM std) "
    "SELECT *, class_0 * 100 / CAST(total AS DOUBLE) AS percent_0, class_1 * 100 / CAST(total AS DOUBLE) AS percent_1, CAST(class_0 AS DOUBLE) / class_1 AS imbalance_ratio FROM c",
    "majority_baseline": f"{STD} SELECT CAST(MAX(n) AS DOUBLE) / SUM(n) AS majority_accuracy FROM (SELECT {Y}, COUNT(*) AS n FROM std WHERE {Y} IS NOT NULL GROUP BY 1)",
    "feature_stats": f"{STD} " + stats("std", NUMERIC),
    "feature_stats_lineitem": stats("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], 4),
    "label_correlations": f"{STD}{FILLED}, c AS (" + union([corr(c, Y, "filled", c) for c in STAGE_B])
    + ") SELECT feature, correlation, abs(correlation) AS strength, CASE WHEN correlation > 0 THEN 'positive' WHEN correlation < 0 THEN 'negative' ELSE 'none' END AS sign, "
    "CAST(row_number() OVER (ORDER BY abs(correlation) DESC, feature) AS INTEGER) AS rank FROM c",
    "correlation_top": f"{STD}, c AS (" + union([corr(c, Y, "std", c) for c in [*STAGE_B, "symptom_score", "validity_ratio"]])
    + ") SELECT feature, abs(correlation) AS strength FROM c ORDER BY 2 DESC, 1 LIMIT 15",
    "correlation_lineitem": "WITH l AS (SELECT *, 1 AS one FROM lineitem) "
    + union([corr(c, "l_discount", "l", c) for c in ("l_quantity", "l_extendedprice", "l_tax", "one")]),
    "leak_alarm": f"{STD}, c AS (" + union([corr(c, Y, "std", c) for c in ["symptom_score", *SYMPTOMS]]) + ") SELECT *, abs(correlation) > 0.8 AS alarm FROM c",
    "column_profile": f"{STD} " + union([
        f"SELECT '{c}' AS column_name, '{t}' AS dtype, COUNT({c}) AS non_null, COUNT(*) - COUNT({c}) AS nulls, "
        f"(COUNT(*) - COUNT({c})) * 100 / CAST(COUNT(*) AS DOUBLE) AS null_pct FROM std" for c, t in PROFILE_TYPES.items()]),
    "categorical_top5": f"WITH {RAW} " + top_values("raw", ["gender", "smoking", "blood_pressure", "medical_issue", "redness_in_eye"]),
    "categorical_top5_part": top_values("part", ["p_name", "p_brand", "p_type"]),
    "factorize": f"WITH {RAW} SELECT row_id, " + ", ".join(code(c) for c in ("gender", "smoking", "redness_in_eye")) + " FROM raw",
    "mutual_info_binned": f"{STD} " + union([information(c) for c in [*NUMERIC, *SYMPTOMS, "symptom_score"]]),
    "label_conflicts": f"{STD}, g AS (SELECT AVG({Y}) AS mean FROM std WHERE age_band IS NOT NULL AND gender IS NOT NULL AND stress_level IS NOT NULL "
    "AND sleep_quality IS NOT NULL AND symptom_score IS NOT NULL AND smoking IS NOT NULL GROUP BY age_band, gender, stress_level, sleep_quality, symptom_score, smoking) "
    "SELECT COUNT(*) AS combinations, COUNT(CASE WHEN mean > 0 AND mean < 1 THEN 1 END) AS conflicts, "
    "COUNT(CASE WHEN mean > 0 AND mean < 1 THEN 1 END) * 100 / CAST(COUNT(*) AS DOUBLE) AS percentage FROM g",
    "features_base": features(BASE),
    "features_medical": features(MEDICAL),
    "features_safe": features(SAFE),
    "features_quick": features(QUICK),
    "features_wide": features(wide()),
    "target_encode": "WITH j AS (SELECT d.doc_id, source, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id), g AS (SELECT AVG(toxic) AS m FROM j), "
    "t AS (SELECT source, (SUM(toxic) + 10 * (SELECT m FROM g)) / (COUNT(*) + 10) AS e FROM j WHERE toxic IS NOT NULL GROUP BY source) "
    "SELECT doc_id, j.source, round(COALESCE(e, (SELECT m FROM g)), 6) + 0.0 AS source_encoded FROM j LEFT JOIN t ON j.source = t.source",
    "target_encode_lineitem": "WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS deep FROM lineitem), "
    "g AS (SELECT AVG(deep) AS m FROM j), t AS (SELECT l_partkey, (SUM(deep) + 10 * (SELECT m FROM g)) / (COUNT(*) + 10) AS e FROM j GROUP BY 1) "
    "SELECT l_orderkey, l_linenumber, j.l_partkey, round(e, 6) + 0.0 AS l_partkey_encoded FROM j LEFT JOIN t ON j.l_partkey = t.l_partkey",
    "model_matrix": f"WITH {RAW}, c AS (SELECT *, CASE upper({Y}) WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS yy FROM raw) SELECT row_id, yy AS {Y}, "
    "CAST(age AS DOUBLE) AS age, CAST(sleep_duration AS DOUBLE) AS sleep_duration, "
    + ", ".join(
        f"CAST(CASE WHEN upper({c}) IN ('Y', 'YES', 'TRUE') THEN 1 WHEN upper({c}) IN ('N', 'NO', 'FALSE') THEN 0 ELSE TRY_CAST({c} AS DOUBLE) END AS DOUBLE) AS {c}"
        for c in ("smoking", "medical_issue", "redness_in_eye", "blood_pressure"))
    + " FROM c WHERE yy IS NOT NULL",
    "median_impute": f"{STD}{FILLED} SELECT row_id, {Y}, " + ", ".join(STAGE_A) + " FROM filled",
    "mode_impute": f"{STD} SELECT row_id, " + ", ".join(
        f"COALESCE({c}, CASE WHEN (SELECT SUM({c}) * 2 > COUNT({c}) FROM std) THEN 1 ELSE 0 END) AS {c}"
        for c in ("smoking", "smart_device_before_bed", "redness_in_eye")) + " FROM std",
    "scale_standard": f"{STD}, f AS (SELECT " + ", ".join(f"AVG(CAST({c} AS DOUBLE)) AS m_{c}, COALESCE(NULLIF(stddev_pop(CAST({c} AS DOUBLE)), 0), 1) AS s_{c}" for c in NUMERIC)
    + " FROM std) SELECT row_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in NUMERIC) + " FROM std, f",
    "scale_robust": f"{STD}, f AS (SELECT " + ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}, COALESCE(NULLIF(quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25), 0), 1) AS s_{c}" for c in NUMERIC)
    + " FROM std) SELECT row_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in NUMERIC) + " FROM std, f",
    "anova_topk": f"{STD} SELECT feature, round(f_value, 4) + 0.0 AS f_value FROM (" + union([
        f"SELECT '{c}' AS feature, (SUM(n * (mean - gm) * (mean - gm)) / (COUNT(*) - 1)) / (SUM(n * var) / (SUM(n) - COUNT(*))) AS f_value FROM ("
        f"SELECT *, SUM(n * mean) OVER () / SUM(n) OVER () AS gm FROM (SELECT {Y}, COUNT({c}) AS n, AVG(CAST({c} AS DOUBLE)) AS mean, var_pop(CAST({c} AS DOUBLE)) AS var "
        f"FROM std WHERE {Y} IS NOT NULL GROUP BY {Y}))" for c in [*STAGE_B, "symptom_score"]]) + ") ORDER BY f_value DESC, feature LIMIT 25",
    "class_weights": f"{STD}, c AS (SELECT COUNT(CASE WHEN {Y} = 0 THEN 1 END) AS n0, COUNT(CASE WHEN {Y} = 1 THEN 1 END) AS n1 FROM std) "
    "SELECT n0, n1, CAST(n0 AS DOUBLE) / n1 AS scale_pos_weight, CAST(n0 + n1 AS DOUBLE) / (n0 * 2) AS weight_0, CAST(n0 + n1 AS DOUBLE) / (n1 * 2) AS weight_1 FROM c",
    "stratified_split": f"{SPLIT} SELECT row_id, y, split FROM parts",
    "stratified_folds": f"{LABELLED} SELECT row_id, y, fold FROM ({_fold(5, 'row_id', 'y', 'points')})",
    "fold_sizes": "WITH d AS (SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL) "
    f"SELECT fold, quality AS class, COUNT(*) AS n FROM ({_fold(3, 'doc_id', 'quality', 'd')}) GROUP BY ALL",
    "split_report": f"{SPLIT} SELECT split, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS positives, AVG(y) AS positive_rate FROM parts GROUP BY split",
    "binary_metrics": f"{LABELLED} " + evaluate("points", "prob_b", "y", 0.5),
    "binary_metrics_lineitem": f"{LINES} " + evaluate("lines", "score", "deep", 0.4, "l_returnflag"),
    "binary_metrics_documents": f"{DOCS} " + evaluate("docs", "score", "quality", 0.5, "lang"),
    "confusion_matrix": f"{LABELLED} SELECT gender, COUNT(CASE WHEN y = 0 AND prob_b < 0.6 THEN 1 END) AS tn, COUNT(CASE WHEN y = 0 AND prob_b >= 0.6 THEN 1 END) AS fp, "
    "COUNT(CASE WHEN y = 1 AND prob_b < 0.6 THEN 1 END) AS fn, COUNT(CASE WHEN y = 1 AND prob_b >= 0.6 THEN 1 END) AS tp FROM points GROUP BY gender",
    "threshold_curve": f"{LABELLED}{curve(0.10, 80)} SELECT threshold, tn, fp, fn, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM curve",
    "threshold_recall": best(0.10, 80, "recall", 0.5),
    "threshold_f1": best(0.10, 80, "f1", 0.5),
    "threshold_f1_narrow": best(0.20, 50, "f1", 0.5),
    "threshold_screening": SCREENING,
    "threshold_triage": best(0.20, 40, "0.5::DOUBLE * f1 + 0.3::DOUBLE * recall + 0.2::DOUBLE * precision", 0.4),
    "threshold_youden": f"{LABELLED} " + youden("points", "prob_b", "y"),
    "threshold_youden_lineitem": f"{LINES} " + youden("lines", "score", "deep"),
    "calibration_documents": f"{TOXIC} SELECT source, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, COUNT(*) AS n, round(AVG(score), 6) AS mean_score, "
    "round(AVG(quality), 6) AS rate FROM docs GROUP BY 1, 2",
    "class_weights_documents": f"{TOXIC}, c AS (SELECT COUNT(CASE WHEN toxic = 0 THEN 1 END) AS n0, COUNT(CASE WHEN toxic = 1 THEN 1 END) AS n1 FROM docs) "
    "SELECT n0, n1, CAST(n0 AS DOUBLE) / n1 AS scale_pos_weight, CAST(n0 + n1 AS DOUBLE) / (n0 * 2) AS weight_0, CAST(n0 + n1 AS DOUBLE) / (n1 * 2) AS weight_1 FROM c",
    "split_documents": f"{TOXIC}, placed AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id)) AS r, COUNT(*) OVER (PARTITION BY toxic) AS c "
    "FROM docs) SELECT doc_id, toxic, CASE WHEN r <= floor(0.15::DOUBLE * c + 0.5) THEN 'test' WHEN r <= floor(0.3::DOUBLE * c + 0.5) THEN 'val' ELSE 'train' END AS split FROM placed",
    "tomek_links": TOMEK,
    "knn_impute": KNN,
    "smote": SMOTE,
    "overfit_check": OVERFIT,
    "best_checkpoint": f"{RUNS}, e AS ({evaluate('runs', 'score', 'y', 0.5, 'iteration')}), "
    "b AS (SELECT iteration, roc_auc, COALESCE(MAX(roc_auc) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS best_before FROM e) "
    "SELECT 'B' AS stage, CAST(iteration AS INTEGER) AS iteration, roc_auc, best_before FROM b WHERE roc_auc > best_before",
    "comparison_report": COMPARISON_REPORT,
    "stage_features": STAGE_FEATURES,
    "mutual_info_nearest": INFORMATION,
    "model_comparison": f"{COMPARED} SELECT split, metric, round(base, 6) + 0.0 AS base, round(improved, 6) + 0.0 AS improved, round(diff, 6) + 0.0 AS diff, round(diff_pct, 6) + 0.0 AS diff_pct, "
    "CASE WHEN diff > 0 THEN 'up' WHEN diff < 0 THEN 'down' ELSE 'same' END AS arrow FROM known",
    "comparison_summary": f"{COMPARED} SELECT round(AVG(diff_pct), 4) + 0.0 AS avg_improvement, COUNT(CASE WHEN diff_pct > 0 THEN 1 END) AS improved, COUNT(*) AS compared FROM known WHERE base > 0",
    "subgroup_metrics": f"{LABELLED} " + evaluate("points", "prob_b", "y", 0.5, "age_band, gender"),
    "calibration_bins": f"{LABELLED} SELECT CAST(least(floor(prob_b * 10), 9) AS INTEGER) AS bin, COUNT(*) AS n, round(AVG(prob_b), 6) + 0.0 AS mean_score, round(AVG(y), 6) + 0.0 AS rate FROM points GROUP BY 1",
    "quality_alerts": f"{STD}, m AS ({MISSING_UNION}), l AS (SELECT *, CASE column_name WHEN 'systolic' THEN 0.3 WHEN 'diastolic' THEN 0.6 WHEN 'age' THEN 0.2 WHEN 'bmi' THEN 0.25 "
    f"WHEN '{Y}' THEN 0.001 ELSE 0.2 END::DOUBLE AS max_rate FROM m) SELECT * FROM l WHERE missing_rate > max_rate",
    "drift_psi": f"{HALF} " + union([drift_part(c) for c in ("value", "user_id", "props_k")]),
    "drift_types": f"{HALF} " + psi_of("event_type", "", "event_type"),
    "monitor_monthly": "SELECT date_trunc('month', ts) AS month, event_type, COUNT(*) AS n, AVG(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS missing_rate, "
    "round(AVG(value), 6) + 0.0 AS mean_value, round(AVG(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS high_rate FROM events GROUP BY 1, 2",
    "stage_report": f"{STD} SELECT 'B' AS stage, {len(STAGE_B)}::INTEGER AS features, CAST(COUNT(CASE WHEN {Y} = 0 THEN 1 END) AS DOUBLE) / COUNT(CASE WHEN {Y} = 1 THEN 1 END) AS imbalance_ratio, "
    f"{len(STAGE_B)}::INTEGER AS correlations, {len(STAGE_B)}::INTEGER AS importances, 2::INTEGER AS baselines FROM std",
    "dataset_content": "SELECT COUNT(*) AS rows, CAST(SUM(('0x' || substr(md5(concat_ws('|', " + ", ".join(
        f"coalesce('=' || {c}, '-')" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    + ")), 1, 15))::BIGINT) AS VARCHAR) AS digest FROM orders",
    "registry_latest": "WITH e AS (SELECT o_orderpriority || '/' || strftime(o_orderdate, '%Y-%m') AS model_version, MAX(o_orderdate) AS created_at, o_orderpriority, "
    "round(AVG(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS roc_auc FROM orders GROUP BY 1, 3) "
    "SELECT model_version, created_at, sha256(o_orderpriority) AS dataset_hash, stage, roc_auc, 0.5::DOUBLE AS threshold, 'loaded' AS status FROM ("
    "SELECT * FROM e WHERE o_orderpriority < '3' ORDER BY created_at DESC, model_version DESC LIMIT 1), (VALUES ('A'), ('B')) s(stage)",
}
