"""SQL expressions of the rule score and of what follows from it."""

from __future__ import annotations

from cohortlens import schema
from cohortlens.functions.clean import quoted

# --- fixed values: points per condition; the first that holds counts -------
POINTS = {
    "average_screen_time": [(">= 8", 30), (">= 6", 20), (">= 4", 10)],
    "sleep_quality": [("<= 2", 25), ("<= 3", 15)],
    "sleep_duration": [("< 6", 15), ("< 7", 10)],
    "stress_level": [(">= 4", 15), (">= 3", 10)],
    "smart_device_before_bed": [("= 1", 10)],
}
SYMPTOM_POINTS = 15
# --- fixed values: factor, condition, strength, note code ------------------
FACTORS = [
    ("average_screen_time", ">= 6", "High", "screen_time_high"),
    ("sleep_quality", "<= 3", "High", "sleep_quality_low"),
    ("stress_level", ">= 4", "Medium", "stress_high"),
    ("sleep_duration", "< 7", "Medium", "sleep_short"),
]
MAX_FACTORS = 5
# --- fixed values: share of missing critical fields -> confidence ----------
CONFIDENCE_CUTS = [(0.1, "High"), (0.3, "Medium")]


def score_a() -> str:
    parts = [
        "CASE " + " ".join(f"WHEN {c} {test} THEN {p}" for test, p in rules) + " ELSE 0 END"
        for c, rules in POINTS.items()
    ]
    return f"double(least(100, {' + '.join(parts)}))"


def symptom_count(names: list[str] = schema.REQUEST_SYMPTOMS) -> str:
    return " + ".join(f"int({c} <=> 1)" for c in names)


def score_b(reference_compat: bool = False) -> str:
    """Score A plus points per symptom; on request the strain symptom adds none."""
    names = schema.REQUEST_SYMPTOMS[1:] if reference_compat else schema.REQUEST_SYMPTOMS
    return f"double(least(100, {score_a()} + {SYMPTOM_POINTS} * ({symptom_count(names)})))"


def has_symptoms(prefix: str = "") -> str:
    return f"coalesce({', '.join(prefix + c for c in schema.REQUEST_SYMPTOMS)}) IS NOT NULL"


def level(score: str, stage: str, cuts: dict = schema.LEVEL_CUTS) -> str:
    low_a, mid_a = cuts["A"]
    low_b, mid_b = cuts["B"]
    return (
        f"CASE WHEN {score} < CASE WHEN {stage} = 'A' THEN {low_a} ELSE {low_b} END THEN 'Low' "
        f"WHEN {score} < CASE WHEN {stage} = 'A' THEN {mid_a} ELSE {mid_b} END THEN 'Medium' "
        "ELSE 'High' END"
    )


def missing_fields(stage: str) -> str:
    """Ordered names of the critical fields that are NULL; symptoms count in stage B."""
    plain = [f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in schema.CRITICAL_FIELDS]
    more = [
        f"CASE WHEN {stage} = 'B' AND {c} IS NULL THEN '{c}' END" for c in schema.REQUEST_SYMPTOMS
    ]
    return f"array_compact(array({', '.join(plain + more)}))"


def confidence(missing: str, stage: str) -> str:
    few = len(schema.CRITICAL_FIELDS)
    all_fields = few + len(schema.REQUEST_SYMPTOMS)
    share = f"size({missing}) / CASE WHEN {stage} = 'A' THEN {few}D ELSE {all_fields}D END"
    whens = " ".join(f"WHEN {share} <= {cut}D THEN '{name}'" for cut, name in CONFIDENCE_CUTS)
    return f"CASE {whens} ELSE 'Low' END"


def top_factors(stage: str) -> str:
    def factor(test: str, feature: str, strength: str, note: str) -> str:
        fields = f"'feature', '{feature}', 'direction', 'increase_risk'"
        return f"CASE WHEN {test} THEN named_struct({fields}, 'strength', '{strength}', 'note', {note}) END"

    count = f"({symptom_count()})"
    first = factor(
        f"{stage} = 'B' AND {count} > 0", "symptom_score", "High", f"concat('symptoms_reported:', {count})"
    )
    rest = [factor(f"{c} {test}", c, s, f"'{note}'") for c, test, s, note in FACTORS]
    return f"slice(array_compact(array({', '.join([first, *rest])})), 1, {MAX_FACTORS})"


def ask_list(missing: str = "missing_fields") -> str:
    """Which fields to ask for, from the columns of the next-step table."""
    symptoms = f"array({quoted(schema.REQUEST_SYMPTOMS)})"
    some = f"slice({missing}, 1, ask_missing)"
    return (
        f"CASE WHEN ask_symptoms = 'first' THEN concat({symptoms}, {some}) "
        f"WHEN ask_symptoms = 'if_triggered' AND trigger_symptom THEN concat({some}, {symptoms}) "
        f"ELSE {some} END"
    )
