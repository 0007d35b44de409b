"""Number to label: every rule is one line of a table of cut points.

Each rule lists ``(operator, limit, label)`` in order; the first that holds
wins and the last entry is the default.  Whether a limit is inclusive is part
of the rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.scalars import col

Rule = tuple[Sequence[tuple[str, float, str]], str]

# Limits and labels of the classifiers.
RULES: dict[str, Rule] = {
    "imbalance": ([("<", 5.0, "Low"), ("<=", 20.0, "Moderate")], "Severe"),
    "cardinality": (
        [("<=", 2, "Binary"), ("<=", 10, "Low"), ("<=", 100, "Medium"), ("<=", 1000, "High")],
        "Very High",
    ),
    "profile_cardinality": (
        [
            ("==", 1, "Constant"),
            ("==", 2, "Binary"),
            ("<=", 10, "Low Cardinality"),
            ("<=", 100, "Medium Cardinality"),
        ],
        "High Cardinality",
    ),
    "anonymous_cardinality": ([("==", 2, "Binary"), ("<=", 10, "Low")], "High"),
    "dominance": (
        [(">=", 95.0, "Near-Constant"), (">=", 80.0, "Highly Dominant"), (">=", 60.0, "Moderately Dominant")],
        "Balanced",
    ),
    "skewness": (
        [
            ("<", -1.0, "Highly Left-Skewed"),
            ("<", -0.5, "Moderately Left-Skewed"),
            ("<=", 0.5, "Approximately Symmetric"),
            ("<=", 1.0, "Moderately Right-Skewed"),
        ],
        "Highly Right-Skewed",
    ),
    "kurtosis": ([("<", -0.5, "Light-Tailed"), ("<=", 0.5, "Normal")], "Heavy-Tailed"),
    "missing_level": (
        [
            ("==", 0.0, "Complete"),
            ("<=", 10.0, "Low Missing"),
            ("<=", 30.0, "Moderate Missing"),
            ("<=", 60.0, "High Missing"),
        ],
        "Very High Missing",
    ),
    "missing_action": (
        [
            ("==", 0.0, "Keep"),
            ("<", 5.0, "Impute"),
            ("<=", 30.0, "Evaluate Importance"),
            ("<=", 60.0, "Create Missing Indicator"),
        ],
        "Drop or Specialized",
    ),
    "availability": ([("<", 20.0, "High"), ("<", 60.0, "Medium"), ("<", 95.0, "Low")], "None"),
    "psi_level": ([("<", 0.10, "STABLE"), ("<", 0.25, "MODERATE DRIFT")], "UNSTABLE"),
    "drift_report": ([(">", 0.25, "Severe"), (">=", 0.10, "Moderate")], "Stable"),
    "temporal_drift": ([(">", 0.2, "Significant Drift"), (">", 0.1, "Moderate Drift")], "Stable"),
    "tv_stability": ([(">", 0.15, "High"), (">", 0.05, "Moderate")], "Stable"),
    "stability_class": ([(">=", 90.0, "STABLE"), (">=", 75.0, "UNSTABLE")], "CRITICAL"),
    "effect_size": ([("<", 0.147, "Negligible"), ("<", 0.33, "Small"), ("<", 0.474, "Medium")], "Large"),
    "risk_label": ([("<=", 1.0, "Low"), ("<=", 5.0, "Moderate"), ("<=", 15.0, "High")], "Critical"),
    "quality_rating": (
        [("<", 60.0, "Critical"), ("<", 70.0, "Poor"), ("<", 80.0, "Acceptable"), ("<", 90.0, "Good")],
        "Excellent",
    ),
    "leakage_category": (
        [(">", 80.0, "CRITICAL LEAK"), (">", 50.0, "HIGH RISK"), (">", 20.0, "MODERATE RISK")],
        "STABLE / LOW RISK",
    ),
    "significance": (
        [("<", 0.01, "HIGHLY SIGNIFICANT"), ("<", 0.05, "MODERATELY SIGNIFICANT")],
        "NOT SIGNIFICANT",
    ),
    "encoding_strategy": ([("<=", 2, "Label"), ("<=", 10, "OneHot"), ("<", 50, "Frequency")], "Target"),
}

_TESTS = {
    "<": lambda v, x: v < x,
    "<=": lambda v, x: v <= x,
    ">": lambda v, x: v > x,
    ">=": lambda v, x: v >= x,
    "==": lambda v, x: v == x,
}


def classify(rule: str, c: Column | str, null_label: str | None = None) -> Column:
    tests, default = RULES[rule]
    v = col(c)
    chain = F.when(v.isNull(), F.lit(null_label))
    for op, limit, label in tests:
        chain = chain.when(_TESTS[op](v, F.lit(limit)), F.lit(label))
    return chain.otherwise(F.lit(default))


def rule_sql(rule: str, expr: str) -> str:
    """The same rule as a SQL CASE, for oracles."""
    tests, default = RULES[rule]
    body = " ".join(f"WHEN ({expr}) {'=' if op == '==' else op} {x} THEN '{label}'" for op, x, label in tests)
    return f"CASE WHEN ({expr}) IS NULL THEN NULL {body} ELSE '{default}' END"
