"""Analysis runs by value: every number and text of every report of a run in one long table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.plans import evaluation_queries  # noqa: F401  registers SQL that is used below
from riskloom.plans.comparison_queries import _A, _B, _ICOLS, _LCOLS, _LEAK, _LEAK_P, _NUM, _ab, _cat_psi_sql
from riskloom.plans.profile_queries import _round, long_sql
from riskloom.plans.registry import ORACLES, query
from riskloom.plans.segment_queries import _EV_A, _EVB, _bucket_sql, _evb, rates_sql
from riskloom.plans.views import EV_SQL, LINE_FEATURES, LINE_SQL, ev, line, scores
from riskloom.stages import analysis, modelling


def values_sql(reports: dict[str, tuple[str, list[str], list[str]]]) -> str:
    """``analysis.report_values`` as SQL, from (SQL, key columns, text columns) per report."""
    parts = []
    for name, (sql, keys, texts) in reports.items():
        item = f"concat_ws('|', {', '.join(keys)})" if keys else "''"
        apart = f"EXCLUDE ({', '.join(keys + texts)})" if keys + texts else ""
        parts.append(f"""SELECT '{name}' AS report, item, metric, number, CAST(NULL AS VARCHAR) AS text FROM
            (UNPIVOT (SELECT {item} AS item, CAST(COLUMNS(* {apart}) AS DOUBLE) FROM ({sql})) ON COLUMNS(* EXCLUDE (item)) INTO NAME metric VALUE number)""")
        for c in texts:
            metric = c.strip('"')
            parts.append(f"SELECT '{name}', {item}, '{metric}', NULL, {c} FROM ({sql}) WHERE {c} IS NOT NULL")
    return " UNION ALL ".join(parts)


def _swap(name: str, old: str, new: str) -> str:
    """The SQL of query ``name`` over another source."""
    if old not in ORACLES[name]:
        raise ValueError(f"the SQL of {name} does not read the source to replace")
    return ORACLES[name].replace(old, new)


def _values(reports, layout, digits):
    rounded = {name: _round(df, **digits.get(name, {})) for name, df in reports.items()}
    return analysis.report_values(rounded, {name: [k.strip('"') for k in keys] for name, (_, keys, _) in layout.items()})


# --- time ------------------------------------------------------------------------------------

_GROWTH = "SELECT *, round(CAST(total AS DOUBLE) / lag(total) OVER (ORDER BY {b}) - 1, 6) AS total_growth FROM ({sql})"
_TIME = {
    "hour": (ORACLES["hourly_analysis"], ["hour"], []),
    "day": (ORACLES["daily_analysis"], ["day"], []),
    **{b: (_GROWTH.format(b=b, sql=_bucket_sql(b, EV_SQL)), [b], []) for b in ("week", "month")},
    "span": (ORACLES["time_span_summary"], [], []),
    "trends": (ORACLES["label_trends"], ["day"], []),
    "seasonality": (ORACLES["seasonality"], ["dimension", "bucket"], ["strength"]),
    "hour_drift": (_swap("hour_drift", _EV_A, EV_SQL), ["hour"], []),
    "hour_drift_summary": (_swap("hour_drift_summary", _EV_A, EV_SQL), [], ["status"]),
    "anomalies": (ORACLES["temporal_anomalies"], ["day"], []),
}


@query("time_analysis_values", values_sql(_TIME))
def time_analysis_values(spark, d):
    df = ev(spark, d)
    reports = analysis.time_reports(df, df.filter(F.col("dt") >= 20 * 86_400), "dt", "y", "amt")
    digits = {"hour_drift": {"psi": 8, "jsd": 8}, "hour_drift_summary": {"psi_total": 8, "jsd_total": 8}}
    digits |= {b: {"amount": 2} for b in ("hour", "day", "week", "month")}
    return _values(reports, _TIME, digits)


# --- transactions ----------------------------------------------------------------------------

_RISK = """, CASE WHEN 100.0 * avg(y) <= 1 THEN 'Low' WHEN 100.0 * avg(y) <= 5 THEN 'Moderate' WHEN 100.0 * avg(y) <= 15 THEN 'High' ELSE 'Critical' END AS risk"""
_TRANSACTION = {
    "amount": (ORACLES["amount_band_rates"].replace("SELECT band,", "SELECT band AS amount_band,", 1), ["amount_band"], []),
    "amount_statistics": (_swap("numeric_statistics", long_sql(LINE_SQL, LINE_FEATURES, "DOUBLE"), long_sql(_EVB, ["amt"], "DOUBLE")), ["feature"], []),
    "product": (rates_sql(_EVB, "region", "amt") + " GROUP BY region", ["region"], []),
    "keys": (ORACLES["key_feature_risk"], ["feature"], ["dominant_value", "riskiest_value", "riskiest_values"]),
    "timing": (ORACLES["rates_by_hour"], ["hour"], []),
    "profiles": (rates_sql(_EVB, "band AS amount_band, region", extra=_RISK) + " GROUP BY band, region", ["amount_band", "region"], ["risk"]),
    "distance": (_swap("rates_by_quartile", long_sql(LINE_SQL, ["price", "qty"], "DOUBLE", "y"), long_sql(_EVB, ["amt"], "DOUBLE", "y")), ["feature", "bin"], []),
    "pairs": (ORACLES["two_way_segment_rates"], ["grouping", "band", "region", "hour"], []),
}


@query("transaction_analysis_values", values_sql(_TRANSACTION))
def transaction_analysis_values(spark, d):
    reports = analysis.transaction_reports(_evb(spark, d), "y", "dt", "amt", "region", ["band", "region", "hour"], ["amt"])
    mean = {"mean_amount": 4}
    digits = {"amount": mean, "product": mean, "timing": mean, "pairs": mean, "distance": {"mean": 4, "median": 4, "std": 4}}
    digits["amount_statistics"] = {"digits": 4, "variance": 2, "low": 6, "high": 6, "mode": 6}
    return _values(reports, _TRANSACTION, digits)


# --- drift -----------------------------------------------------------------------------------

_CATEGORY = f"SELECT feature, psi FROM {_cat_psi_sql(_A, _B, ['status'])}"
_DRIFT = {
    "moments": (ORACLES["moment_drift"], ["feature"], []),
    "psi": (f"{ORACLES['psi_open_ends']} UNION ALL SELECT feature, round(psi, 6) FROM ({_CATEGORY})", ["feature"], []),
    "ks": (ORACLES["ks_two_sample"], ["feature"], []),
    "stability": (ORACLES["stability_report"].replace(
        " greatest(0, 100 * (1 - least(1, psi)) - 10 * ks) AS score FROM ",
        f" greatest(0, 100 * (1 - least(1, psi)) - 10 * coalesce(ks, 0)) AS score FROM (SELECT p.feature, p.psi, k.ks FROM ({_CATEGORY}) p, (SELECT CAST(NULL AS DOUBLE) AS ks) k UNION ALL SELECT feature, psi, ks FROM ", 1,
    ).replace(" USING (feature)),\n", " USING (feature))),\n", 1), ["feature"], ["class", "severity", "priority", "cause"]),
    "report": (ORACLES["drift_report"], ["feature"], ["status"]),
}


@query("drift_analysis_values", values_sql(_DRIFT))
def drift_analysis_values(spark, d):
    reports = analysis.drift_reports(*_ab(spark, d), _NUM, ["status"])
    return _values(reports, _DRIFT, {"moments": {"digits": 4}})


# --- interactions ----------------------------------------------------------------------------

_SIDES = ['"left"', '"right"']
_INTERACTION = {
    "separation": (_swap("pair_class_separation", LINE_SQL, _A), _SIDES, []),
    "hotspots": (_swap("pair_hotspots", LINE_SQL, _A), _SIDES, ["cell"]),
    "odds": (_swap("cell_odds_ratios", LINE_SQL, _A).rsplit(" ORDER BY ", 1)[0], [*_SIDES, "cell"], []),
    "strength": (_swap("interaction_strength", LINE_SQL, _A), _SIDES, []),
    "recommended": (_swap("recommended_interactions", LINE_SQL, _A).replace(" ORDER BY strength DESC LIMIT 3", ""), [*_SIDES, "recipe"], []),
    "triples": (_swap("triple_hotspots", LINE_SQL, _A), ["first", "second", "third"], ["cell"]),
    "stability": (ORACLES["interaction_stability"], _SIDES, ["stability"]),
    "screen": (ORACLES["interaction_production_screen"], _SIDES, ["action"]),
}


@query("interaction_analysis_values", values_sql(_INTERACTION))
def interaction_analysis_values(spark, d):
    reports = analysis.interaction_reports(*_ab(spark, d), _ICOLS, "y")
    return _values(reports, _INTERACTION, {"separation": {"digits": 4}, "strength": {"digits": 8}, "recommended": {"digits": 8}})


# --- numbers ---------------------------------------------------------------------------------

_NUMERICAL = {
    "distributions": (_swap("numeric_statistics", long_sql(LINE_SQL, LINE_FEATURES, "DOUBLE"), long_sql(LINE_SQL, _NUM, "DOUBLE")), ["feature"], []),
    "outliers": (ORACLES["outlier_report"], ["feature"], []),
    "shape": (f"SELECT * FROM ({ORACLES['distribution_shape']}) WHERE feature <> 'linenumber'", ["feature"], ["shape"]),
}


@query("numerical_analysis_values", values_sql(_NUMERICAL))
def numerical_analysis_values(spark, d):
    """Statistics, outliers and shape; advice on transformations has a query of its own over columns that need some."""
    reports = analysis.numerical_reports(line(spark, d), _NUM)
    digits = {"distributions": {"digits": 4, "variance": 2, "low": 6, "high": 6, "mode": 6}, "shape": {"digits": 4}}
    return _values({name: reports[name] for name in _NUMERICAL}, _NUMERICAL, digits)


# --- evaluation ------------------------------------------------------------------------------

_EVALUATION = {
    "curve": (ORACLES["curve_metrics"], [], []),
    "threshold": (ORACLES["threshold_metrics"], [], []),
    "calibration": (ORACLES["calibration"], [], []),
    "lift": (ORACLES["lift_gain_deciles"], ["decile"], []),
    "sweep": (ORACLES["threshold_sweep"], ["threshold"], []),
    "business": (ORACLES["business_value"], [], []),
    "errors": (ORACLES["hard_errors"], ["kind", "orderkey", "linenumber"], []),
    "error_summary": (ORACLES["error_summary"], [], []),
}


@query("evaluation_stage_values", values_sql(_EVALUATION))
def evaluation_stage_values(spark, d):
    reports = modelling.evaluation_reports(scores(spark, d), "amount", ["orderkey", "linenumber", "amount"], ["orderkey", "linenumber", "y"])
    return _values(reports, _EVALUATION, {"business": {"digits": 2}})


# --- leakage ---------------------------------------------------------------------------------

_LINES = f"SELECT *, y + disc * 0.01 AS refund_amount, y * 2.0 + tax AS proxy, qty AS settlement_lag FROM {LINE_SQL}"
_LINES_A, _LINES_B = (f"({_LINES} WHERE partkey % 3 {sign} 0)" for sign in ("<>", "="))
_SAME = f"(SELECT count(*) FROM {_LINES_A} a JOIN {_LINES_B} b USING (orderkey, qty))"
_OVERLAP = f"""SELECT 'status' AS feature, count(DISTINCT a.status) AS n_train, (SELECT count(DISTINCT status) FROM {_LINES_B}) AS n_test,
    count(DISTINCT a.status) FILTER (WHERE a.status IN (SELECT status FROM {_LINES_B})) AS n_shared, round(100.0 * n_shared / n_train, 6) AS overlap_pct,
    CASE WHEN 100.0 * n_shared / n_train > 90 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS level FROM {_LINES_A} a"""
_LEAKAGE = {
    "inventory": (f"""SELECT feature, CASE WHEN feature = 'status' THEN 'text' ELSE 'numeric' END AS kind, count(DISTINCT value) AS n_unique
        FROM {long_sql(_LINES_A, [*_LCOLS, 'status'])} GROUP BY 1""", ["feature"], ["kind"]),
    "leaking": (_swap("leaking_columns", _LEAK, _LINES_A), ["feature"], []),
    "target": (_swap("target_leakage", _LEAK, _LINES_A), ["feature"], ["severity"]),
    "time": (f"SELECT feature, round(corr(value, orderkey), 6) AS time_correlation FROM {long_sql(_LINES_A, _LCOLS, 'DOUBLE', 'orderkey')} GROUP BY 1", ["feature"], []),
    "overlap": (_OVERLAP, ["feature"], ["level"]),
    "duplicates": (f"""SELECT a AS train_rows, b AS test_rows, n AS duplicate_matches, round(n / a::DOUBLE, 6) AS overlap_fraction, CASE WHEN n / a::DOUBLE > 0.05 THEN 'CRITICAL' ELSE 'SAFE' END AS risk
        FROM (SELECT {_SAME} AS n, (SELECT count(*) FROM {_LINES_A}) AS a, (SELECT count(*) FROM {_LINES_B}) AS b)""", [], ["risk"]),
    "risk": (f"""SELECT feature, round(r, 6) AS correlation, p AS leakage_probability, round(score, 4) AS score,
        CASE WHEN score > 80 THEN 'CRITICAL LEAK' WHEN score > 50 THEN 'HIGH RISK' WHEN score > 20 THEN 'MODERATE RISK' ELSE 'STABLE / LOW RISK' END AS category FROM (
        SELECT feature, abs(r) AS r, p, least(100, p * 60 + abs(r) * 30 + 10 * {_SAME} / (SELECT count(*) FROM {_LINES_A})::DOUBLE) AS score FROM {_LEAK_P.replace(_LEAK, _LINES_A)}
        UNION ALL SELECT 'status', 0, 0, 10 * n_shared / n_train::DOUBLE FROM ({_OVERLAP}))""", ["feature"], ["category"]),
}


@query("leakage_analysis_values", values_sql(_LEAKAGE))
def leakage_analysis_values(spark, d):
    lines = line(spark, d).withColumns({
        "refund_amount": F.col("y") + F.col("disc") * 0.01, "proxy": F.col("y") * 2.0 + F.col("tax"), "settlement_lag": F.col("qty"),
    })
    train, test = lines.filter("partkey % 3 <> 0"), lines.filter("partkey % 3 = 0")
    reports = analysis.leakage_reports(train, test, _LCOLS, "status", "y", "orderkey", ["orderkey", "qty"])
    return _values(reports, _LEAKAGE, {"risk": {"score": 4}})
