"""Drift, statistical tests, correlation, leakage and interactions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from riskloom.operators import correlation, drift, interact, joins, profile, sets, sketches, stats
from riskloom.operators.rows import with_row
from riskloom.plans.profile_queries import _TXN_BAND, _TXN_TEXTS, _round, _txn_band, long_sql
from riskloom.plans.registry import query
from riskloom.plans.views import (
    DOC_SQL, EV_SQL, LINE_SQL, TEST_SQL, TRAIN_SQL, TXN_SQL, doc, ev, line, table, txn,
)
from riskloom.session import work_path

# A pair with real drift: line items of early and late parts, one price scaled.
_NUM = ["qty", "price", "disc", "tax"]
_A = f"(SELECT orderkey, linenumber, qty, price, disc, tax, status, y FROM {LINE_SQL} WHERE partkey % 3 <> 0)"
_B = f"(SELECT orderkey, linenumber, qty + 3 AS qty, price * 1.4 AS price, disc, tax, status, y FROM {LINE_SQL} WHERE partkey % 3 = 0)"


def _ab(spark, d):
    df = line(spark, d)
    a = df.filter("partkey % 3 <> 0").drop("partkey", "suppkey")
    b = df.filter("partkey % 3 = 0").withColumns({"qty": F.col("qty") + 3, "price": F.col("price") * 1.4}).drop("partkey", "suppkey")
    return a, b


def _edges_sql(source: str, bins: int = 10) -> str:
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"""(SELECT feature, list_sort(list_distinct(quantile_cont(value, [{probs}]))) AS e FROM {long_sql(source, _NUM, 'DOUBLE')} GROUP BY 1)"""


def _psi_sql(kind: str, columns: str = "'qty', 'price', 'disc', 'tax'") -> str:
    """PSI of the four numeric columns in one of the three numeric forms."""
    # Bin number from the unique edges e[1..k]; list_filter counts the passed edges.
    if kind == "histogram":
        cell = "CASE WHEN value = e[len(e)] THEN len(e) - 1 WHEN value < e[1] OR value > e[len(e)] THEN -1 ELSE len([x FOR x IN e IF value >= x]) END"
    elif kind == "left":
        cell = "1 + len([x FOR x IN e[2:len(e)-1] IF value >= x])"
    else:
        cell = "1 + len([x FOR x IN e[2:len(e)-1] IF value > x])"
    norm = kind not in ("monitor", "right")
    cells = f"""c AS (SELECT feature, side, {cell} AS cell, count(*) AS n FROM l JOIN e USING (feature) GROUP BY 1, 2, 3)"""
    if kind == "monitor":
        cells = f"""k AS (SELECT feature, count(DISTINCT value) AS k FROM l WHERE side = 0 GROUP BY 1),
            c AS (SELECT feature, side, CASE WHEN k <= 10 THEN CAST(value AS VARCHAR) ELSE CAST({cell} AS VARCHAR) END AS cell, count(*) AS n FROM l JOIN e USING (feature) JOIN k USING (feature) GROUP BY 1, 2, 3)"""
    p, q = ("p / sum(p) OVER (PARTITION BY feature)", "q / sum(q) OVER (PARTITION BY feature)") if norm else ("p", "q")
    drop = "WHERE cell <> -1" if kind == "histogram" else ""
    return f"""(WITH l AS (SELECT *, 0 AS side FROM {long_sql(_A, _NUM, 'DOUBLE')} UNION ALL SELECT *, 1 FROM {long_sql(_B, _NUM, 'DOUBLE')}),
        e AS {_edges_sql(_A)}, {cells}, t AS (SELECT feature, side, count(*) AS t FROM l GROUP BY 1, 2),
        s AS (SELECT feature, cell, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS a, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS b FROM c {drop} GROUP BY 1, 2),
        r AS (SELECT feature, CASE WHEN a = 0 THEN 1e-4 ELSE a / (SELECT t FROM t WHERE t.feature = s.feature AND side = 0)::DOUBLE END AS p,
        CASE WHEN b = 0 THEN 1e-4 ELSE b / (SELECT t FROM t WHERE t.feature = s.feature AND side = 1)::DOUBLE END AS q FROM s),
        z AS (SELECT feature, {p} AS p, {q} AS q FROM r)
        SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM z WHERE feature IN ({columns}) GROUP BY 1)"""


for _name, _kind, _rule in (
    ("psi_histogram", "histogram", drift.HISTOGRAM), ("psi_open_ends", "left", drift.OPEN_LEFT), ("psi_monitoring", "monitor", drift.MONITOR),
):

    def _psi_query(spark, d, rule=_rule):
        return _round(drift.numeric_psi(*_ab(spark, d), _NUM, rule))

    query(_name, f"SELECT feature, round(psi, 6) AS psi FROM {_psi_sql(_kind)}")(_psi_query)


def _cat_psi_sql(a: str, b: str, columns, norm: bool = True) -> str:
    p, q = ("p / sum(p) OVER (PARTITION BY feature)", "q / sum(q) OVER (PARTITION BY feature)") if norm else ("p", "q")
    return f"""(WITH a AS (SELECT feature, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS t FROM {long_sql(a, columns)} GROUP BY 1, 2),
        b AS (SELECT feature, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS t FROM {long_sql(b, columns)} GROUP BY 1, 2),
        j AS (SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.n / a.t::DOUBLE, 1e-4) AS p, coalesce(b.n / b.t::DOUBLE, 1e-4) AS q
        FROM a FULL JOIN b ON a.feature = b.feature AND a.value = b.value), z AS (SELECT feature, {p} AS p, {q} AS q FROM j)
        SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM z GROUP BY 1)"""


_CAT_A = f"(SELECT product, CASE WHEN amt > 450000 THEN 'top' WHEN amt > 200000 THEN 'high' ELSE 'low' END AS band FROM {TRAIN_SQL})"
_CAT_B = f"(SELECT CASE WHEN key % 10 = 0 THEN 'new' ELSE product END AS product, CASE WHEN amt > 200000 THEN 'high' ELSE 'low' END AS band FROM {TEST_SQL})"


def _cat_ab(spark, d):
    a = _txn_band(spark, d, "train").select("product", "band")
    new = F.when(F.col("key") % 10 == 0, "new").otherwise(F.col("product"))
    band = F.when(F.col("amt") > 200000, "high").otherwise("low")
    return a, txn(spark, d, "test").select(new.alias("product"), band.alias("band"))


@query("psi_categorical", f"SELECT feature, round(psi, 6) AS psi FROM {_cat_psi_sql(_CAT_A, _CAT_B, _TXN_TEXTS)}")
def psi_categorical(spark, d):
    return _round(drift.categorical_psi(*_cat_ab(spark, d), _TXN_TEXTS))


@query(
    "total_variation",
    f"""WITH a AS (SELECT feature, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS t FROM {long_sql(_CAT_A, _TXN_TEXTS)} GROUP BY 1, 2),
        b AS (SELECT feature, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS t FROM {long_sql(_CAT_B, _TXN_TEXTS)} GROUP BY 1, 2),
        j AS (SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.n / a.t::DOUBLE, 0) AS p, coalesce(b.n / b.t::DOUBLE, 0) AS q, a.n IS NULL AS is_new, b.n IS NULL AS is_gone
        FROM a FULL JOIN b ON a.feature = b.feature AND a.value = b.value)
        SELECT feature, round(sum(abs(p - q)) / 2, 6) AS tv_distance, count(*) FILTER (WHERE is_new) AS new_categories, count(*) FILTER (WHERE is_gone) AS missing_categories,
        CASE WHEN sum(abs(p - q)) / 2 > 0.15 THEN 'High' WHEN sum(abs(p - q)) / 2 > 0.05 THEN 'Moderate' ELSE 'Stable' END AS stability FROM j GROUP BY 1""",
)
def total_variation(spark, d):
    return _round(drift.total_variation(*_cat_ab(spark, d), _TXN_TEXTS))


def _ks_sql(long: str) -> str:
    """KS statistic and asymptotic p of ``(feature, side, value)`` rows."""
    return f"""(WITH l AS {long}, v AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM l GROUP BY 1, 2),
        r AS (SELECT feature, sum(a) OVER (PARTITION BY feature ORDER BY value) AS ca, sum(b) OVER (PARTITION BY feature ORDER BY value) AS cb,
        sum(a) OVER (PARTITION BY feature) AS n0, sum(b) OVER (PARTITION BY feature) AS n1 FROM v),
        s AS (SELECT feature, max(abs(ca / n0::DOUBLE - cb / n1::DOUBLE)) AS ks, any_value(n0)::BIGINT AS n0, any_value(n1)::BIGINT AS n1 FROM r GROUP BY 1),
        x AS (SELECT *, ks * sqrt(n0 * n1 / (n0 + n1)::DOUBLE) AS lam FROM s)
        SELECT feature, ks, n0, n1, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0, least(1, (SELECT sum((CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) t(k)))) END AS ks_p,
        1.36 * sqrt((n0 + n1) / (n0 * n1::DOUBLE)) AS ks_critical FROM x)"""


_KS_AB = f"(SELECT feature, value, 0 AS side FROM {long_sql(_A, _NUM, 'DOUBLE')} UNION ALL SELECT feature, value, 1 FROM {long_sql(_B, _NUM, 'DOUBLE')})"
_KS_Y = f"(SELECT feature, value, y AS side FROM {long_sql(LINE_SQL, _NUM, 'DOUBLE', 'y')})"
_KS_OUT = "feature, round(ks, 6) AS ks, n0, n1, round(ks_p, 6) AS ks_p, round(ks_critical, 6) AS ks_critical"


@query("ks_two_sample", f"SELECT {_KS_OUT} FROM {_ks_sql(_KS_AB)}")
def ks_two_sample(spark, d):
    return _round(drift.ks_two_sample(*_ab(spark, d), _NUM))


@query("ks_between_classes", f"SELECT {_KS_OUT} FROM {_ks_sql(_KS_Y)}")
def ks_between_classes(spark, d):
    return _round(drift.ks_by_side(line(spark, d), _NUM, "y"))


def _moments(source: str, tag: str) -> str:
    return f"(SELECT feature, avg(value) AS m{tag}, median(value) AS d{tag}, stddev_samp(value) AS s{tag}, 100.0 * (count(*) - count(value)) / count(*) AS x{tag} FROM {long_sql(source, _NUM, 'DOUBLE')} GROUP BY 1)"


@query(
    "moment_drift",
    f"""SELECT feature, round(abs(ma - mb), 4) AS mean_diff, round(abs(da - db), 4) AS median_diff, round(abs(sa - sb), 4) AS std_diff, round(abs(xa - xb), 4) AS missing_diff
        FROM {_moments(_A, 'a')} JOIN {_moments(_B, 'b')} USING (feature)""",
)
def moment_drift(spark, d):
    return _round(drift.moment_drift(*_ab(spark, d), _NUM), 4)


_STATUS = "CASE WHEN psi > 0.25 THEN 'Severe' WHEN psi >= 0.1 THEN 'Moderate' ELSE 'Stable' END"


@query(
    "drift_report",
    f"""SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, round(ks_p, 6) AS ks_p, {_STATUS} AS status FROM {_psi_sql('monitor')} JOIN {_ks_sql(_KS_AB)} USING (feature)
        UNION ALL SELECT feature, round(psi, 6), 0, 1, {_STATUS} FROM {_cat_psi_sql(_A, _B, ['status'], False)}""",
)
def drift_report(spark, d):
    return _round(drift.drift_report(*_ab(spark, d), _NUM, ["status"]))


@query(
    "stability_report",
    f"""WITH s AS (SELECT feature, psi, ks, greatest(0, 100 * (1 - least(1, psi)) - 10 * ks) AS score FROM {_psi_sql('left')} JOIN {_ks_sql(_KS_AB)} USING (feature)),
        l AS (SELECT *, CASE WHEN psi < 0.05 AND score >= 95 THEN 1 WHEN psi < 0.1 THEN 2 WHEN psi < 0.2 THEN 3 WHEN psi < 0.35 THEN 4 ELSE 5 END AS i FROM s)
        SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, round(score, 6) AS stability, CASE WHEN score >= 90 THEN 'STABLE' WHEN score >= 75 THEN 'UNSTABLE' ELSE 'CRITICAL' END AS class,
        ['NO DRIFT', 'MINOR DRIFT', 'MODERATELY DRIFTED', 'MAJOR DRIFT', 'CRITICAL DRIFT'][i] AS severity, ['LOW', 'LOW', 'MEDIUM', 'HIGH', 'IMMEDIATE ACTION'][i] AS priority,
        [0, 2, 5, 8, 10][i] AS risk_score, ['normal variance', 'normal variance', 'temporal shift', 'population change', 'definition decay'][i] AS cause FROM l""",
)
def stability_report(spark, d):
    a, b = _ab(spark, d)
    return _round(drift.stability_report(drift.numeric_psi(a, b, _NUM, drift.OPEN_LEFT), drift.ks_two_sample(a, b, _NUM)))


def _saved_profile(spark, df, slices):
    """The profile of ``df`` as a job of every slice would have left it: two writes, one slice written again."""
    path, rows = work_path(spark, "profile"), sketches.profile(df, _NUM, ["status"], slices)
    sketches.save_profile(rows.filter("slice <> '2'"), path)
    sketches.save_profile(rows.filter("slice in ('1', '2')"), path)
    return sketches.merge_profiles(sketches.read_profile(spark, path))


@query(
    "drift_profile",
    f"""SELECT feature, count(*) AS n_rows, count(*) - count(value) AS n_missing, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
        min(value) AS low, max(value) AS high, true AS distinct_within FROM {long_sql(_A, _NUM, 'DOUBLE')} GROUP BY 1
        UNION ALL SELECT 'status', count(*), count(*) - count(status), NULL, NULL, NULL, NULL, true FROM {_A}""",
)
def drift_profile(spark, d):
    a, _ = _ab(spark, d)
    exact = a.agg(*[F.count_distinct(c).alias(c) for c in [*_NUM, "status"]])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in [*_NUM, "status"]])))
    out = sketches.summary(_saved_profile(spark, a, F.col("orderkey") % 4)).join(exact, "feature")
    within = F.abs(F.col("n_distinct") - F.col("n")) <= F.greatest(F.lit(1.0), 0.06 * F.col("n"))
    return _round(out.select("feature", "n_rows", "n_missing", "mean", "std", "low", "high", within.alias("distinct_within")), 4)


@query(
    "profile_drift_report",
    f"""SELECT feature, round(psi, 6) AS exact_psi, round(ks, 6) AS exact_ks, true AS psi_within, true AS ks_within FROM {_psi_sql('right')} JOIN {_ks_sql(_KS_AB)} USING (feature)
        UNION ALL SELECT feature, round(psi, 6), 0, true, true FROM {_cat_psi_sql(_A, _B, ['status'], False)}""",
)
def profile_drift_report(spark, d):
    """Drift from two saved profiles, and whether it lies within its stated error of the exact one."""
    a, b = _ab(spark, d)
    slices = F.col("orderkey") % 4
    report = sketches.compare_profiles(_saved_profile(spark, a, slices), _saved_profile(spark, b, slices))
    rule = drift.PsiRule(closed="right", open_ends=True, renormalise=False)
    exact = drift.numeric_psi(a, b, _NUM, rule).join(drift.ks_two_sample(a, b, _NUM).select("feature", "ks"), "feature")
    exact = exact.unionByName(drift.categorical_psi(a, b, ["status"], drift.PsiRule(renormalise=False)).withColumn("ks", F.lit(0.0)))
    exact = exact.select("feature", F.col("psi").alias("exact_psi"), F.col("ks").alias("exact_ks"))
    within = lambda name: (F.abs(F.col(name) - F.col(f"exact_{name}")) <= F.col(f"{name}_error") + 1e-9).alias(f"{name}_within")
    return _round(report.join(exact, "feature").select("feature", "exact_psi", "exact_ks", within("psi"), within("ks")))


@query("data_drift_monitor", f"SELECT feature, round(psi, 6) AS psi, psi >= 0.2 AS is_drifted FROM {_psi_sql('monitor')}")
def data_drift_monitor(spark, d):
    return _round(drift.data_drift_monitor(*_ab(spark, d), _NUM))


@query(
    "concept_drift",
    f"""SELECT round(a, 6) AS reference_rate, round(b, 6) AS current_rate, round(abs(a - b), 6) AS rate_change, abs(a - b) > 0.005 AS is_drifted
        FROM (SELECT avg(y) AS a FROM {TRAIN_SQL}), (SELECT avg(y) AS b FROM {TEST_SQL})""",
)
def concept_drift(spark, d):
    return _round(drift.concept_drift(txn(spark, d, "train"), txn(spark, d, "test"), "y", 0.005))


@query(
    "prediction_drift",
    f"""SELECT round(psi, 6) AS psi, round((SELECT avg(price) FROM {_A}), 4) AS reference_mean, round((SELECT avg(price) FROM {_B}), 4) AS current_mean, psi >= 0.1 AS is_drifted
        FROM {_psi_sql('monitor', "'price'")}""",
)
def prediction_drift(spark, d):
    return _round(drift.prediction_drift(*_ab(spark, d), "price"), reference_mean=4, current_mean=4)


@query(
    "drift_alerts",
    f"""SELECT 'DataDriftDetected' AS alert, 'WARNING' AS severity, printf('Severe data drift detected in %d features.', count(*)) AS message FROM {_psi_sql('monitor')} WHERE psi >= 0.02 HAVING count(*) > 0
        UNION ALL SELECT 'FeatureHealth', 'CRITICAL', 'Too many nulls in ' || f FROM (SELECT unnest(['quality', 'toxic']) AS f)""",
)
def drift_alerts(spark, d):
    from riskloom.operators.quality import feature_health

    found = drift.data_drift_monitor(*_ab(spark, d), _NUM, limit=0.02)
    return drift.alerts(found, feature_health(doc(spark, d), ["lang", "quality", "toxic"], 0.1))


@query(
    "retrain_trigger",
    f"SELECT has_drift, has_decay, has_drift OR has_decay AS retrain FROM (SELECT max(psi) >= 0.2 AS has_drift FROM {_psi_sql('monitor')}), (SELECT abs((SELECT avg(y) FROM {TRAIN_SQL}) - (SELECT avg(y) FROM {TEST_SQL})) > 0.05 AS has_decay)",
)
def retrain_trigger(spark, d):
    found = drift.data_drift_monitor(*_ab(spark, d), _NUM).agg(F.max("is_drifted").alias("has_drift"))
    decay = drift.concept_drift(txn(spark, d, "train"), txn(spark, d, "test"), "y").select(F.col("is_drifted").alias("has_decay"))
    return drift.retrain_trigger(found.transform(with_row, decay))


@query("feature_drift_gate", f"SELECT feature, round(psi, 6) AS psi, psi > 0.25 AS is_drifted FROM {_psi_sql('histogram')}")
def feature_drift_gate(spark, d):
    return _round(drift.feature_drift_gate(*_ab(spark, d), _NUM))


@query(
    "governance_audit",
    f"""WITH b AS (SELECT feature, (count(*) - count(value)) / count(*)::DOUBLE AS null_ratio, var_pop(value) AS variance FROM {long_sql(_A, _NUM, 'DOUBLE')} GROUP BY 1),
        j AS (SELECT *, null_ratio > 0.05 OR variance = 0 OR psi > 0.25 AS bad FROM b JOIN {_psi_sql('histogram')} USING (feature))
        SELECT feature, null_ratio, round(variance, 4) AS variance, round(psi, 6) AS psi, CASE WHEN bad THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN bad THEN 'CRITICAL' ELSE 'OK' END AS tag FROM j""",
)
def governance_audit(spark, d):
    return _round(drift.governance_audit(*_ab(spark, d), _NUM), variance=4)


# --- statistical tests --------------------------------------------------------------------

_RANKS = f"""(WITH v AS (SELECT feature, value, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1, count(*) AS n FROM {long_sql(LINE_SQL, _NUM, 'DOUBLE', 'y')} GROUP BY 1, 2),
    r AS (SELECT *, (sum(n) OVER (PARTITION BY feature ORDER BY value) - n + (n + 1) / 2.0)::DOUBLE AS rank FROM v),
    s AS (SELECT feature, sum(n0)::DOUBLE AS n0, sum(n1)::DOUBLE AS n1, sum(n1 * rank) AS r1, sum(n * rank * rank) AS rr FROM r GROUP BY 1)
    SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, (r1 - n1 * (n0 + n1 + 1) / 2) / sqrt((rr - (n0 + n1) * ((n0 + n1 + 1) / 2) * ((n0 + n1 + 1) / 2)) * n1 * n0 / (n0 + n1)) AS spearman FROM s)"""


@query(
    "mann_whitney",
    f"SELECT feature, n0::BIGINT AS n0, n1::BIGINT AS n1, u, round(1 - 2 * u / (n1 * n0), 8) AS rank_biserial, round(2 * u / (n1 * n0) - 1, 8) AS cliffs_delta, round(spearman, 6) AS spearman FROM {_RANKS}",
)
def mann_whitney(spark, d):
    return _round(stats.rank_tests(line(spark, d), _NUM, "y").drop("z"), 6, rank_biserial=8, cliffs_delta=8)


@query(
    "effect_sizes",
    f"""WITH m AS (SELECT feature, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1, avg(value) FILTER (WHERE y = 0) AS m0, avg(value) FILTER (WHERE y = 1) AS m1,
        var_samp(value) FILTER (WHERE y = 0) AS v0, var_samp(value) FILTER (WHERE y = 1) AS v1 FROM {long_sql(LINE_SQL, _NUM, 'DOUBLE', 'y')} GROUP BY 1)
        SELECT feature, round((m1 - m0) / sqrt(((m.n1 - 1) * v1 + (m.n0 - 1) * v0) / (m.n0 + m.n1 - 2)), 6) AS cohens_d, round(2 * u / (r.n1 * r.n0) - 1, 6) AS cliffs_delta,
        CASE WHEN abs(2 * u / (r.n1 * r.n0) - 1) < 0.147 THEN 'Negligible' WHEN abs(2 * u / (r.n1 * r.n0) - 1) < 0.33 THEN 'Small' WHEN abs(2 * u / (r.n1 * r.n0) - 1) < 0.474 THEN 'Medium' ELSE 'Large' END AS magnitude
        FROM m JOIN {_RANKS} r USING (feature)""",
)
def effect_sizes(spark, d):
    return _round(stats.effect_sizes(line(spark, d), _NUM, "y"))


_TWO = f"(SELECT *, CASE WHEN key % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM {_TXN_BAND})"


def _two(spark, d):
    return _txn_band(spark, d).withColumn("parity", F.when(F.col("key") % 2 == 0, "even").otherwise("odd"))


_CHI = f"""(WITH c AS (SELECT feature, value, count(*) FILTER (WHERE y = 0) AS o0, count(*) FILTER (WHERE y = 1) AS o1 FROM {long_sql(_TWO, ['product', 'band', 'parity'], keep='y')} GROUP BY 1, 2),
    t AS (SELECT *, sum(o0) OVER w AS t0, sum(o1) OVER w AS t1, count(*) OVER w AS k FROM c WINDOW w AS (PARTITION BY feature)),
    x AS (SELECT feature, k, t0 + t1 AS n, unnest([o0, o1]) AS o, unnest([(o0 + o1) * t0 / (t0 + t1)::DOUBLE, (o0 + o1) * t1 / (t0 + t1)::DOUBLE]) AS e FROM t)
    SELECT feature, any_value(k) - 1 AS dof, any_value(n) AS n, sum(power(abs(o - e) - CASE WHEN k = 2 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS chi2 FROM x GROUP BY 1)"""


@query("chi_square", f"SELECT feature, round(chi2, 6) AS chi2, CAST(dof AS INTEGER) AS dof, round(sqrt(chi2 / n), 6) AS cramers_v FROM {_CHI}")
def chi_square(spark, d):
    return _round(stats.chi_square(_two(spark, d), ["product", "band", "parity"], "y"))


def _anova_sql(groups: str, min_n: int) -> str:
    return f"""(WITH g AS {groups}, o AS (SELECT feature, sum(n * m) / sum(n) AS grand FROM g GROUP BY 1),
        s AS (SELECT feature, sum(n * power(m - grand, 2)) AS ssb, sum(n * v) AS ssw, count(*) AS k, sum(n) AS n, min(n) AS least FROM g JOIN o USING (feature) GROUP BY 1)
        SELECT feature, CASE WHEN k > 1 AND least > {min_n} THEN (ssb / (k - 1)) / (ssw / (n - k)) ELSE 0 END AS f, CASE WHEN k > 1 AND least > {min_n} THEN ssb / (ssb + ssw) ELSE 0 END AS eta, k, n FROM s)"""


_ANOVA_OUT = "feature, round(f, 6) AS f, round(eta, 8) AS eta_squared, (k - 1)::DOUBLE AS dof1, (n - k)::DOUBLE AS dof2"
_TWO_AMT = f"(SELECT product, CASE WHEN key % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, amt FROM {TXN_SQL})"


@query(
    "anova_by_category",
    f"SELECT {_ANOVA_OUT} FROM {_anova_sql(f'(SELECT feature, value, count(*) AS n, avg(amt) AS m, var_pop(amt) AS v FROM ' + long_sql(_TWO_AMT, ['product', 'parity'], keep='amt') + ' GROUP BY 1, 2)', 5)}",
)
def anova_by_category(spark, d):
    return _round(stats.anova_by_category(_two(spark, d), ["product", "parity"], "amt"), eta_squared=8)


@query(
    "anova_by_label",
    f"SELECT {_ANOVA_OUT} FROM {_anova_sql(f'(SELECT feature, y, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM ' + long_sql(LINE_SQL, _NUM, 'DOUBLE', 'y') + ' GROUP BY 1, 2)', 0)}",
)
def anova_by_label(spark, d):
    return _round(stats.anova_by_target(line(spark, d), _NUM, "y"), eta_squared=8)


@query("test_p_values")
def test_p_values(spark, d):
    lines = line(spark, d)
    parts = {
        "mann_whitney": stats.mann_whitney_p(stats.rank_tests(lines, _NUM, "y")).select("feature", "p_value"),
        "chi_square": stats.chi_square_p(stats.chi_square(_two(spark, d), ["product", "band", "parity"], "y")).select("feature", "p_value"),
        "anova": stats.anova_p(stats.anova_by_target(lines, _NUM, "y")).select("feature", "p_value"),
    }
    return sets.stack(parts, "test")


def _bin_sql(source: str, columns, bins: int, keep: str = "y") -> str:
    """``(keep, feature, cell)`` with quantile bins, or the value itself when few."""
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"""(WITH l AS {long_sql(source, columns, 'DOUBLE', keep)}, e AS (SELECT feature, count(DISTINCT value) AS k, list_sort(list_distinct(quantile_cont(value, [{probs}]))) AS e FROM l GROUP BY 1)
        SELECT {keep}, feature, CASE WHEN k <= {bins} THEN CAST(value AS VARCHAR) WHEN value = e[1] THEN 'Q1' ELSE 'Q' || len([x FOR x IN e IF value > x]) END AS cell FROM l JOIN e USING (feature))"""


def _mi_sql(cells: str, keys: str = "feature") -> str:
    return f"""(WITH c AS (SELECT {keys}, cell, y, count(*)::DOUBLE AS n FROM {cells} GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS t,
        sum(n) OVER (PARTITION BY {keys}, cell) AS nc, sum(n) OVER (PARTITION BY {keys}, y) AS ny FROM c)
        SELECT {keys}, greatest(0, sum(n / t * ln(n * t / (nc * ny)))) AS mi FROM t GROUP BY ALL)"""


_MI = _mi_sql(_bin_sql(LINE_SQL, _NUM, 10))


@query("mutual_information", f"SELECT feature, round(mi, 8) AS mi FROM {_MI}")
def mutual_information(spark, d):
    return _round(stats.mutual_information(line(spark, d), _NUM, "y"), 8)


_FDR = f"""(WITH p AS (SELECT feature, ks_p AS p, count(*) OVER () AS m, row_number() OVER (ORDER BY round(ks_p, 12), feature) AS r FROM {_ks_sql(_KS_Y)})
    SELECT feature, p, least(1, p * m) AS bonferroni, least(1, max(p * (m - r + 1)) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS holm,
    least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr FROM p)"""


def _ks_p(spark, d):
    return drift.ks_by_side(line(spark, d), _NUM, "y").select("feature", F.round("ks_p", 12).alias("p_value"), "ks")


@query("multiple_testing_correction", f"SELECT feature, round(p, 6) AS p_value, round(bonferroni, 6) AS bonferroni, round(holm, 6) AS holm, round(fdr, 6) AS fdr FROM {_FDR}")
def multiple_testing_correction(spark, d):
    return _round(stats.corrected_p_values(_ks_p(spark, d).drop("ks")))


@query(
    "significance_ranking",
    f"""WITH j AS (SELECT feature, p, fdr, mi, ks, -log10(p + 1e-15) + 100 * mi + 10 * ks AS score, CASE WHEN fdr < 0.01 THEN 'HIGHLY SIGNIFICANT' WHEN fdr < 0.05 THEN 'MODERATELY SIGNIFICANT' ELSE 'NOT SIGNIFICANT' END AS c
        FROM {_FDR} JOIN {_MI} USING (feature) JOIN {_ks_sql(_KS_Y)} k USING (feature))
        SELECT feature, round(p, 6) AS p_value, round(fdr, 6) AS fdr, round(mi, 6) AS mi, round(ks, 6) AS ks, round(score, 6) AS score, c AS category,
        CASE WHEN c = 'HIGHLY SIGNIFICANT' AND mi > 0.005 THEN 'RETAIN' WHEN c = 'NOT SIGNIFICANT' THEN 'PRUNE' ELSE 'MONITOR' END AS action FROM j""",
)
def significance_ranking(spark, d):
    ks = _ks_p(spark, d)
    mi = stats.mutual_information(line(spark, d), _NUM, "y")
    return _round(stats.significance_ranking(stats.corrected_p_values(ks.drop("ks")), mi, ks))


# --- correlation ------------------------------------------------------------------------------

_WIDE = f"(SELECT qty, price, disc, tax, price * 1.02 + qty AS price2, -price + 3 * qty AS price3, disc * 2 + tax * 0.1 AS disc2, y FROM {LINE_SQL})"
_WCOLS = ["qty", "price", "disc", "tax", "price2", "price3", "disc2"]


def _wide(spark, d):
    return line(spark, d).select(
        "qty", "price", "disc", "tax", (F.col("price") * 1.02 + F.col("qty")).alias("price2"),
        (-F.col("price") + F.col("qty") * 3).alias("price3"), (F.col("disc") * 2 + F.col("tax") * 0.1).alias("disc2"), "y",
    )


def _pairs_sql(source: str, columns, expr: str = "corr({a}, {b})") -> str:
    return "(" + " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {expr.format(a=a, b=b)} AS r FROM {source}"
        for i, a in enumerate(columns) for b in columns[i + 1 :]
    ) + ")"


_PEARSON = _pairs_sql(_WIDE, _WCOLS)


@query("pearson_matrix", f'SELECT "left", "right", round(r, 6) AS r FROM {_PEARSON}')
def pearson_matrix(spark, d):
    return _round(correlation.pearson_pairs(_wide(spark, d), _WCOLS))


_RANKED = f"(SELECT {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}' for c in _NUM)} FROM {LINE_SQL})"


@query("spearman_matrix", f'SELECT "left", "right", round(r, 6) AS r FROM {_pairs_sql(_RANKED, _NUM)}')
def spearman_matrix(spark, d):
    return _round(correlation.spearman_pairs(line(spark, d), _NUM))


def _tau_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS "left", '{b}' AS "right", round((SELECT sum(CASE WHEN (p.x - q.x) * (p.y - q.y) > 0 THEN 1 WHEN (p.x - q.x) * (p.y - q.y) < 0 THEN -1 ELSE 0 END * p.n * q.n)::DOUBLE FROM c p JOIN c q ON p.x < q.x)
        / sqrt((a.t - tx.t) * (a.t - ty.t)), 6) AS tau FROM (SELECT sum(n) * (sum(n) - 1) / 2.0::DOUBLE AS t FROM c) a, (SELECT sum(k * (k - 1) / 2.0::DOUBLE) AS t FROM (SELECT sum(n) AS k FROM c GROUP BY x)) tx,
        (SELECT sum(k * (k - 1) / 2.0::DOUBLE) AS t FROM (SELECT sum(n) AS k FROM c GROUP BY y)) ty"""


_TAU_PAIRS = [("qty", "disc"), ("disc", "tax"), ("tax", "linenumber")]


@query(
    "kendall_tau",
    " UNION ALL ".join(
        f"SELECT * FROM (WITH c AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {LINE_SQL} GROUP BY 1, 2) {_tau_sql(a, b)})" for a, b in _TAU_PAIRS
    ),
)
def kendall_tau(spark, d):
    return _round(correlation.kendall_pairs(line(spark, d), _TAU_PAIRS))


_TAU_COLS = ["qty", "thousands", "disc", "tax", "linenumber"]
_TAU_WIDE = f"(SELECT *, floor(price / 1000) AS thousands FROM {LINE_SQL})"


@query(
    "kendall_matrix",
    " UNION ALL ".join(
        f"SELECT * FROM (WITH c AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {_TAU_WIDE} GROUP BY 1, 2) {_tau_sql(a, b)})" for a, b in combinations(_TAU_COLS, 2)
    ),
)
def kendall_matrix(spark, d):
    wide = line(spark, d).withColumn("thousands", F.floor(F.col("price") / 1000))
    return _round(correlation.kendall_pairs(wide, list(combinations(_TAU_COLS, 2))))


_TCORR = f"""(WITH m AS (SELECT feature, corr(value, y) AS pearson, avg(value) FILTER (WHERE y = 0) AS m0, avg(value) FILTER (WHERE y = 1) AS m1,
    stddev_pop(value) FILTER (WHERE y = 0) AS s0, stddev_pop(value) FILTER (WHERE y = 1) AS s1 FROM {long_sql(LINE_SQL, _NUM, 'DOUBLE', 'y')} GROUP BY 1)
    SELECT feature, pearson, spearman, abs(m0 - m1) / (s0 + s1) AS separation FROM m JOIN {_RANKS} USING (feature))"""


@query("target_correlation", f"SELECT feature, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(separation, 6) AS separation FROM {_TCORR}")
def target_correlation(spark, d):
    return _round(correlation.target_correlation(line(spark, d), _NUM, "y"))


@query("correlation_edges", f'SELECT "left", "right", round(r, 6) AS r FROM {_PEARSON} WHERE abs(r) >= 0.85')
def correlation_edges(spark, d):
    return _round(correlation.correlation_edges(correlation.pearson_pairs(_wide(spark, d), _WCOLS)))


@query(
    "correlation_hubs",
    f"""SELECT feature, count(*) AS degree, round(avg(abs(r)), 6) AS mean_weight, count(*) >= 2 AS is_hub FROM (SELECT unnest(["left", "right"]) AS feature, r FROM {_PEARSON} WHERE abs(r) >= 0.85) GROUP BY 1""",
)
def correlation_hubs(spark, d):
    edges = correlation.correlation_edges(correlation.pearson_pairs(_wide(spark, d), _WCOLS))
    return _round(correlation.edge_degrees(edges, 2))


@query(
    "redundant_feature_groups",
    f"""WITH RECURSIVE e AS (SELECT "left" AS a, "right" AS b FROM {_PEARSON} WHERE abs(r) >= 0.85), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        w AS (SELECT a AS feature, a AS seen FROM u UNION SELECT w.feature, u.b FROM w JOIN u ON w.seen = u.a)
        SELECT feature, min(seen) AS component FROM w GROUP BY 1""",
)
def redundant_feature_groups(spark, d):
    edges = correlation.correlation_edges(correlation.pearson_pairs(_wide(spark, d), _WCOLS))
    return correlation.connected_groups(edges)


_WMI = _mi_sql(_bin_sql(_WIDE, _WCOLS, 10))


@query(
    "correlation_pruning",
    f"""WITH f AS (SELECT feature, var_samp(value) AS v FROM {long_sql(_WIDE, _WCOLS, 'DOUBLE')} GROUP BY 1),
        j AS (SELECT p."left", p."right", r, abs(a.mi - b.mi) > 1e-4 AS by_mi, CASE WHEN abs(a.mi - b.mi) > 1e-4 THEN a.mi > b.mi ELSE fa.v >= fb.v END AS l
        FROM {_PEARSON} p JOIN {_WMI} a ON a.feature = "left" JOIN {_WMI} b ON b.feature = "right" JOIN f fa ON fa.feature = "left" JOIN f fb ON fb.feature = "right" WHERE abs(r) >= 0.85)
        SELECT "left", "right", round(r, 6) AS r, CASE WHEN l THEN "left" ELSE "right" END AS keep, CASE WHEN l THEN "right" ELSE "left" END AS remove,
        CASE WHEN by_mi THEN 'mutual information' ELSE 'variance' END AS reason FROM j""",
)
def correlation_pruning(spark, d):
    df = _wide(spark, d)
    mi = stats.mutual_information(df, _WCOLS, "y")
    return _round(correlation.correlation_pruning(df, correlation.pearson_pairs(df, _WCOLS), mi, _WCOLS))


@query("redundant_pairs", f'SELECT "left", "right", round(r, 6) AS r FROM {_PEARSON} WHERE abs(r) > 0.9')
def redundant_pairs(spark, d):
    return _round(correlation.redundancy(_wide(spark, d), _WCOLS, 0.9))


@query(
    "correlation_inventory",
    f"""SELECT feature, round(100.0 * (count(*) - count(value)) / count(*), 6) AS missing_pct, CASE WHEN feature = 'lang' THEN 'text' ELSE 'numeric' END AS kind,
        CASE WHEN 100.0 * (count(*) - count(value)) / count(*) < 20 THEN 'High' WHEN 100.0 * (count(*) - count(value)) / count(*) < 60 THEN 'Medium'
        WHEN 100.0 * (count(*) - count(value)) / count(*) < 95 THEN 'Low' ELSE 'None' END AS availability FROM {long_sql(DOC_SQL, ['n_chars', 'quality', 'lang'])} GROUP BY 1""",
)
def correlation_inventory(spark, d):
    return _round(correlation.correlation_inventory(doc(spark, d), ["n_chars", "quality", "lang"]))


# --- leakage ---------------------------------------------------------------------------------

_LEAK = f"(SELECT qty, price, disc, tax, y + disc * 0.01 AS refund_amount, y * 2.0 + tax AS proxy, qty AS settlement_lag, y FROM {LINE_SQL})"
_LCOLS = ["qty", "price", "refund_amount", "proxy", "settlement_lag"]


def _leak(spark, d):
    return line(spark, d).select(
        "qty", "price", "disc", "tax", (F.col("y") + F.col("disc") * 0.01).alias("refund_amount"),
        (F.col("y") * 2.0 + F.col("tax")).alias("proxy"), F.col("qty").alias("settlement_lag"), "y",
    )


@query("leaking_columns", f"SELECT feature, round(r, 6) AS pearson FROM (SELECT feature, corr(value, y) AS r FROM {long_sql(_LEAK, _LCOLS, 'DOUBLE', 'y')} GROUP BY 1) WHERE abs(r) >= 0.95")
def leaking_columns(spark, d):
    return _round(correlation.leaking_columns(_leak(spark, d), _LCOLS, "y"))


_LEAK_P = f"""(SELECT feature, r, CASE WHEN w AND h THEN 1.0 WHEN h THEN 0.85 WHEN w THEN 0.5 ELSE 0.0 END::DOUBLE AS p, CASE WHEN w AND h THEN 'CRITICAL' WHEN h THEN 'HIGH' WHEN w THEN 'MODERATE' ELSE 'LOW' END AS s
    FROM (SELECT feature, corr(value, y) AS r, regexp_matches(feature, 'chargeback|settlement|post_trans|refund|manual_review|investigation') AS w, abs(corr(value, y)) > 0.9 AS h FROM {long_sql(_LEAK, _LCOLS, 'DOUBLE', 'y')} GROUP BY 1))"""


@query("target_leakage", f"SELECT feature, p AS leakage_probability, s AS severity FROM {_LEAK_P}")
def target_leakage(spark, d):
    return correlation.target_leakage(correlation.target_correlation(_leak(spark, d), _LCOLS, "y"))


@query("time_correlation", f"SELECT 'amt' AS feature, round(corr(amt, dt), 6) AS time_correlation FROM {TXN_SQL} UNION ALL SELECT 'id', round(corr(id, dt), 6) FROM {TXN_SQL}")
def time_correlation(spark, d):
    return _round(correlation.time_correlation(txn(spark, d), ["amt", "id"], "dt"))


@query(
    "leakage_risk",
    f"""WITH o AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT product FROM {TRAIN_SQL} INTERSECT SELECT DISTINCT product FROM {TEST_SQL})) / (SELECT count(DISTINCT product) FROM {TRAIN_SQL})::DOUBLE AS o),
        d AS (SELECT (SELECT count(*) FROM {_A} a JOIN {_B} b USING (disc, tax)) / (SELECT count(*) FROM {_A})::DOUBLE AS f),
        s AS (SELECT feature, abs(r) AS r, p, least(100, p * 60 + abs(r) * 30 + f * 10) AS score FROM {_LEAK_P}, d UNION ALL SELECT 'product', 0, 0, o * 10 FROM o)
        SELECT feature, round(r, 6) AS correlation, p AS leakage_probability, round(score, 4) AS score,
        CASE WHEN score > 80 THEN 'CRITICAL LEAK' WHEN score > 50 THEN 'HIGH RISK' WHEN score > 20 THEN 'MODERATE RISK' ELSE 'STABLE / LOW RISK' END AS category FROM s""",
)
def leakage_risk(spark, d):
    corr = correlation.target_correlation(_leak(spark, d), _LCOLS, "y")
    overlap = sets.category_overlap(txn(spark, d, "train"), txn(spark, d, "test"), "product").withColumn("feature", F.lit("product"))
    duplicates = joins.duplicate_overlap(*_ab(spark, d), ["disc", "tax"])
    return _round(correlation.leakage_risk(corr, correlation.target_leakage(corr), overlap, duplicates, ["product"]), score=4)


@query(
    "leakage_inventory",
    f"SELECT feature, 'numeric' AS kind, count(DISTINCT value) AS n_unique FROM {long_sql(_LEAK, _LCOLS)} GROUP BY 1",
)
def leakage_inventory(spark, d):
    df = _leak(spark, d).select(*_LCOLS)
    return profile.schema_profile(df).select("feature", F.when(F.col("is_numeric"), "numeric").otherwise("text").alias("kind"), F.col("cardinality").alias("n_unique"))


# --- interactions ------------------------------------------------------------------------------

_ICOLS = ["qty", "price", "disc", "tax"]
_IB = f"""(WITH b AS {_bin_sql(f"(SELECT *, row_number() OVER () AS rid FROM {LINE_SQL})", _ICOLS, 4, 'rid, y')}
    SELECT rid, y, max(cell) FILTER (WHERE feature = 'qty') AS qty, max(cell) FILTER (WHERE feature = 'price') AS price,
    max(cell) FILTER (WHERE feature = 'disc') AS disc, max(cell) FILTER (WHERE feature = 'tax') AS tax FROM b GROUP BY 1, 2)"""


def _cells_sql(binned: str, keep: str = "y") -> str:
    return "(" + " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {a} || '_' || {b} AS cell, {keep} FROM ib"
        for i, a in enumerate(_ICOLS) for b in _ICOLS[i + 1 :]
    ) + ")"


_CELLS = f"ib AS {_IB}, x AS {_cells_sql('ib')}, c AS (SELECT \"left\", \"right\", cell, count(*) AS n, sum(y)::BIGINT AS p, avg(y) AS rate FROM x GROUP BY 1, 2, 3)"
_RATE = f"(SELECT avg(y) FROM {LINE_SQL})"


@query(
    "pair_class_separation",
    f"""WITH m AS (SELECT {', '.join(f'avg({c}) FILTER (WHERE y = 1) - avg({c}) FILTER (WHERE y = 0) AS {c}' for c in _ICOLS)} FROM {LINE_SQL}),
        d AS {_pairs_sql('m', _ICOLS, 'sqrt({a} * {a} + {b} * {b})')}, p AS {_pairs_sql(LINE_SQL, _ICOLS)}
        SELECT "left", "right", round(d.r, 4) AS distance, round(p.r, 4) AS r, round(1 / (1 + d.r), 4) AS overlap_index FROM d JOIN p USING ("left", "right")""",
)
def pair_class_separation(spark, d):
    return _round(interact.class_separation(line(spark, d), _ICOLS, "y"), 4)


@query(
    "pair_hotspots",
    f"""WITH {_CELLS}, h AS (SELECT *, row_number() OVER (PARTITION BY "left", "right" ORDER BY rate DESC, cell) AS i FROM c WHERE n >= 15),
        s AS (SELECT "left", "right", sum(rate) AS s, count(*) AS k FROM c GROUP BY 1, 2)
        SELECT "left", "right", cell, n, round(rate, 6) AS rate, round(rate / {_RATE}, 6) AS lift, round(rate / ((s - rate) / (k - 1)), 6) AS relative_risk FROM h JOIN s USING ("left", "right") WHERE i = 1""",
)
def pair_hotspots(spark, d):
    return _round(interact.pair_hotspots(line(spark, d), _ICOLS, "y"))


@query(
    "triple_hotspots",
    f"""WITH ib AS {_IB}, x AS ({' UNION ALL '.join(f"SELECT '{a}' AS first, '{b}' AS second, '{c}' AS third, {a} || '_' || {b} || '_' || {c} AS cell, y FROM ib" for a, b, c in (('qty', 'price', 'disc'), ('qty', 'price', 'tax'), ('qty', 'disc', 'tax'), ('price', 'disc', 'tax')))}),
        c AS (SELECT first, second, third, cell, count(*) AS n, avg(y) AS rate FROM x GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
        h AS (SELECT *, row_number() OVER (PARTITION BY first, second, third ORDER BY rate DESC, cell) AS i FROM c)
        SELECT first, second, third, cell, n, round(rate, 6) AS rate, round(rate / {_RATE}, 6) AS lift FROM h WHERE i = 1""",
)
def triple_hotspots(spark, d):
    return _round(interact.triple_hotspots(line(spark, d), _ICOLS, "y"))


@query(
    "cell_odds_ratios",
    f"""WITH {_CELLS}, o AS (SELECT sum(y) AS p, count(*) AS rows FROM {LINE_SQL})
        SELECT "left", "right", cell, c.p AS positives, n - c.p AS negatives, round(rate, 6) AS rate, round(rate * rows / o.p, 6) AS lift,
        round(((c.p + 0.5) / (n - c.p + 0.5)) / ((o.p - c.p + 0.5) / (rows - o.p - (n - c.p) + 0.5)), 6) AS odds_ratio FROM c, o WHERE n >= 10 ORDER BY rate DESC, "left", "right", cell LIMIT 40""",
)
def cell_odds_ratios(spark, d):
    return _round(interact.cell_odds(line(spark, d), _ICOLS, "y", top=40))


_SINGLE = _mi_sql(_bin_sql(LINE_SQL, _ICOLS, 4))
_STRENGTH = f"""(WITH ib AS {_IB}, j AS {_mi_sql(_cells_sql('ib'), '"left", "right"')}, s AS {_SINGLE}
    SELECT "left", "right", j.mi AS joint_mi, a.mi AS left_mi, b.mi AS right_mi, j.mi - a.mi - b.mi AS strength FROM j JOIN s a ON a.feature = "left" JOIN s b ON b.feature = "right")"""


@query("interaction_strength", f'SELECT "left", "right", round(joint_mi, 8) AS joint_mi, round(left_mi, 8) AS left_mi, round(right_mi, 8) AS right_mi, round(strength, 8) AS strength FROM {_STRENGTH}')
def interaction_strength(spark, d):
    return _round(interact.interaction_strength(line(spark, d), _ICOLS, "y"), 8)


@query(
    "recommended_interactions",
    f"""SELECT "left", "right", round(strength, 8) AS strength, unnest(['Product: ' || "left" || ' * ' || "right", 'Ratio: ' || "left" || ' / (' || "right" || ' + 1e-5)']) AS recipe
        FROM (SELECT * FROM {_STRENGTH} ORDER BY strength DESC LIMIT 3)""",
)
def recommended_interactions(spark, d):
    return _round(interact.recommended_interactions(interact.interaction_strength(line(spark, d), _ICOLS, "y"), 3), 8)


def _side_cells(source: str) -> str:
    binned = f"""(WITH b AS {_bin_sql(f"(SELECT *, row_number() OVER () AS rid FROM {source})", _ICOLS, 4, 'rid')}
        SELECT rid, max(cell) FILTER (WHERE feature = 'qty') AS qty, max(cell) FILTER (WHERE feature = 'price') AS price,
        max(cell) FILTER (WHERE feature = 'disc') AS disc, max(cell) FILTER (WHERE feature = 'tax') AS tax FROM b GROUP BY 1)"""
    return f"""(WITH ib AS {binned} SELECT "left", "right", cell, count(*) / (SELECT count(*) FROM {source})::DOUBLE AS s, count(*) AS n FROM {_cells_sql('ib', 'rid')} GROUP BY 1, 2, 3)"""


_STAB = f"""(WITH a AS {_side_cells(_A)}, b AS {_side_cells(_B)}, j AS (SELECT coalesce(a."left", b."left") AS "left", coalesce(a."right", b."right") AS "right", greatest(coalesce(a.s, 0), 1e-4) AS p, greatest(coalesce(b.s, 0), 1e-4) AS q
    FROM a FULL JOIN b ON a."left" = b."left" AND a."right" = b."right" AND a.cell = b.cell)
    SELECT "left", "right", sum((q - p) * ln(q / p)) AS psi FROM j GROUP BY 1, 2)"""


@query("interaction_stability", f"""SELECT "left", "right", round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'STABLE' WHEN psi < 0.25 THEN 'MODERATE DRIFT' ELSE 'UNSTABLE' END AS stability FROM {_STAB}""")
def interaction_stability(spark, d):
    return _round(interact.interaction_stability(*_ab(spark, d), _ICOLS))


@query(
    "interaction_production_screen",
    f"""WITH s AS (SELECT "left", "right", 100 * avg((n < 0.01 * (SELECT count(*) FROM {_A}))::INT) AS sp FROM {_side_cells(_A)} GROUP BY 1, 2)
        SELECT "left", "right", round(psi, 6) AS psi, round(sp, 6) AS sparse_pct, CASE WHEN psi >= 0.25 THEN 'REMOVE' WHEN sp >= 60 THEN 'MERGE' ELSE 'RETAIN' END AS action FROM {_STAB} JOIN s USING ("left", "right")""",
)
def interaction_production_screen(spark, d):
    a, b = _ab(spark, d)
    return _round(interact.production_screen(a, interact.interaction_stability(a, b, _ICOLS), _ICOLS, "y"))


@query("interaction_candidates", f"SELECT feature, count(DISTINCT value) AS n_unique, round(any_value(mi), 8) AS mi FROM {long_sql(LINE_SQL, _NUM, 'DOUBLE')} JOIN {_MI} USING (feature) GROUP BY 1")
def interaction_candidates(spark, d):
    df = line(spark, d)
    return _round(interact.interaction_inventory(df, _NUM, stats.mutual_information(df, _NUM, "y"), 15), 8)
