"""Whole stages on the test tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from riskloom.operators import quality
from riskloom.operators.sets import stack
from riskloom.plans.comparison_queries import _A, _B, _LCOLS, _LEAK, _ab, _leak, _pairs_sql, _psi_sql
from riskloom.plans.model_queries import FEATURES, learnable
from riskloom.plans.profile_queries import _round, _txn_band, long_sql
from riskloom.plans.registry import ORACLES, query
from riskloom.plans.segment_queries import _LABELLED, _labelled, _MVT
from riskloom.plans.views import DOC_SQL, EV_SQL, LINE_SQL, SCORES_SQL, TEST_SQL, TRAIN_SQL, TXN_SQL, doc, ev, line, scores, txn
from riskloom.session import work_path
from riskloom.sources import governance, store
from riskloom.stages import analysis, features, modelling

COLUMNS = features.Columns("id", "dt", "amt", "y", ["key"], ["product"])


@query(
    "basic_feature_stage",
    f"""WITH m AS (SELECT product, count(*) / (SELECT count(*) FROM {TRAIN_SQL})::DOUBLE AS f FROM {TRAIN_SQL} GROUP BY 1)
        SELECT t.id, split, round((dt % 86400) / 3600.0, 6) AS hour_of_day, round(ln(1 + amt), 6) AS log_amt, round(amt / CASE WHEN key % 7 = 0 THEN 1 ELSE key % 7 END, 6) AS amt_ratio_c1,
        round(coalesce(f, 0), 6) AS product_freq FROM (SELECT *, 'train' AS split FROM {TRAIN_SQL} UNION ALL SELECT *, 'test' FROM {TEST_SQL}) t LEFT JOIN m USING (product)""",
)
def basic_feature_stage(spark, d):
    train, test = (txn(spark, d, part).withColumn("c1", F.col("key") % 7) for part in ("train", "test"))
    a, b = features.basic_features(train, test, COLUMNS, "c1")
    out = stack({"train": a, "test": b}, "split").select("id", "split", "hour_of_day", "log_amt", "amt_ratio_c1", "product_freq")
    return _round(out)


@query(
    "family_feature_stage",
    f"""SELECT id, round((dt % 86400) / 3600.0, 6) AS hour_of_day, CAST((dt // 86400) % 7 AS INTEGER) AS day_of_week, CAST((dt % 86400) / 3600.0 BETWEEN 9 AND 17 AS INTEGER) AS is_business_hour,
        round(ln(1 + amt), 6) AS log_amount, CAST(amt > 150 AS INTEGER) AS is_high_value, round(amt % 1.0, 6) AS cents, 0 AS key_is_missing, count(*) OVER (PARTITION BY key) AS key_frequency FROM {EV_SQL}""",
)
def family_feature_stage(spark, d):
    return _round(features.family_features(ev(spark, d), COLUMNS))


@query(
    "encoding_feature_stage",
    f"""SELECT id, {', '.join(f"CAST(product = '{p}' AS INTEGER) AS p{i}" for i, p in enumerate(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']))}, 0 AS product_unknown FROM {TEST_SQL}""",
)
def encoding_feature_stage(spark, d):
    _, test, _ = features.encoding_features(txn(spark, d, "train"), txn(spark, d, "test"), COLUMNS)
    names = sorted(c for c in test.columns if c.startswith("product_") and c != "product_unknown")
    return test.select("id", *[F.col(c).alias(f"p{i}") for i, c in enumerate(names)], "product_unknown")


_STATS = f"(SELECT key, avg(amt) AS m, median(amt) AS md, coalesce(stddev_samp(amt), 0) AS sd, min(amt) AS lo, max(amt) AS hi, count(amt) AS n FROM {TRAIN_SQL} GROUP BY key)"
_AGG = f"""(SELECT t.id, t.amt, coalesce(s.m, g.m) AS m, coalesce(s.md, g.md) AS md, coalesce(s.sd, 0) AS sd, coalesce(s.lo, g.lo) AS lo, coalesce(s.hi, g.hi) AS hi, coalesce(s.n, 0) AS n,
    coalesce(avg(amt) OVER (PARTITION BY t.key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pm,
    coalesce(avg(amt) OVER (PARTITION BY t.key ORDER BY id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS pr
    FROM {TXN_SQL} t LEFT JOIN {_STATS} s ON t.key = s.key, (SELECT avg(m) AS m, avg(md) AS md, avg(lo) AS lo, avg(hi) AS hi FROM {_STATS}) g)"""


@query(
    "aggregation_feature_stage",
    f"SELECT id, round(m, 6) AS key_amt_mean, round(md, 6) AS key_amt_median, round(sd, 4) AS key_amt_std, lo AS key_amt_min, round(hi, 6) AS key_amt_max, n AS key_amt_count, round(pm, 6) AS key_amt_prior_mean, round(pr, 6) AS key_amt_roll_mean FROM {_AGG}".replace("lo AS key_amt_min", "round(lo, 6) AS key_amt_min"),
)
def aggregation_feature_stage(spark, d):
    out = features.aggregation_features(txn(spark, d, "train"), txn(spark, d, "test"), COLUMNS)
    return _round(out, key_amt_std=4).select(
        "id", "key_amt_mean", "key_amt_median", "key_amt_std", "key_amt_min", "key_amt_max", "key_amt_count", "key_amt_prior_mean", "key_amt_roll_mean"
    )


@query(
    "pair_feature_stage",
    f"SELECT id, round(amt / m, 6) AS key_amt_mean_ratio, round(amt - lo, 6) AS key_amt_min_diff, round(amt * (hi / 1e6), 4) AS scaled_product FROM {_AGG}",
)
def pair_feature_stage(spark, d):
    base = features.aggregation_features(txn(spark, d, "train"), txn(spark, d, "test"), COLUMNS)
    out = features.pair_features(base, ["amt"])
    product = (F.col("key_amt_max_product") / 1e6).alias("scaled_product")
    return _round(out.select("id", "key_amt_mean_ratio", "key_amt_min_diff", product), scaled_product=4)


@query(
    "missing_feature_stage",
    f"""SELECT doc_id, CAST(quality IS NULL AS DOUBLE) AS quality_missing, CAST(toxic IS NULL AS DOUBLE) AS toxic_missing, (quality IS NULL)::INT + (toxic IS NULL)::INT AS missing_count,
        ((quality IS NULL)::INT + (toxic IS NULL)::INT) / 2.0::DOUBLE AS missing_ratio, 1 - ((quality IS NULL)::INT + (toxic IS NULL)::INT) / 2.0::DOUBLE AS completeness,
        (quality IS NULL)::BIGINT + 2 * (toxic IS NULL)::BIGINT AS missing_pattern FROM {DOC_SQL}""",
)
def missing_feature_stage(spark, d):
    out = features.missing_features(doc(spark, d), "doc_id", ["quality", "toxic"])
    return features.gated_sink(out, work_path(spark, "missing"), "missing", "v1")[1]


@query("feature_validation_stage")
def feature_validation_stage(spark, d):
    df = learnable(spark, d)
    train, test = df.filter("orderkey % 5 <> 0"), df.filter("orderkey % 5 = 0")
    return features.feature_validation(train, test, FEATURES, "y", {f: True for f in FEATURES})


@query("schema_validation", "SELECT unnest(['lang should be numeric', 'missing column absent']) AS problem, count(*) AS n_rows FROM documents GROUP BY 1")
def schema_validation(spark, d):
    from riskloom.operators.profile import validate_schema

    df = doc(spark, d)
    errors = validate_schema(df, {"doc_id": True, "lang": True, "absent": False})
    rows = F.explode(F.array(*[F.lit(e) for e in errors])).alias("problem")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(rows, "n_rows")


@query("view_drift", f"SELECT feature, round(psi, 6) AS psi FROM {_psi_sql('histogram', chr(39) + 'price' + chr(39) + ', ' + chr(39) + 'qty' + chr(39))}")
def view_drift(spark, d):
    base = work_path(spark, "views")
    a, b = _ab(spark, d)
    written = [
        store.ingest(df, store.FeatureView(name, "orderkey", ("price", "qty")), base) for name, df in (("train_view", a), ("test_view", b))
    ]
    return _round(features.view_drift(*written, ["price", "qty"]))


@query("leakage_run", f"SELECT feature, round(corr(value, y), 6) AS pearson, CASE WHEN abs(corr(value, y)) >= 0.95 THEN 'LEAK' ELSE 'OK' END AS status FROM {long_sql(_LEAK, _LCOLS, 'DOUBLE', 'y')} GROUP BY 1")
def leakage_run(spark, d):
    return _round(features.leakage_run(_leak(spark, d), _LCOLS, "y"))


@query(
    "missing_indicator_correlation",
    f"""SELECT 'quality' AS "left", 'flagged' AS "right", round(corr((quality IS NULL)::INT, (n_chars > 2000)::INT), 6) AS r FROM {DOC_SQL} UNION ALL
        SELECT 'quality', 'toxic', round(corr((quality IS NULL)::INT, (toxic IS NULL)::INT), 6) FROM {DOC_SQL} UNION ALL
        SELECT 'flagged', 'toxic', round(corr((n_chars > 2000)::INT, (toxic IS NULL)::INT), 6) FROM {DOC_SQL}""",
)
def missing_indicator_correlation(spark, d):
    df = doc(spark, d).withColumn("flagged", F.when(F.col("n_chars") <= 2000, 1))
    return _round(analysis.missing_correlation(df, ["quality", "flagged", "toxic"]))


_SERIES = f"(SELECT qty AS C1, disc AS V1, tax AS D1, y FROM {LINE_SQL})"


@query(
    "anonymous_series",
    f"""WITH l AS {long_sql(_SERIES, ['C1', 'V1', 'D1'], 'DOUBLE', 'y')}, q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1)
        SELECT feature, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS low, round(any_value(q1), 4) AS q1, round(median(value), 4) AS median,
        round(any_value(q3), 4) AS q3, max(value) AS high, round(skewness(value), 4) AS skew, round(kurtosis(value), 4) AS kurt,
        round(100.0 * count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*), 4) AS outlier_pct, round(corr(value, y), 4) AS target_correlation, CAST(0 AS DOUBLE) AS missing_pct
        FROM l JOIN q USING (feature) GROUP BY 1""",
)
def anonymous_series(spark, d):
    df = line(spark, d).select(F.col("qty").alias("C1"), F.col("disc").alias("V1"), F.col("tax").alias("D1"), "y")
    return _round(analysis.anonymous_series(df, ["C1", "V1", "D1"], "y"), 4, low=6, high=6)


@query(
    "anonymous_inventory",
    f"""SELECT feature, CASE WHEN feature = 'quality' THEN 'C' ELSE 'M' END AS series, round(100.0 * (count(*) - count(value)) / count(*), 6) AS missing_pct, count(DISTINCT value) AS n_unique,
        CASE WHEN count(DISTINCT value) = 2 THEN 'Binary' WHEN count(DISTINCT value) <= 10 THEN 'Low' ELSE 'High' END AS cardinality,
        CASE WHEN 100.0 * (count(*) - count(value)) / count(*) < 20 THEN 'High' WHEN 100.0 * (count(*) - count(value)) / count(*) < 60 THEN 'Medium'
        WHEN 100.0 * (count(*) - count(value)) / count(*) < 95 THEN 'Low' ELSE 'None' END AS availability FROM {long_sql(DOC_SQL, ['quality', 'toxic', 'lang', 'source'])} GROUP BY 1""",
)
def anonymous_inventory(spark, d):
    return _round(analysis.anonymous_inventory(doc(spark, d), {"C": ["quality"], "M": ["toxic", "lang", "source"]}))


@query(
    "anonymous_flags",
    f"""WITH c AS (SELECT feature, coalesce(value, 'nan') AS value, 100.0 * avg(y) AS rate FROM {long_sql(_LABELLED, ['toxic', 'lang', 'quality'], keep='y')} GROUP BY 1, 2),
        m AS (SELECT feature, 100.0 * (count(*) - count(value)) / count(*) AS miss FROM {long_sql(_LABELLED, ['toxic', 'lang', 'quality'])} GROUP BY 1)
        SELECT feature, round(any_value(miss), 6) AS missing_pct, count(*) AS cardinality, arg_min(value, (-rate, value)) AS value, round(max(rate), 6) AS rate_pct,
        round(max(rate) / (SELECT 100 * avg(y) FROM {_LABELLED}), 6) AS relative_risk FROM c JOIN m USING (feature) GROUP BY 1""",
)
def anonymous_flags(spark, d):
    return _round(analysis.flag_series(_labelled(spark, d), ["toxic", "lang", "quality"], "y"))


@query(
    "identity_columns",
    f"""WITH s AS (SELECT 'n_chars' AS feature, avg(n_chars) AS mean, stddev_samp(n_chars) AS std, skewness(n_chars) AS skew,
        100.0 * (SELECT count(*) FROM documents, (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents) WHERE n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a)) / count(*) AS o FROM documents)
        SELECT feature, round(b, 6) AS rate_present, round(a, 6) AS rate_missing, round(mean, 4) AS mean, round(std, 4) AS std, round(skew, 4) AS skew, round(o, 6) AS outlier_pct,
        CASE WHEN feature = 'n_chars' THEN 'Numerical' ELSE 'Categorical' END AS family FROM (SELECT feature, a, b FROM {_MVT} WHERE feature IN ('lang', 'toxic')
        UNION ALL SELECT 'n_chars', 0, 100.0 * avg(y) FROM {_LABELLED}) LEFT JOIN s USING (feature)""",
)
def identity_columns(spark, d):
    return _round(analysis.id_columns(_labelled(spark, d), ["n_chars"], ["lang", "toxic"], "y"), mean=4, std=4, skew=4)




# --- analysis runs: how many rows each report of an analyzer has --------------------------------


def counts_sql(**reports: int | str) -> str:
    """Report names with their row counts: a number where it follows from the columns, else SQL."""
    return " UNION ALL ".join(f"SELECT '{name}' AS report, CAST(({n}) AS BIGINT) AS n_rows" for name, n in reports.items())


_PRODUCTS = f"SELECT count(DISTINCT product) FROM {TRAIN_SQL}"
_AMOUNT_BANDS = f"SELECT count(DISTINCT CASE WHEN amt <= 20 THEN 1 WHEN amt <= 100 THEN 2 WHEN amt <= 500 THEN 3 WHEN amt <= 2000 THEN 4 ELSE 5 END) FROM {EV_SQL} WHERE amt > 0"
_REGIONS = f"SELECT count(DISTINCT key % 7) FROM {EV_SQL}"
_TEXT_VALUES = f"SELECT count(DISTINCT lang) + count(DISTINCT toxic) FROM {DOC_SQL}"

def _counted(reports, folder):
    return analysis.row_counts(analysis.save(reports, folder))


@query(
    "target_analysis_run",
    f"""SELECT 'distribution' AS report, count(DISTINCT y) AS n_rows FROM {EV_SQL} UNION ALL SELECT 'imbalance', 1 UNION ALL
        SELECT 'over_time', count(DISTINCT (dt // 3600) % 24) + count(DISTINCT dt // 86400) + count(DISTINCT dt // 604800) FROM {EV_SQL} UNION ALL
        SELECT 'by_identity', 2 UNION ALL SELECT 'by_amount', 5 UNION ALL SELECT 'class_statistics', 4""",
)
def target_analysis_run(spark, d):
    reports = analysis.target_reports(ev(spark, d), "y", "dt", "amt", ["product", "key"], ["amt", "dt"])
    return _counted(reports, work_path(spark, "target-reports"))


@query(
    "time_analysis_run",
    f"""WITH a AS (SELECT * FROM {EV_SQL} WHERE dt < 20 * 86400) SELECT 'hour' AS report, count(DISTINCT (dt // 3600) % 24) AS n_rows FROM a UNION ALL SELECT 'day', count(DISTINCT dt // 86400) FROM a
        UNION ALL SELECT 'week', count(DISTINCT dt // 604800) FROM a UNION ALL SELECT 'month', count(DISTINCT dt // 2592000) FROM a UNION ALL SELECT 'span', 1 UNION ALL SELECT 'trends', count(DISTINCT dt // 86400) FROM a
        UNION ALL SELECT 'seasonality', 31 UNION ALL SELECT 'hour_drift', 24 UNION ALL SELECT 'hour_drift_summary', 1 UNION ALL SELECT 'anomalies', count(DISTINCT dt // 86400) FROM a""",
)
def time_analysis_run(spark, d):
    df = ev(spark, d)
    reports = analysis.time_reports(df.filter(F.col("dt") < 20 * 86400), df.filter(F.col("dt") >= 20 * 86400), "dt", "y", "amt")
    return _counted(reports, work_path(spark, "time-reports"))


@query("numerical_analysis_run", "SELECT unnest(['distributions', 'outliers', 'transformations', 'shape']) AS report, CAST(4 AS BIGINT) AS n_rows")
def numerical_analysis_run(spark, d):
    return _counted(analysis.numerical_reports(line(spark, d), ["qty", "price", "disc", "tax"]), work_path(spark, "numeric-reports"))


@query(
    "categorical_analysis_run",
    counts_sql(inventory=2, cardinality=2, rare=2, imbalance=2, rates=f"SELECT ({_PRODUCTS}) + 3", stability=2, encoding=2),
)
def categorical_analysis_run(spark, d):
    reports = analysis.categorical_reports(_txn_band(spark, d, "train"), _txn_band(spark, d, "test"), ["product", "band"], "y")
    return _counted(reports, work_path(spark, "categorical-reports"))


@query(
    "transaction_analysis_run",
    counts_sql(
        amount=_AMOUNT_BANDS, amount_statistics=1, product=_REGIONS, keys=1, timing=24, distance=4,
        profiles=f"SELECT count(*) FROM (SELECT DISTINCT key % 7, CASE WHEN amt <= 20 THEN 1 WHEN amt <= 100 THEN 2 WHEN amt <= 500 THEN 3 WHEN amt <= 2000 THEN 4 ELSE 5 END FROM {EV_SQL} WHERE amt > 0)",
    ),
)
def transaction_analysis_run(spark, d):
    df = ev(spark, d).withColumn("region", F.col("key") % 7)
    reports = analysis.transaction_reports(df, "y", "dt", "amt", "region", ["region"], ["amt"])
    return _counted(reports, work_path(spark, "transaction-reports"))


@query(
    "identity_analysis_run",
    counts_sql(inventory=3, ids=3, availability=f"SELECT count(DISTINCT toxic IS NULL) FROM {DOC_SQL}", missing=3, values=_TEXT_VALUES),
)
def identity_analysis_run(spark, d):
    return _counted(analysis.identity_reports(_labelled(spark, d), ["n_chars"], ["lang", "toxic"], "y"), work_path(spark, "identity-reports"))


@query(
    "anonymous_analysis_run",
    counts_sql(inventory=3, series=2, flags=1, shape=2, anova=2, hotspots=2),
)
def anonymous_analysis_run(spark, d):
    df = line(spark, d).select(F.col("qty").alias("C1"), F.col("disc").alias("V1"), F.col("status").alias("M1"), "y")
    return _counted(analysis.anonymous_reports(df, {"C": ["C1"], "V": ["V1"], "M": ["M1"]}, ["M1"], "y"), work_path(spark, "anonymous-reports"))


@query(
    "correlation_analysis_run",
    counts_sql(
        inventory=4, pearson=6, spearman=6, target=4, hubs=2, groups=2, pruning=1,
    ),
)
def correlation_analysis_run(spark, d):
    df = line(spark, d).withColumn("price2", F.col("price") + F.col("qty"))
    return _counted(analysis.correlation_reports(df, ["qty", "price", "price2", "disc"], "y"), work_path(spark, "correlation-reports"))


@query(
    "interaction_analysis_run",
    counts_sql(separation=3, hotspots=3, odds=48, strength=3, recommended=6, triples=1, stability=3, screen=3),
)
def interaction_analysis_run(spark, d):
    return _counted(analysis.interaction_reports(*_ab(spark, d), ["qty", "price", "disc"], "y"), work_path(spark, "interaction-reports"))


@query(
    "statistical_test_run",
    counts_sql(ks=3, chi_square=1, mann_whitney=3, anova=1, mutual_information=3, corrections=4, effect_sizes=3, ranking=4),
)
def statistical_test_run(spark, d):
    return _counted(analysis.test_reports(line(spark, d), ["qty", "price", "disc"], ["status"], "y", "price"), work_path(spark, "test-reports"))


@query("drift_analysis_run", "SELECT unnest(['moments', 'ks', 'psi', 'stability', 'report']) AS report, unnest([3, 3, 4, 4, 4])::BIGINT AS n_rows")
def drift_analysis_run(spark, d):
    return _counted(analysis.drift_reports(*_ab(spark, d), ["qty", "price", "disc"], ["status"]), work_path(spark, "drift-reports"))


@query("missing_analysis_run", "SELECT unnest(['train', 'test', 'families', 'vs_target', 'comparison', 'correlation']) AS report, unnest([3, 3, 2, 3, 3, 3])::BIGINT AS n_rows")
def missing_analysis_run(spark, d):
    df = _labelled(spark, d)
    families = {"lang": "Document", "quality": "Label", "toxic": "Label"}
    reports = analysis.missing_reports(df.filter("doc_id % 5 <> 0"), df.filter("doc_id % 5 = 0"), list(families), families, "y")
    return _counted(reports, work_path(spark, "missing-reports"))


@query(
    "profile_analysis_run",
    counts_sql(inventory=1, cardinality=8, completeness=1, advice=f"SELECT (count(DISTINCT lang) <= 10)::INT + (count(DISTINCT source) <= 10 OR count(DISTINCT source) > 100)::INT FROM {DOC_SQL} WHERE doc_id % 5 <> 0", dictionary=8),
)
def profile_analysis_run(spark, d):
    df = _labelled(spark, d)
    reports = analysis.profile_reports(df.filter("doc_id % 5 <> 0"), df.filter("doc_id % 5 = 0"), "y", ["quality", "toxic"], ["lang", "source"])
    return _counted(reports, work_path(spark, "profile-reports"))


@query(
    "quality_analysis_run",
    counts_sql(missing=6, duplicates=3, constant=0, near_constant=0, invalid=3, infinite=1, outliers=2, consistency=1),
)
def quality_analysis_run(spark, d):
    return _counted(analysis.quality_reports(txn(spark, d, "train"), txn(spark, d, "test"), "id", "y", ["amt", "dt"]), work_path(spark, "quality-reports"))


# --- modelling and monitoring -----------------------------------------------------------------


@query("training_stage")
def training_stage(spark, d):
    return modelling.train_and_compare(learnable(spark, d), FEATURES, ["orderkey", "partkey", "suppkey", "linenumber"])["comparison"]


@query("time_cross_validation")
def time_cross_validation(spark, d):
    return modelling.cross_validate(learnable(spark, d), FEATURES, ["orderkey", "partkey", "suppkey", "linenumber"], 2)


@query(
    "evaluation_stage",
    f"""SELECT unnest(['curve', 'threshold', 'calibration', 'lift', 'sweep', 'business', 'errors', 'error_summary']) AS report, unnest([1, 1, 1, 10, 99, 1, 20, 1])::BIGINT AS n_rows FROM (SELECT count(*) FROM {SCORES_SQL})""",
)
def evaluation_stage(spark, d):
    return analysis.row_counts(modelling.evaluation_reports(scores(spark, d), "amount", ["orderkey", "linenumber", "amount"], ["orderkey", "linenumber", "y"]))


@query("explanation_stage")
def explanation_stage(spark, d):
    from riskloom.operators.model import fit_logistic

    df = learnable(spark, d)
    return analysis.row_counts(modelling.explanation_reports(fit_logistic(df, FEATURES), df, FEATURES, ["orderkey", "partkey", "suppkey"]))


@query(
    "monitoring_stage",
    f"""SELECT psi >= 0.2 AS has_drift, true AS has_decay, true AS retrain FROM (SELECT max(psi) AS psi FROM {_psi_sql('monitor')}), (SELECT count(*) FROM {_A}), (SELECT count(*) FROM {_B})""",
)
def monitoring_stage(spark, d):
    p = F.round(1.0 / (1.0 + F.exp(-(F.col("qty") - 25.5) / 10.0)), 6)
    a, b = (df.withColumn("p", p) for df in _ab(spark, d))
    return modelling.monitoring_reports(a, b, ["qty", "price", "disc", "tax"], "y", 0.7)["retrain"]


@query("governed_feature_view", f"SELECT 'price' AS feature, count(*) AS n_rows FROM {_A} UNION ALL SELECT 'qty', count(*) FROM {_A}")
def governed_feature_view(spark, d):
    a, _ = _ab(spark, d)
    base = work_path(spark, "governed")
    view = store.FeatureView("line_view", "orderkey", ("price", "qty"), "v1", "line features", "lineitem", "aggregate", ("reviewed",))
    written = store.ingest(a, view, base)
    return quality.missing_report(written, view.features).select("feature", "n_rows")


@query(
    "governed_feature_views",
    f"""SELECT view, unnest(['price', 'qty']) AS feature, n AS n_rows FROM (SELECT 'early' AS view, count(*) AS n FROM {_A} UNION ALL SELECT 'late', count(*) FROM {_B})""",
)
def governed_feature_views(spark, d):
    """Both sides of the table, each ingested whole as a view of its own."""
    base, out = work_path(spark, "governed"), None
    for name, df in zip(("early", "late"), _ab(spark, d)):
        view = store.FeatureView(name, "orderkey", ("price", "qty"), "v1", "line features", "lineitem", "aggregate", ("reviewed",))
        report = quality.missing_report(store.ingest(df, view, base), view.features).select(F.lit(name).alias("view"), "feature", "n_rows")
        out = report if out is None else out.unionByName(report)
    return out


@query(
    "governed_verdicts",
    f"""SELECT CASE WHEN feature IN ('price', 'qty') THEN 'amounts' ELSE 'shares' END AS view, CASE WHEN feature IN ('price', 'qty') THEN 'v2' ELSE 'v1' END AS version,
        CASE WHEN feature IN ('price', 'qty') THEN 3 ELSE 2 END::BIGINT AS commit, * FROM ({ORACLES['governance_audit']})""",
)
def governed_verdicts(spark, d):
    """Verdicts of two views read back from the registry: the second writer starts stale and retries, then a new version of the first follows."""
    a, b = _ab(spark, d)
    registry = governance.VerdictRegistry(spark, work_path(spark, "verdicts"))
    amounts = store.FeatureView("amounts", "orderkey", ("price", "qty"))
    seen = registry.version()
    registry.commit(governance.view_verdicts(a, b, amounts), seen)
    shares = governance.view_verdicts(a, b, store.FeatureView("shares", "orderkey", ("disc", "tax")))
    try:
        registry.commit(shares, seen)
    except governance.Conflict:
        registry.publish(shares)
    registry.publish(governance.view_verdicts(a, b, replace(amounts, version="v2")))
    return _round(registry.current(), variance=4)
