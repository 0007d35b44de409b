"""Profiles, missing values, duplicates, outliers and quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import schema
from riskloom.operators import profile, quality
from riskloom.operators.rows import with_row
from riskloom.plans.registry import query
from riskloom.plans.views import (
    DOC_SQL, LINE_FEATURES, LINE_SQL, TEST_SQL, TRAIN_SQL, TXN_SQL, doc, line, rounded, table, txn,
)


def long_sql(source: str, columns, kind: str = "VARCHAR", keep: str = "") -> str:
    """The unpivot of a view as SQL: (keep, feature, value)."""
    keep = f"{keep}, " if keep else ""
    parts = [f"SELECT {keep}'{c}' AS feature, CAST({c} AS {kind}) AS value FROM {source}" for c in columns]
    return "(" + " UNION ALL ".join(parts) + ")"


def _round(df, digits=6, **special):
    """Round every double column, keep the others."""
    return df.select(
        *[
            rounded(f.name, special.get(f.name, digits)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
            for f in df.schema
        ]
    )


_DOC_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic", "has_label"]
_DOC_LONG = long_sql(DOC_SQL, _DOC_COLUMNS)
_DOC_FAMILIES = {"doc_id": "Key", "lang": "Document", "source": "Document", "n_chars": "Document",
                 "quality": "Label", "toxic": "Label", "has_label": "Label"}
_FAMILY_SQL = "CASE WHEN feature = 'doc_id' THEN 'Key' WHEN feature IN ('lang','source','n_chars') THEN 'Document' ELSE 'Label' END"

_MISSING = f"""(SELECT feature, count(*) AS n_rows, count(value) AS available, count(*) - count(value) AS missing,
    100.0 * (count(*) - count(value)) / count(*) AS missing_pct FROM {_DOC_LONG} GROUP BY feature)"""


@query(
    "missing_report",
    f"""SELECT feature, n_rows, available, missing, round(missing_pct, 6) AS missing_pct,
        CASE WHEN missing_pct = 0 THEN 'Complete' WHEN missing_pct <= 10 THEN 'Low Missing'
        WHEN missing_pct <= 30 THEN 'Moderate Missing' WHEN missing_pct <= 60 THEN 'High Missing' ELSE 'Very High Missing' END AS level,
        CASE WHEN missing_pct = 0 THEN 'Keep' WHEN missing_pct < 5 THEN 'Impute' WHEN missing_pct <= 30 THEN 'Evaluate Importance'
        WHEN missing_pct <= 60 THEN 'Create Missing Indicator' ELSE 'Drop or Specialized' END AS action FROM {_MISSING}""",
)
def missing_report(spark, d):
    return _round(quality.missing_report(doc(spark, d)))


@query(
    "missing_by_family",
    f"""SELECT {_FAMILY_SQL} AS family, count(*) AS n_columns, round(avg(missing_pct), 6) AS avg_pct,
        round(max(missing_pct), 6) AS max_pct, round(min(missing_pct), 6) AS min_pct, sum(missing)::BIGINT AS missing_cells
        FROM {_MISSING} GROUP BY 1""",
)
def missing_by_family(spark, d):
    return _round(quality.family_missingness(quality.missing_report(doc(spark, d)), _DOC_FAMILIES))


@query(
    "missing_train_test_comparison",
    f"""WITH a AS (SELECT feature, 100.0*(count(*)-count(value))/count(*) AS train_pct FROM {long_sql(f"(SELECT * FROM {DOC_SQL} WHERE doc_id % 5 <> 0)", _DOC_COLUMNS)} GROUP BY 1),
        b AS (SELECT feature, 100.0*(count(*)-count(value))/count(*) AS test_pct FROM {long_sql(f"(SELECT * FROM {DOC_SQL} WHERE doc_id % 5 = 0)", _DOC_COLUMNS)} GROUP BY 1)
        SELECT feature, round(train_pct, 6) AS train_pct, round(test_pct, 6) AS test_pct, round(abs(train_pct - test_pct), 6) AS abs_diff,
        abs(train_pct - test_pct) > 5 AS is_drifted FROM a JOIN b USING (feature)""",
)
def missing_train_test_comparison(spark, d):
    df = doc(spark, d)
    held_out = F.col("doc_id") % 5 == 0
    return _round(quality.missing_comparison(df.filter(~held_out), df.filter(held_out), _DOC_COLUMNS))


@query(
    "missing_indicator_candidates",
    f"SELECT feature, round(missing_pct / 100, 6) AS ratio FROM {_MISSING} WHERE missing_pct BETWEEN 5 AND 95",
)
def missing_indicator_candidates(spark, d):
    return _round(quality.discover_indicators(doc(spark, d)))


@query(
    "completeness_summary",
    f"""SELECT count(*) AS n_rows, round(sum(5 + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) * 100.0 / (count(*) * 7), 6) AS overall_pct,
        round(avg((5 + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) * 100.0 / 7), 6) AS mean_row_pct,
        round(min((5 + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) * 100.0 / 7), 6) AS worst_row_pct FROM {DOC_SQL}""",
)
def completeness_summary(spark, d):
    return _round(profile.completeness_summary(doc(spark, d)))


@query(
    "schema_profile",
    f"""WITH l AS {_DOC_LONG}, k AS (SELECT * FROM (VALUES ('doc_id','bigint',true),('lang','string',false),('source','string',false),
        ('n_chars','bigint',true),('quality','int',true),('toxic','int',true),('has_label','int',true)) t(feature, dtype, is_numeric))
        SELECT feature, dtype, is_numeric, count(*) > count(value) AS nullable, count(DISTINCT value) AS cardinality,
        round(100.0 * (count(*) - count(value)) / count(*), 6) AS missing_pct,
        CASE WHEN is_numeric THEN min(try_cast(value AS DOUBLE)) END AS low, CASE WHEN is_numeric THEN max(try_cast(value AS DOUBLE)) END AS high
        FROM l JOIN k USING (feature) GROUP BY 1, 2, 3""",
)
def schema_profile(spark, d):
    return _round(profile.schema_profile(doc(spark, d)))


@query(
    "feature_dictionary_by_family",
    f"""WITH s AS (SELECT feature, count(DISTINCT value) AS n_unique, 100.0*(count(*)-count(value))/count(*) AS missing_pct FROM {_DOC_LONG} GROUP BY 1)
        SELECT CASE WHEN feature = 'doc_id' THEN 'Identifier' WHEN feature IN ('quality', 'toxic') THEN 'Target' WHEN feature = 'has_label' THEN 'Boolean'
        WHEN feature = 'n_chars' THEN 'Numeric' ELSE 'Categorical' END AS family, count(*) AS n_columns,
        string_agg(feature, ', ' ORDER BY feature) AS columns, max(n_unique) AS max_cardinality, round(avg(missing_pct), 6) AS avg_missing_pct
        FROM s GROUP BY 1""",
)
def feature_dictionary_by_family(spark, d):
    df = doc(spark, d)
    families = {f.name: schema.dictionary_family(f, schema.TEST_RULES) for f in df.schema}
    report = profile.with_family(profile.schema_profile(df), families)
    return _round(
        report.groupBy("family").agg(
            F.count(F.lit(1)).alias("n_columns"),
            F.array_join(F.array_sort(F.collect_list("feature")), ", ").alias("columns"),
            F.max("cardinality").alias("max_cardinality"),
            F.avg("missing_pct").alias("avg_missing_pct"),
        )
    )


@query(
    "dataset_inventory",
    f"""SELECT (SELECT count(*) FROM {TRAIN_SQL}) AS train_rows, (SELECT count(*) FROM {TRAIN_SQL}) AS train_identity_rows,
        (SELECT sum(y)::BIGINT FROM {TRAIN_SQL}) AS positives, (SELECT sum(1 - y)::BIGINT FROM {TRAIN_SQL}) AS negatives,
        5 AS train_numeric, 1 AS train_categorical, 0 AS train_boolean,
        (SELECT count(*) FROM {TEST_SQL}) AS test_rows, (SELECT count(*) FROM {TEST_SQL}) AS test_identity_rows,
        5 AS test_numeric, 1 AS test_categorical, 0 AS test_boolean,
        (SELECT round(100.0 * avg(y), 6) FROM {TRAIN_SQL}) AS positive_pct, CAST(100 AS DOUBLE) AS train_identity_pct, CAST(100 AS DOUBLE) AS test_identity_pct""",
)
def dataset_inventory(spark, d):
    return _round(profile.inventory(txn(spark, d, "train"), txn(spark, d, "test"), "y", ["key"]))


_LINE_LONG = long_sql(LINE_SQL, LINE_FEATURES, "DOUBLE")


@query(
    "numeric_statistics",
    f"""WITH l AS {_LINE_LONG}, m AS (SELECT feature, value AS mode FROM (SELECT feature, value,
        row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS r FROM l GROUP BY 1, 2) WHERE r = 1),
        s AS (SELECT feature, count(value) AS n, count(DISTINCT value) AS n_unique, avg(value) AS mean, min(value) AS low, max(value) AS high,
        var_samp(value) AS variance, stddev_samp(value) AS std, quantile_cont(value, 0.25) AS q1, median(value) AS median,
        quantile_cont(value, 0.75) AS q3, skewness(value) AS skew, kurtosis(value) AS kurt, kurtosis_pop(value) AS kurt_pop FROM l GROUP BY 1)
        SELECT feature, n, n_unique, round(mean, 4) AS mean, low, high, round(variance, 2) AS variance, round(std, 4) AS std, round(q1, 4) AS q1,
        round(median, 4) AS median, round(q3, 4) AS q3, mode, round(high - low, 4) AS range, round(q3 - q1, 4) AS iqr, round(std / mean, 4) AS cv,
        round(skew, 4) AS skew, round(kurt, 4) AS kurt, round(kurt_pop, 4) AS kurt_pop,
        round(skew * (n - 2) / sqrt(CAST(n AS DOUBLE) * (n - 1)), 4) AS skew_pop FROM s JOIN m USING (feature)""",
)
def numeric_statistics(spark, d):
    stats = profile.numeric_statistics(line(spark, d), LINE_FEATURES)
    return _round(stats, 4, variance=2, low=6, high=6, mode=6)


_TXN_TEXTS = ["product", "band"]
_TXN_BAND = f"(SELECT product, CASE WHEN amt > 450000 THEN 'top' WHEN amt > 200000 THEN 'high' ELSE 'low' END AS band, y, key FROM {TXN_SQL})"


def _txn_band(spark, d, part=None):
    band = F.when(F.col("amt") > 450000, "top").when(F.col("amt") > 200000, "high").otherwise("low")
    return txn(spark, d, part).withColumn("band", band)


_CAT_COUNTS = f"(SELECT feature, value, count(*) AS n FROM {long_sql(_TXN_BAND, [*_TXN_TEXTS, 'key'])} GROUP BY 1, 2)"
_CAT_STATS = f"""(SELECT feature, count(*) AS n_categories, arg_min(value, (-n, value)) AS most_frequent,
    arg_min(value, (n, value)) AS least_frequent, max(n) AS dominant_count, min(n) AS smallest_count, sum(n)::BIGINT AS n_known,
    -sum((n / total) * ln(n / total)) AS entropy_nats FROM (SELECT *, sum(n) OVER (PARTITION BY feature)::DOUBLE AS total FROM {_CAT_COUNTS}) GROUP BY 1)"""


@query(
    "categorical_statistics",
    f"""SELECT feature, n_categories, most_frequent, least_frequent, dominant_count, smallest_count, n_known, n_known AS n_rows,
        round(entropy_nats, 6) AS entropy_nats, round(entropy_nats / ln(2), 6) AS entropy_bits,
        round(100.0 * dominant_count / n_known, 6) AS dominant_pct, round(100.0 * dominant_count / n_known, 6) AS dominant_known_pct FROM {_CAT_STATS}""",
)
def categorical_statistics(spark, d):
    return _round(profile.categorical_statistics(_txn_band(spark, d), [*_TXN_TEXTS, "key"]))


@query(
    "category_imbalance",
    f"""SELECT feature, round(100.0 * dominant_count / n_known, 6) AS dominant_pct, round(100.0 * smallest_count / n_known, 6) AS smallest_pct,
        round(dominant_count / smallest_count, 6) AS imbalance_ratio, round(entropy_nats / ln(2), 6) AS entropy_bits,
        round(entropy_nats / ln(n_categories), 6) AS diversity FROM {_CAT_STATS}""",
)
def category_imbalance(spark, d):
    return _round(profile.category_imbalance(profile.categorical_statistics(_txn_band(spark, d), [*_TXN_TEXTS, "key"])))


_CARD_CLASS = """CASE WHEN n_unique = 1 THEN 'Constant' WHEN n_unique = 2 THEN 'Binary' WHEN n_unique <= 10 THEN 'Low Cardinality'
    WHEN n_unique <= 100 THEN 'Medium Cardinality' ELSE 'High Cardinality' END"""


@query(
    "cardinality_report",
    f"""SELECT feature, n_known AS n_rows, n_categories AS n_unique, most_frequent AS most_common, least_frequent AS least_common,
        round(100.0 * n_categories / n_known, 6) AS unique_pct, {_CARD_CLASS.replace('n_unique', 'n_categories')} AS class FROM {_CAT_STATS}""",
)
def cardinality_report(spark, d):
    return _round(profile.cardinality_report(_txn_band(spark, d), [*_TXN_TEXTS, "key"]))


@query("approximate_cardinality")
def approximate_cardinality(spark, d):
    return profile.cardinality_report(txn(spark, d), approximate=True)


_DOC_TEXTS = ["lang", "source", "quality", "toxic"]
_DOC_TEXTS_LONG = long_sql(DOC_SQL, _DOC_TEXTS)


@query(
    "category_frequencies",
    f"""SELECT feature, value AS category, n, round(100.0 * n / sum(n) OVER (PARTITION BY feature), 6) AS pct,
        round(100.0 * sum(n) OVER w / sum(n) OVER (PARTITION BY feature), 6) AS cumulative_pct, row_number() OVER w AS rank
        FROM (SELECT feature, value, count(*) AS n FROM {_DOC_TEXTS_LONG} WHERE value IS NOT NULL GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY feature ORDER BY n DESC, value)""",
)
def category_frequencies(spark, d):
    return _round(profile.category_frequencies(doc(spark, d), _DOC_TEXTS))


@query(
    "categorical_inventory",
    f"""SELECT feature, count(value) AS n_categories, sum(CASE WHEN value IS NULL THEN n ELSE 0 END)::BIGINT AS missing_count,
        round(100.0 * sum(CASE WHEN value IS NULL THEN n ELSE 0 END) / sum(n), 6) AS missing_pct,
        arg_min(value, (-n, value)) FILTER (WHERE value IS NOT NULL) AS dominant_category,
        round(100.0 * max(n) FILTER (WHERE value IS NOT NULL) / sum(n) FILTER (WHERE value IS NOT NULL), 6) AS dominant_pct
        FROM (SELECT feature, value, count(*) AS n FROM {_DOC_TEXTS_LONG} GROUP BY 1, 2) GROUP BY 1""",
)
def categorical_inventory(spark, d):
    return _round(profile.categorical_inventory(doc(spark, d), _DOC_TEXTS))


@query(
    "rare_categories",
    f"""WITH t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS total FROM {_CAT_COUNTS}), r AS (SELECT *,
        row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS r FROM t WHERE n < total * 0.01),
        f AS (SELECT DISTINCT feature, total FROM t)
        SELECT f.feature, count(r.value) AS n_rare, coalesce(sum(n), 0)::BIGINT AS rare_rows, round(100.0 * coalesce(sum(n), 0) / any_value(f.total), 6) AS rare_pct,
        coalesce(string_agg(value, ', ' ORDER BY r) FILTER (WHERE r <= 10), '') AS examples FROM f LEFT JOIN r ON f.feature = r.feature GROUP BY 1""",
)
def rare_categories(spark, d):
    return _round(profile.rare_categories(_txn_band(spark, d), [*_TXN_TEXTS, "key"]))


@query(
    "profile_advice",
    f"""WITH s AS (SELECT feature, count(DISTINCT value) AS n_unique, 100.0 * count(value) / count(*) AS complete FROM
        {long_sql(f"(SELECT doc_id, lang, source, CASE WHEN toxic = 2 THEN 1 END AS nothing, 1 AS one FROM {DOC_SQL})", ['doc_id', 'lang', 'source', 'nothing', 'one'])} GROUP BY 1)
        SELECT feature, 'Potential Removal' AS advice FROM s WHERE complete = 0 UNION ALL
        SELECT feature, 'High Missingness Warning' FROM s WHERE complete > 0 AND complete < 10 UNION ALL
        SELECT feature, 'Constant Feature' FROM s WHERE n_unique = 1 UNION ALL
        SELECT feature, 'Target Encoding' FROM s WHERE feature IN ('lang', 'source') AND n_unique > 100 UNION ALL
        SELECT feature, 'One-Hot Encoding' FROM s WHERE feature IN ('lang', 'source') AND n_unique BETWEEN 2 AND 10""",
)
def profile_advice(spark, d):
    df = doc(spark, d).select(
        "doc_id", "lang", "source", F.when(F.col("toxic") == 2, 1).alias("nothing"), F.lit(1).alias("one")
    )
    return profile.profile_advice(profile.cardinality_report(df), quality.missing_report(df), ["lang", "source"])


@query(
    "unified_feature_dictionary",
    f"""WITH s AS (SELECT feature, count(DISTINCT value) AS n_unique, 100.0 * count(value) / count(*) AS complete FROM {_DOC_LONG} GROUP BY 1)
        SELECT feature, n_unique, {_CARD_CLASS} AS class, round(complete, 6) AS complete_pct,
        CASE WHEN feature IN ('lang', 'source') AND n_unique BETWEEN 2 AND 10 THEN 'One-Hot Encoding'
        WHEN feature IN ('lang', 'source') AND n_unique > 100 THEN 'Target Encoding'
        WHEN n_unique > 100 THEN 'Numerical scaling or robust target encoding.' ELSE 'Pass through as baseline feature.' END AS processing FROM s""",
)
def unified_feature_dictionary(spark, d):
    df = doc(spark, d)
    cards, missing = profile.cardinality_report(df), quality.missing_report(df)
    return _round(profile.feature_dictionary(cards, missing, profile.profile_advice(cards, missing, ["lang", "source"])))


_LINE_ROWS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(
    "duplicate_audit",
    f"""WITH t AS (SELECT count(*) AS n FROM lineitem), f AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM lineitem)),
        i AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem),
        p AS (SELECT count(*) AS n FROM (SELECT DISTINCT {_LINE_ROWS.replace('l_orderkey, ', '')} FROM lineitem))
        SELECT 'full_row' AS kind, t.n - f.n AS duplicates, t.n AS n_rows, round(100.0 * (t.n - f.n) / t.n, 6) AS pct FROM t, f UNION ALL
        SELECT 'id', t.n - i.n, t.n, round(100.0 * (t.n - i.n) / t.n, 6) FROM t, i UNION ALL
        SELECT 'payload', t.n - p.n, t.n, round(100.0 * (t.n - p.n) / t.n, 6) FROM t, p""",
)
def duplicate_audit(spark, d):
    return _round(quality.duplicate_audit(table(spark, d, "lineitem"), "l_orderkey"))


@query("identical_columns", "SELECT 'amt' AS left_column, 'amt_copy' AS right_column UNION ALL SELECT 'gap', 'gap_copy'")
def identical_columns(spark, d):
    gap = F.when(F.col("y") == 1, F.col("dt"))
    df = txn(spark, d).withColumns({"amt_copy": F.col("amt"), "gap": gap, "gap_copy": gap})
    return quality.identical_columns(df, ["id", "amt", "dt", "amt_copy", "gap", "gap_copy"])


_CONST_SQL = f"(SELECT id, 'x' AS flat, CASE WHEN id % 500 = 0 THEN 'b' ELSE 'a' END AS nearly, product FROM {TXN_SQL})"
_DOMINANCE = f"""(SELECT feature, any_value(total) AS n_rows, 0::BIGINT AS missing, count(*) AS n_unique, arg_min(value, (-n, value)) AS dominant_value,
    max(n) / any_value(total)::DOUBLE AS ratio FROM (SELECT feature, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature)::BIGINT AS total
    FROM {long_sql(_CONST_SQL, ['id', 'flat', 'nearly', 'product'])} GROUP BY 1, 2) GROUP BY 1)"""


def _const(spark, d):
    nearly = F.when(F.col("id") % 500 == 0, "b").otherwise("a")
    return txn(spark, d).select("id", F.lit("x").alias("flat"), nearly.alias("nearly"), "product")


@query("constant_columns", f"SELECT feature, n_rows, missing, n_unique, dominant_value, round(ratio, 6) AS dominant_ratio FROM {_DOMINANCE} WHERE n_unique <= 1")
def constant_columns(spark, d):
    return _round(quality.constant_columns(quality.dominance_report(_const(spark, d))))


@query(
    "near_constant_columns",
    f"SELECT feature, n_rows, missing, n_unique, dominant_value, round(ratio, 6) AS dominant_ratio FROM {_DOMINANCE} WHERE n_unique > 1 AND ratio >= 0.99",
)
def near_constant_columns(spark, d):
    return _round(quality.near_constant_columns(quality.dominance_report(_const(spark, d)), 0.99))


@query(
    "invalid_values",
    """SELECT 'c_acctbal' AS feature, count(*) FILTER (WHERE c_acctbal < 0) AS n_invalid FROM customer UNION ALL
        SELECT 'c_custkey', count(*) FILTER (WHERE c_custkey < 0) FROM customer UNION ALL
        SELECT 'segment', count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') FROM customer""",
)
def invalid_values(spark, d):
    fake = F.when(F.col("c_mktsegment") == "MACHINERY", " NaN ").otherwise(F.col("c_mktsegment"))
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", fake.alias("segment"))
    return quality.invalid_values(df, ["c_acctbal", "c_custkey"])


@query(
    "infinite_values",
    f"SELECT 'ratio' AS feature, count(*) FILTER (WHERE disc = 0) AS n_infinite FROM {LINE_SQL} UNION ALL SELECT 'price', 0 FROM (SELECT 1)",
)
def infinite_values(spark, d):
    ratio = F.when(F.col("disc") == 0, F.lit(float("-inf"))).otherwise(F.col("price"))
    df = line(spark, d).select("price", ratio.alias("ratio"))
    return quality.infinite_report(df).select("feature", F.col("n_infinite").cast("long").alias("n_infinite"))


_OUT_LONG = long_sql(LINE_SQL, ["qty", "price", "disc", "tax"], "DOUBLE")


@query(
    "outlier_report",
    f"""WITH l AS {_OUT_LONG}, s AS (SELECT feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(value, 0.01) AS p1,
        quantile_cont(value, 0.99) AS p99, avg(value) AS m, stddev_samp(value) AS sd FROM l GROUP BY 1),
        o AS (SELECT feature, count(*) AS n, count(*) FILTER (WHERE value < a - 1.5*(b-a) OR value > b + 1.5*(b-a)) AS iqr_outliers,
        count(*) FILTER (WHERE abs((value - m) / sd) > 3) AS z_outliers, count(*) FILTER (WHERE value < p1 OR value > p99) AS pct_outliers
        FROM l JOIN s USING (feature) GROUP BY 1)
        SELECT *, round(100.0 * iqr_outliers / n, 6) AS iqr_outliers_share, round(100.0 * z_outliers / n, 6) AS z_outliers_share,
        round(100.0 * pct_outliers / n, 6) AS pct_outliers_share FROM o""",
)
def outlier_report(spark, d):
    return _round(quality.outlier_report(line(spark, d), ["qty", "price", "disc", "tax"]))


@query(
    "sigma_and_bounds_gate",
    f"""WITH l AS {_OUT_LONG}, s AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS sd FROM l GROUP BY 1)
        SELECT feature, count(*) FILTER (WHERE abs(value - m) > 1.7 * sd) AS n_sigma,
        count(*) FILTER (WHERE feature = 'qty' AND NOT value BETWEEN 2 AND 40) AS n_out_of_bounds, min(value) = max(value) AS is_constant
        FROM l JOIN s USING (feature) GROUP BY 1""",
)
def sigma_and_bounds_gate(spark, d):
    return quality.sigma_gate(line(spark, d), ["qty", "price", "disc", "tax"], 1.7, {"qty": (2, 40)})


@query(
    "missing_gate",
    f"""SELECT feature, round(missing_pct / 100, 6) AS ratio, CAST(0 AS BIGINT) AS n_infinite,
        CASE WHEN missing_pct / 100 > 0.5 THEN 'FAIL' ELSE 'PASS' END AS status FROM {_MISSING}""",
)
def missing_gate(spark, d):
    return _round(quality.missing_gate(doc(spark, d), 0.5))


@query(
    "feature_gate",
    f"""SELECT feature, count(*) - count(value) AS n_null, CAST(0 AS BIGINT) AS n_infinite, count(DISTINCT value) <= 1 AS is_constant,
        CASE WHEN count(*) > count(value) THEN 'WARN' ELSE 'PASS' END AS status FROM {_DOC_LONG} GROUP BY 1""",
)
def feature_gate(spark, d):
    return quality.feature_gate(doc(spark, d))


@query(
    "train_test_consistency",
    f"""SELECT CAST(0 AS BIGINT) AS train_duplicate_ids, (SELECT count(*) FROM {TRAIN_SQL}) AS train_rows, CAST(0 AS BIGINT) AS test_duplicate_ids,
        (SELECT count(*) FROM {TEST_SQL}) AS test_rows, 1 AS only_in_train, 0 AS only_in_test, 1 AS type_mismatches""",
)
def train_test_consistency(spark, d):
    test = txn(spark, d, "test").drop("key").withColumn("dt", F.col("dt").cast("string"))
    return quality.consistency_report(txn(spark, d, "train"), test, "id", "y")


_METRICS_SQL = f"""(SELECT (SELECT avg(missing_pct) FROM {_MISSING}) AS missing_pct,
    (SELECT 100.0 * (count(*) - count(DISTINCT (source, lang))) / count(*) / 20 FROM {DOC_SQL}) AS duplicate_pct,
    (SELECT count(*) FROM {DOC_SQL} WHERE n_chars < 20) / 10.0 AS invalid_count, 2.0 AS constant_pct, 1.0 AS near_constant_pct, 3.0 AS outlier_pct, 1.0 AS schema_problems)"""


@query(
    "quality_score",
    f"""WITH s AS (SELECT greatest(0, 100 - missing_pct * 2)::DOUBLE AS missing_pct_score, greatest(0, 100 - duplicate_pct * 5)::DOUBLE AS duplicate_pct_score,
        greatest(0, 100 - invalid_count * 10)::DOUBLE AS invalid_count_score, greatest(0, 100 - constant_pct * 5)::DOUBLE AS constant_pct_score,
        greatest(0, 100 - near_constant_pct * 3)::DOUBLE AS near_constant_pct_score, greatest(0, 100 - outlier_pct)::DOUBLE AS outlier_pct_score,
        greatest(0, 100 - schema_problems * 10)::DOUBLE AS schema_problems_score FROM {_METRICS_SQL}),
        t AS (SELECT *, missing_pct_score * .25 + duplicate_pct_score * .15 + invalid_count_score * .2 + constant_pct_score * .1
        + near_constant_pct_score * .1 + outlier_pct_score * .1 + schema_problems_score * .1 AS score FROM s)
        SELECT round(missing_pct_score, 6) AS missing_pct_score, round(duplicate_pct_score, 6) AS duplicate_pct_score, round(invalid_count_score, 6) AS invalid_count_score,
        constant_pct_score, near_constant_pct_score, outlier_pct_score, schema_problems_score, round(score, 6) AS score,
        CASE WHEN score < 60 THEN 'Critical' WHEN score < 70 THEN 'Poor' WHEN score < 80 THEN 'Acceptable' WHEN score < 90 THEN 'Good' ELSE 'Excellent' END AS rating FROM t""",
)
def quality_score(spark, d):
    df = doc(spark, d)
    dup = quality.duplicate_rows(df, ["source", "lang"]).select((F.col("duplicates") * 100.0 / F.col("n_rows") / 20).alias("duplicate_pct"))
    metrics = (
        quality.missing_report(df).agg(F.avg("missing_pct").alias("missing_pct")).transform(with_row, dup)
        .transform(with_row, df.agg((F.sum((F.col("n_chars") < 20).cast("long")) / 10.0).alias("invalid_count")))
        .withColumns({"constant_pct": F.lit(2.0), "near_constant_pct": F.lit(1.0), "outlier_pct": F.lit(3.0), "schema_problems": F.lit(1.0)})
    )
    return _round(quality.quality_score(metrics))


@query("quality_run", f"SELECT id, amt, dt, product FROM {TXN_SQL}")
def quality_run(spark, d):
    df = txn(spark, d).select(
        "id", "amt", "dt", "product", F.col("amt").alias("amt_again"), F.lit(7).alias("seven"),
        (F.col("id") == 3).cast("int").alias("almost"),
    )
    return quality.quality_run(df, "id")[0]


@query(
    "contract_check",
    f"""SELECT feature, round(missing_pct / 100, 6) AS null_ratio, CASE WHEN missing_pct > 50 THEN 'TOO MANY NULLS' ELSE 'OK' END AS status
        FROM {_MISSING} WHERE feature IN ('doc_id', 'quality') UNION ALL SELECT 'absent', 1.0, 'ABSENT'""",
)
def contract_check(spark, d):
    return _round(quality.contract_check(doc(spark, d), ["doc_id", "quality", "absent"]))


@query(
    "feature_health",
    f"""SELECT feature, round(missing_pct / 100, 6) AS null_rate, round(max(missing_pct) OVER () / 100, 6) AS max_null_rate, missing_pct / 100 > 0.1 AS is_unhealthy
        FROM {_MISSING} WHERE feature IN ('lang', 'quality', 'toxic')""",
)
def feature_health(spark, d):
    return _round(quality.feature_health(doc(spark, d), ["lang", "quality", "toxic"], 0.1))


@query(
    "transformation_advice",
    f"""WITH s AS (SELECT feature, min(value) AS low, skewness(value) AS skew, kurtosis(value) AS kurt FROM
        {long_sql(f"(SELECT qty, price, exp(qty / 8.0) AS grown, -exp(qty / 8.0) AS sunk FROM {LINE_SQL})", ['qty', 'price', 'grown', 'sunk'], 'DOUBLE')} GROUP BY 1)
        SELECT feature, round(skew, 4) AS skew, round(kurt, 4) AS kurt,
        CASE WHEN skew < -1 THEN 'Highly Left-Skewed' WHEN skew < -0.5 THEN 'Moderately Left-Skewed' WHEN skew <= 0.5 THEN 'Approximately Symmetric'
        WHEN skew <= 1 THEN 'Moderately Right-Skewed' ELSE 'Highly Right-Skewed' END AS skew_type,
        CASE WHEN kurt < -0.5 THEN 'Light-Tailed' WHEN kurt <= 0.5 THEN 'Normal' ELSE 'Heavy-Tailed' END AS kurt_type,
        CASE WHEN skew > 1 AND low >= 0 THEN 'Log Transformation (log1p)' WHEN skew > 1 THEN 'Yeo-Johnson' WHEN skew < -1 THEN 'Quantile Transformation'
        WHEN kurt > 0.5 THEN 'Robust Scaler (IQR-based)' ELSE 'No Transformation' END AS advice FROM s""",
)
def transformation_advice(spark, d):
    df = line(spark, d).select("qty", "price", F.exp(F.col("qty") / 8.0).alias("grown"), (-F.exp(F.col("qty") / 8.0)).alias("sunk"))
    return _round(profile.transformation_advice(profile.numeric_statistics(df, df.columns)), 4)


@query(
    "distribution_shape",
    f"""WITH s AS (SELECT feature, count(DISTINCT value) AS n_unique, skewness(value) AS skew FROM {_LINE_LONG} GROUP BY 1)
        SELECT feature, round(skew, 4) AS skew, n_unique, CASE WHEN n_unique <= 1 THEN 'Near-Constant' WHEN abs(skew) > 2 THEN 'Highly Skewed'
        WHEN abs(skew) > 0.5 THEN 'Moderately Skewed' ELSE 'Symmetric' END AS shape FROM s""",
)
def distribution_shape(spark, d):
    return _round(profile.distribution_shape(profile.numeric_statistics(line(spark, d), LINE_FEATURES)), 4)


@query(
    "encoding_choice",
    f"""SELECT feature, count(*) AS n_unique, CASE WHEN count(*) <= 2 THEN 'Label' WHEN count(*) <= 10 THEN 'OneHot' WHEN count(*) < 50 THEN 'Frequency' ELSE 'Target' END AS strategy
        FROM {_CAT_COUNTS} GROUP BY 1""",
)
def encoding_choice(spark, d):
    return profile.encoding_choice(_txn_band(spark, d), [*_TXN_TEXTS, "key"])


@query(
    "test_candidates",
    f"""SELECT feature, n_unique, 'numeric' AS kind FROM (SELECT feature, var_samp(value) AS v, count(DISTINCT value) AS n_unique FROM {_LINE_LONG} GROUP BY 1 ORDER BY v DESC LIMIT 3)
        UNION ALL SELECT feature, count(*) AS n_unique, 'categorical' FROM {_CAT_COUNTS} WHERE feature <> 'key' GROUP BY 1 HAVING count(*) BETWEEN 2 AND 29""",
)
def test_candidates(spark, d):
    numeric = profile.candidate_columns(profile.numeric_statistics(line(spark, d), LINE_FEATURES), 3)
    cards = profile.cardinality_report(_txn_band(spark, d), _TXN_TEXTS)
    texts = profile.candidate_categoricals(cards, _TXN_TEXTS)
    return numeric.select("feature", "n_unique", F.lit("numeric").alias("kind")).unionByName(
        texts.withColumn("kind", F.lit("categorical"))
    )
