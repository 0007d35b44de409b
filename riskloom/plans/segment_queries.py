"""Label rates per segment, and time-bucket analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import binning, text
from riskloom.operators import segments, temporal
from riskloom.plans.profile_queries import _CAT_COUNTS, _CAT_STATS, _TXN_BAND, _TXN_TEXTS, _round, _txn_band, long_sql
from riskloom.plans.registry import query
from riskloom.plans.views import (
    DOC_SQL, EV_SQL, LINE_SQL, TEST_SQL, TRAIN_SQL, TXN_SQL, doc, ev, line, rounded, table, txn,
)


def rates_sql(source: str, keys: str, amount: str = "", extra: str = "") -> str:
    """Segment rates of a view as SQL."""
    mean = f", round(avg({amount}), 4) AS mean_amount" if amount else ""
    return f"""SELECT {keys}, count(y) AS total, sum(y)::BIGINT AS positives{mean}, round(100.0 * avg(y), 6) AS rate_pct,
        round(100.0 * count(y) / (SELECT count(*) FROM {source}), 6) AS share_pct,
        round(avg(y) / (SELECT avg(y) FROM {source}), 6) AS relative_risk{extra} FROM {source}"""


@query("product_rates", rates_sql(TXN_SQL, "product", "amt") + " GROUP BY product")
def product_rates(spark, d):
    return _round(segments.segment_rates(txn(spark, d), ["product"], "y", "amt"), mean_amount=4)


@query(
    "rates_by_category",
    f"""WITH l AS {long_sql(_TXN_BAND, _TXN_TEXTS, keep='y')}, g AS (SELECT avg(y) AS rate, sum(y) AS pos, count(*) AS n FROM {TXN_SQL}),
        r AS (SELECT feature, value, count(y) AS total, sum(y)::BIGINT AS positives, 100.0 * avg(y) AS rp FROM l GROUP BY 1, 2)
        SELECT feature, value, total, positives, round(rp, 6) AS rate_pct, round(100.0 * total / n, 6) AS share_pct, round(rp / (rate * 100), 6) AS relative_risk,
        round(100 - rp, 6) AS legit_pct, round(rp / nullif(100 - rp, 0), 6) AS odds, round(100.0 * positives / pos, 6) AS share_of_positives_pct FROM r, g""",
)
def rates_by_category(spark, d):
    return _round(segments.rates_by_feature(_txn_band(spark, d), _TXN_TEXTS, "y"))


@query(
    "class_distribution",
    f"""SELECT coalesce(CAST(quality AS VARCHAR), 'missing') AS label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM {DOC_SQL}), 6) AS pct
        FROM {DOC_SQL} GROUP BY 1""",
)
def class_distribution(spark, d):
    return _round(segments.class_distribution(doc(spark, d), "quality"))


@query(
    "class_imbalance",
    f"""SELECT sum(1 - y)::BIGINT AS negatives, sum(y)::BIGINT AS positives, round(100.0 * avg(1 - y), 6) AS majority_pct, round(100.0 * avg(y), 6) AS minority_pct,
        round(sum(1 - y) / sum(y), 6) AS ratio, CASE WHEN sum(1 - y) / sum(y) < 5 THEN 'Low' WHEN sum(1 - y) / sum(y) <= 20 THEN 'Moderate' ELSE 'Severe' END AS severity FROM {TXN_SQL}""",
)
def class_imbalance(spark, d):
    return _round(segments.class_imbalance(txn(spark, d), "y"))


@query(
    "rates_over_time",
    " UNION ALL ".join(
        f"SELECT '{k}' AS kind, {e} AS bucket, count(y) AS total, sum(y)::BIGINT AS positives, round(100.0 * avg(y), 6) AS rate_pct FROM {EV_SQL} GROUP BY 2"
        for k, e in (("hour", "(dt // 3600) % 24"), ("day", "dt // 86400"), ("week", "dt // 604800"))
    ),
)
def rates_over_time(spark, d):
    return _round(temporal.rates_over_time(ev(spark, d), "dt", "y"))


_LABELLED = f"(SELECT *, CAST(n_chars > 1000 AS INTEGER) AS y FROM {DOC_SQL})"


def _labelled(spark, d):
    return doc(spark, d).withColumn("y", (F.col("n_chars") > 1000).cast("int"))


_MVT = f"""(SELECT feature, count(*) FILTER (WHERE value IS NULL) AS missing_count, coalesce(sum(y) FILTER (WHERE value IS NULL), 0)::BIGINT AS missing_positives,
    count(value) AS available_count, coalesce(sum(y) FILTER (WHERE value IS NOT NULL), 0)::BIGINT AS available_positives,
    coalesce(100.0 * avg(y) FILTER (WHERE value IS NULL), 0) AS a, coalesce(100.0 * avg(y) FILTER (WHERE value IS NOT NULL), 0) AS b
    FROM {long_sql(_LABELLED, ['lang', 'source', 'quality', 'toxic'], keep='y')} GROUP BY 1)"""


@query(
    "missing_vs_target",
    f"""SELECT feature, missing_count, missing_positives, available_count, available_positives, round(a, 6) AS missing_rate, round(b, 6) AS available_rate,
        round(a - b, 6) AS difference, round(CASE WHEN b > 0 THEN a / b WHEN a = 0 THEN 1.0 END, 6) AS relative_risk FROM {_MVT}""",
)
def missing_vs_target(spark, d):
    return _round(segments.missing_vs_target(_labelled(spark, d), ["lang", "source", "quality", "toxic"], "y"))


@query(
    "identity_rates",
    f"""WITH c AS (SELECT feature, value, count(*) AS n, sum(y) AS p FROM {long_sql(_LABELLED, ['lang', 'source', 'quality'], keep='y')} WHERE value IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, 100.0 * p / n AS rate FROM c),
        t AS (SELECT feature, arg_min(value, (-rate, value)) AS riskiest_category, round(max(rate), 6) AS riskiest_rate FROM r GROUP BY 1),
        k AS (SELECT feature, count(*) AS cardinality FROM c GROUP BY 1)
        SELECT feature, missing_count, round(a, 6) AS missing_rate, available_count, round(b, 6) AS available_rate, cardinality, riskiest_category, riskiest_rate
        FROM {_MVT} JOIN k USING (feature) JOIN t USING (feature)""",
)
def identity_rates(spark, d):
    return _round(segments.identity_rates(_labelled(spark, d), ["lang", "source", "quality"], "y"))


@query(
    "rates_by_amount_band",
    f"""WITH q AS (SELECT quantile_cont(amt, [0.1, 0.3, 0.7, 0.9, 1.0]) AS e FROM {TXN_SQL}),
        b AS (SELECT y, e, CASE WHEN amt <= e[1] THEN 1 WHEN amt <= e[2] THEN 2 WHEN amt <= e[3] THEN 3 WHEN amt <= e[4] THEN 4 ELSE 5 END AS i FROM {TXN_SQL}, q)
        SELECT ['Very Low', 'Low', 'Medium', 'High', 'Very High'][i] AS band, count(y) AS total, sum(y)::BIGINT AS positives, round(100.0 * avg(y), 6) AS rate_pct,
        round(CASE WHEN i = 1 THEN 0 ELSE any_value(e)[i - 1] END, 4) AS low, round(any_value(e)[i], 4) AS high FROM b GROUP BY i""",
)
def rates_by_amount_band(spark, d):
    return _round(segments.rates_by_amount(txn(spark, d), "amt", "y"), low=4, high=4)


@query(
    "class_conditional_statistics",
    f"""SELECT feature, y AS label, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS low, max(value) AS high,
        round(quantile_cont(value, 0.25), 4) AS p25, round(median(value), 4) AS median, round(quantile_cont(value, 0.75), 4) AS p75
        FROM {long_sql(LINE_SQL, ['qty', 'price', 'disc', 'tax'], 'DOUBLE', 'y')} GROUP BY 1, 2""",
)
def class_conditional_statistics(spark, d):
    return _round(segments.class_conditional_statistics(line(spark, d), ["qty", "price", "disc", "tax"], "y"), 4)


_EVB = f"""(SELECT *, CASE WHEN amt <= 20 THEN 'Very Low' WHEN amt <= 100 THEN 'Low' WHEN amt <= 500 THEN 'Medium' WHEN amt <= 2000 THEN 'High'
    ELSE 'Very High' END AS band, (dt // 3600) % 24 AS hour, key % 7 AS region FROM {EV_SQL})"""


def _evb(spark, d):
    df = ev(spark, d)
    return df.withColumns({
        "band": binning.amount_bin("amt"), "hour": F.pmod(F.floor(F.col("dt") / 3600), F.lit(24)), "region": F.col("key") % 7,
    })


@query("amount_band_rates", rates_sql(_EVB, "band", "amt") + " GROUP BY band")
def amount_band_rates(spark, d):
    return _round(segments.segment_rates(_evb(spark, d), ["band"], "y", "amt"), mean_amount=4)


@query(
    "key_feature_risk",
    f"""WITH l AS {long_sql(_EVB, ['band', 'region', 'hour'], keep='y')}, c AS (SELECT feature, value, count(*) AS n, 100.0 * avg(y) AS rate FROM l GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY rate DESC, n DESC, value) AS r FROM c)
        SELECT feature, count(*) AS n_unique, CAST(0 AS DOUBLE) AS missing_pct, arg_min(value, (-n, value)) AS dominant_value, round(100.0 * max(n) / sum(n), 6) AS dominant_pct,
        max(value) FILTER (WHERE r = 1) AS riskiest_value, round(max(rate), 6) AS riskiest_rate, round(max(rate) / (SELECT 100 * avg(y) FROM {_EVB}), 6) AS relative_risk,
        string_agg(printf('%s(%.1f%%)', value, rate), ', ' ORDER BY r) FILTER (WHERE r <= 5) AS riskiest_values FROM r GROUP BY 1""",
)
def key_feature_risk(spark, d):
    return _round(segments.key_features(_evb(spark, d), ["band", "region", "hour"], "y"))


@query(
    "rates_by_quartile",
    f"""WITH l AS {long_sql(LINE_SQL, ['price', 'qty'], 'DOUBLE', 'y')}, q AS (SELECT feature, quantile_cont(value, 0.25) AS a, median(value) AS b, quantile_cont(value, 0.75) AS c,
        avg(value) AS mean, stddev_samp(value) AS std FROM l GROUP BY 1)
        SELECT feature, CASE WHEN value <= a THEN 'Q1' WHEN value <= b THEN 'Q2' WHEN value <= c THEN 'Q3' ELSE 'Q4' END AS bin, count(y) AS total, sum(y)::BIGINT AS positives,
        round(100.0 * avg(y), 6) AS rate_pct, round(any_value(mean), 4) AS mean, round(any_value(b), 4) AS median, round(any_value(std), 4) AS std FROM l JOIN q USING (feature) GROUP BY 1, 2""",
)
def rates_by_quartile(spark, d):
    return _round(segments.rates_by_quartile(line(spark, d), ["price", "qty"], "y"), mean=4, median=4, std=4)


@query(
    "rates_by_hour",
    f"""WITH h AS (SELECT unnest(range(24)) AS hour), r AS (SELECT hour, count(y) AS total, sum(y)::BIGINT AS positives, avg(amt) AS m FROM {_EVB} GROUP BY 1),
        g AS (SELECT avg(y) AS rate, count(*) AS n FROM {_EVB})
        SELECT h.hour, coalesce(total, 0) AS total, coalesce(positives, 0) AS positives, round(coalesce(m, 0), 4) AS mean_amount,
        round(coalesce(100.0 * positives / total, 0), 6) AS rate_pct, round(100.0 * coalesce(total, 0) / n, 6) AS share_pct,
        round(coalesce(1.0 * positives / total, 0) / rate, 6) AS relative_risk FROM h LEFT JOIN r USING (hour), g""",
)
def rates_by_hour(spark, d):
    return _round(segments.rates_by_hour(_evb(spark, d), "dt", "y", "amt"), mean_amount=4)


_PAIRS = {"band_region": ["band", "region"], "region_hour": ["region", "hour"], "band_hour": ["band", "hour"]}


@query(
    "two_way_segment_rates",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS grouping, {', '.join(c if c in cols else f'CAST(NULL AS {t}) AS {c}' for c, t in (('band', 'VARCHAR'), ('region', 'BIGINT'), ('hour', 'BIGINT')))},
        count(y) AS total, sum(y)::BIGINT AS positives, round(avg(amt), 4) AS mean_amount, round(100.0 * avg(y), 6) AS rate_pct,
        round(100.0 * count(y) / (SELECT count(*) FROM {_EVB}), 6) AS share_pct, round(avg(y) / (SELECT avg(y) FROM {_EVB}), 6) AS relative_risk
        FROM {_EVB} GROUP BY {', '.join(cols)}"""
        for name, cols in _PAIRS.items()
    ),
)
def two_way_segment_rates(spark, d):
    return _round(segments.rates_by_sets(_evb(spark, d), _PAIRS, "y", "amt"), mean_amount=4)


@query(
    "segment_risk_profiles",
    f"""SELECT band, region, hour, count(y) AS total, sum(y)::BIGINT AS positives, round(100.0 * avg(y), 6) AS rate_pct,
        round(100.0 * count(y) / (SELECT count(*) FROM {_EVB}), 6) AS share_pct, round(avg(y) / (SELECT avg(y) FROM {_EVB}), 6) AS relative_risk,
        CASE WHEN 100.0 * avg(y) <= 1 THEN 'Low' WHEN 100.0 * avg(y) <= 5 THEN 'Moderate' WHEN 100.0 * avg(y) <= 15 THEN 'High' ELSE 'Critical' END AS risk
        FROM {_EVB} GROUP BY 1, 2, 3 ORDER BY total DESC, band, region, hour LIMIT 100""",
)
def segment_risk_profiles(spark, d):
    return _round(segments.risk_profiles(_evb(spark, d), ["band", "region", "hour"], "y"))


_DEVICE = """(SELECT CASE WHEN quality = 1 THEN 'mobile' WHEN quality = 0 THEN 'desktop' ELSE 'Missing' END AS device, y,
    CASE WHEN contains(v, 'chrome') THEN 'Chrome' WHEN contains(v, 'safari') THEN 'Safari' WHEN contains(v, 'ie') OR contains(v, 'trident') THEN 'IE'
    WHEN contains(v, 'firefox') THEN 'Firefox' WHEN contains(v, 'edge') THEN 'Edge' WHEN contains(v, 'opera') THEN 'Opera' ELSE 'Other' END AS browser,
    CASE WHEN contains(v, 'windows') THEN 'Windows' WHEN contains(v, 'mac') THEN 'macOS' WHEN contains(v, 'ios') OR contains(v, 'ipad') OR contains(v, 'iphone') THEN 'iOS'
    WHEN contains(v, 'android') THEN 'Android' WHEN contains(v, 'linux') THEN 'Linux' ELSE 'Other' END AS os
    FROM (SELECT lower(text) AS v, CAST(n_chars > 1000 AS INTEGER) AS y, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))"""


def _device(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    kind = F.when(F.col("quality") == 1, "mobile").when(F.col("quality") == 0, "desktop").otherwise("Missing")
    return docs.select(
        kind.alias("device"), text.browser_family("text").alias("browser"), text.os_family("text").alias("os"),
        (F.col("n_chars") > 1000).cast("int").alias("y"),
    )


_DEV_SETS = {"device": ["device"], "browser": ["browser"], "os": ["os"], "device_browser": ["device", "browser"], "device_os": ["device", "os"], "browser_os": ["browser", "os"]}


@query(
    "device_browser_os_rates",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS grouping, {', '.join(c if c in cols else f'CAST(NULL AS VARCHAR) AS {c}' for c in ('device', 'browser', 'os'))},
        count(y) AS total, sum(y)::BIGINT AS positives, round(100.0 * avg(y), 6) AS rate_pct,
        round(100.0 * count(y) / (SELECT count(*) FROM {_DEVICE}), 6) AS share_pct, round(avg(y) / (SELECT avg(y) FROM {_DEVICE}), 6) AS relative_risk
        FROM {_DEVICE} GROUP BY {', '.join(cols)}"""
        for name, cols in _DEV_SETS.items()
    ),
)
def device_browser_os_rates(spark, d):
    return _round(segments.rates_by_sets(_device(spark, d), _DEV_SETS, "y"))


@query(
    "identity_risk_profiles",
    rates_sql(_DEVICE, "device, browser, os", extra=", CASE WHEN 100.0 * avg(y) <= 1 THEN 'Low' WHEN 100.0 * avg(y) <= 5 THEN 'Moderate' WHEN 100.0 * avg(y) <= 15 THEN 'High' ELSE 'Critical' END AS risk")
    + " GROUP BY device, browser, os ORDER BY total DESC, device, browser, os LIMIT 100",
)
def identity_risk_profiles(spark, d):
    return _round(segments.risk_profiles(_device(spark, d), ["device", "browser", "os"], "y", 100))


_AVAIL = f"(SELECT CASE WHEN quality IS NULL THEN 'None' ELSE 'High' END AS availability, y FROM {_LABELLED})"


@query("identity_availability", rates_sql(_AVAIL, "availability") + " GROUP BY availability")
def identity_availability(spark, d):
    return _round(segments.availability_bands(_labelled(spark, d), ["quality", "toxic"], "y"))


@query(
    "category_quartile_hotspots",
    f"""WITH q AS (SELECT quantile_cont(amt, [0.25, 0.5, 0.75]) AS a, quantile_cont(dt, [0.25, 0.5, 0.75]) AS t FROM {TXN_SQL}),
        c AS (SELECT 'amt' AS feature, product AS category, y, CASE WHEN amt <= a[1] THEN 'Q1' WHEN amt <= a[2] THEN 'Q2' WHEN amt <= a[3] THEN 'Q3' ELSE 'Q4' END AS bin FROM {TXN_SQL}, q
        UNION ALL SELECT 'dt', product, y, CASE WHEN dt <= t[1] THEN 'Q1' WHEN dt <= t[2] THEN 'Q2' WHEN dt <= t[3] THEN 'Q3' ELSE 'Q4' END FROM {TXN_SQL}, q),
        g AS (SELECT feature, category, bin, count(*) AS n, avg(y) AS rate FROM c GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY rate DESC, category, bin) AS r FROM g)
        SELECT feature, category, bin, n, round(rate, 6) AS rate, round(rate / (SELECT avg(y) FROM {TXN_SQL}), 6) AS relative_risk FROM r WHERE r = 1""",
)
def category_quartile_hotspots(spark, d):
    return _round(segments.hotspots(txn(spark, d), "product", ["amt", "dt"], "y"))


@query(
    "encoding_advice",
    f"""WITH rare AS (SELECT feature, count(*) FILTER (WHERE n < total * 0.01) AS n_rare FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS total FROM {_CAT_COUNTS}) GROUP BY 1),
        risk AS (SELECT feature, max(rate) / (SELECT avg(y) FROM {TXN_SQL}) > 3 AS is_risky FROM (SELECT feature, value, avg(y) AS rate FROM {long_sql(_TXN_BAND, [*_TXN_TEXTS, 'key'], keep='y')} GROUP BY 1, 2) GROUP BY 1),
        s AS (SELECT feature, n_categories AS k, entropy_nats / ln(n_categories) AS diversity FROM {_CAT_STATS})
        SELECT feature, CASE WHEN k <= 2 THEN 'Binary' WHEN k <= 10 THEN 'Low' WHEN k <= 100 THEN 'Medium' WHEN k <= 1000 THEN 'High' ELSE 'Very High' END AS cardinality, n_rare,
        round(diversity, 6) AS diversity, is_risky, CASE WHEN k <= 2 THEN 'Label Encoding (Binary)' WHEN k <= 10 AND is_risky THEN 'Target Encoding'
        WHEN k <= 100 AND n_rare = 0 THEN 'One-Hot Encoding' WHEN k <= 100 THEN 'One-Hot Encoding with Rare Grouping' WHEN k <= 1000 THEN 'Frequency Encoding'
        ELSE 'Target Encoding / Hashing' END || CASE WHEN diversity < 0.1 THEN ' + Near-Constant Flag' ELSE '' END AS encoding FROM s JOIN rare USING (feature) JOIN risk USING (feature)""",
)
def encoding_advice(spark, d):
    return _round(segments.encoding_advice(_txn_band(spark, d), [*_TXN_TEXTS, "key"], "y"))


# --- time --------------------------------------------------------------------------

_BUCKETS = {"hour": "(dt // 3600) % 24", "day": "dt // 86400", "week": "dt // 604800", "month": "dt // 2592000"}


def _bucket_sql(bucket: str, source: str) -> str:
    e = _BUCKETS[bucket]
    return f"""SELECT {e} AS {bucket}, count(y) AS total, sum(y)::BIGINT AS positives, round(sum(amt), 2) AS amount, round(avg(amt), 6) AS mean_amount,
        round(100.0 * avg(y), 6) AS rate_pct, round(100.0 * count(y) / (SELECT count(*) FROM {source}), 6) AS share_pct,
        round(avg(y) / (SELECT avg(y) FROM {source}), 6) AS relative_risk FROM {source} GROUP BY 1"""


def _register_bucket(bucket: str, name: str, source: str, view) -> None:
    growing = bucket in ("week", "month")
    sql = _bucket_sql(bucket, source)
    if growing:
        sql = f"SELECT *, round(CAST(total AS DOUBLE) / lag(total) OVER (ORDER BY {bucket}) - 1, 6) AS total_growth FROM ({sql})"

    @query(name, sql)
    def run(spark, d):
        out = temporal.bucket_rates(view(spark, d), bucket, "dt", "y", "amt")
        if growing:
            out = temporal.with_growth(out, bucket, "total")
        return _round(out, amount=2)


_register_bucket("hour", "hourly_analysis", EV_SQL, ev)
_register_bucket("day", "daily_analysis", EV_SQL, ev)
_register_bucket("week", "weekly_analysis", TXN_SQL, txn)
_register_bucket("month", "monthly_analysis", TXN_SQL, txn)


@query(
    "label_trends",
    f"""WITH t AS (SELECT dt // 86400 AS day, count(y) AS total, sum(y)::BIGINT AS positives, 100.0 * avg(y) AS rate FROM {EV_SQL} GROUP BY 1),
        w AS (SELECT *, avg(positives) OVER s AS rm, avg(rate) OVER s AS rr, coalesce(stddev_samp(positives) OVER s, 0) AS rs, positives / lag(positives) OVER (ORDER BY day)::DOUBLE - 1 AS g
        FROM t WINDOW s AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
        SELECT day, total, positives, round(rate, 6) AS rate_pct, round(rm, 6) AS rolling_positives, round(rr, 6) AS rolling_rate, round(rs, 6) AS rolling_std,
        round(g, 6) AS growth, CAST(positives - rm > 2 * rs AS INTEGER) AS is_spike FROM w""",
)
def label_trends(spark, d):
    return _round(temporal.trends(ev(spark, d), "dt", "y"))


@query(
    "temporal_anomalies",
    f"""WITH t AS (SELECT dt // 86400 AS day, count(*) AS total FROM {EV_SQL} GROUP BY 1),
        w AS (SELECT *, avg(total) OVER s AS rm, coalesce(stddev_samp(total) OVER s, 0) AS rs FROM t WINDOW s AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
        SELECT day, total, round(rm, 6) AS rolling_mean, round(rs, 6) AS rolling_std, round(CASE WHEN rs > 0 THEN (total - rm) / rs ELSE 0 END, 6) AS z,
        CAST(CASE WHEN rs > 0 THEN abs((total - rm) / rs) > 2.5 ELSE false END AS INTEGER) AS is_anomaly FROM w""",
)
def temporal_anomalies(spark, d):
    return _round(temporal.temporal_anomalies(ev(spark, d), "dt"))


@query(
    "seasonality",
    f"""WITH h AS (SELECT 'hour' AS dimension, unnest(range(24)) AS bucket, 24 AS k, 0.15 AS s UNION ALL SELECT 'dow', unnest(range(7)), 7, 0.05),
        c AS (SELECT 'hour' AS dimension, (dt // 3600) % 24 AS bucket, count(*) AS n FROM {EV_SQL} GROUP BY 2 UNION ALL SELECT 'dow', (dt // 86400) % 7, count(*) FROM {EV_SQL} GROUP BY 2),
        i AS (SELECT h.*, coalesce(n, 0) AS n, coalesce(n, 0) * k / (SELECT count(*) FROM {EV_SQL})::DOUBLE AS x FROM h LEFT JOIN c USING (dimension, bucket))
        SELECT dimension, bucket, n, round(x, 6) AS seasonal_index, CASE WHEN abs(x - 1) > s THEN 'Strong' ELSE 'Weak' END AS strength FROM i""",
)
def seasonality(spark, d):
    return _round(temporal.seasonality(ev(spark, d), "dt"))


@query(
    "time_span_summary",
    f"""SELECT min(dt) AS first, max(dt) AS last, count(*) AS n, max(dt) - min(dt) AS span_seconds, round((max(dt) - min(dt)) / 86400.0, 6) AS span_days,
        round(count(*) / ((max(dt) - min(dt)) / 86400.0), 6) AS per_day, round(count(*) / ((max(dt) - min(dt)) / 3600.0), 6) AS per_hour FROM {EV_SQL}""",
)
def time_span_summary(spark, d):
    return _round(temporal.span_summary(ev(spark, d), "dt"))


_EV_A = f"(SELECT * FROM {EV_SQL} WHERE dt < 20 * 86400)"
_EV_B = f"(SELECT * FROM {EV_SQL} WHERE dt >= 20 * 86400)"
_HOUR_DRIFT = f"""(WITH a AS (SELECT (dt // 3600) % 24 AS hour, count(*) / (SELECT count(*) FROM {_EV_A})::DOUBLE AS q FROM {_EV_A} GROUP BY 1),
    b AS (SELECT (dt // 3600) % 24 AS hour, count(*) / (SELECT count(*) FROM {_EV_B})::DOUBLE AS p FROM {_EV_B} GROUP BY 1),
    h AS (SELECT h.hour, coalesce(q, 0) AS q, coalesce(p, 0) AS p FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN a USING (hour) LEFT JOIN b USING (hour)),
    m AS (SELECT *, greatest(p, 1e-5) AS ps, greatest(q, 1e-5) AS qs, greatest((p + q) / 2, 1e-5) AS ms FROM h)
    SELECT hour, q, p, (p - q) * ln(ps / qs) AS psi, 0.5 * (p * ln(ps / ms) + q * ln(qs / ms)) AS jsd FROM m)"""


def _ev_pair(spark, d):
    df = ev(spark, d)
    return df.filter(F.col("dt") < 20 * 86400), df.filter(F.col("dt") >= 20 * 86400)


@query("hour_drift", f"SELECT hour, round(100 * q, 6) AS train_pct, round(100 * p, 6) AS test_pct, round(psi, 8) AS psi, round(jsd, 8) AS jsd FROM {_HOUR_DRIFT}")
def hour_drift(spark, d):
    return _round(temporal.hour_drift(*_ev_pair(spark, d), "dt"), psi=8, jsd=8)


@query(
    "hour_drift_summary",
    f"""SELECT round(sum(psi), 8) AS psi_total, round(sum(jsd), 8) AS jsd_total, CASE WHEN sum(psi) > 0.2 THEN 'Significant Drift'
        WHEN sum(psi) > 0.1 THEN 'Moderate Drift' ELSE 'Stable' END AS status FROM {_HOUR_DRIFT}""",
)
def hour_drift_summary(spark, d):
    return _round(temporal.hour_drift_summary(temporal.hour_drift(*_ev_pair(spark, d), "dt")), 8)


# --- row-level windows ---------------------------------------------------------------


@query(
    "prior_windows",
    f"""SELECT id, key, amt, round(coalesce(avg(amt) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS key_amt_prior_mean,
        count(amt) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS key_amt_prior_count,
        round(coalesce(avg(amt) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0), 6) AS key_amt_roll_mean FROM {TXN_SQL}""",
)
def prior_windows(spark, d):
    return _round(temporal.prior_windows(txn(spark, d).select("id", "key", "amt"), "key", ["id"], "amt"))


@query(
    "inter_arrival_gap",
    f"SELECT id, dt, CAST(coalesce(dt - lag(dt) OVER (ORDER BY dt, id), 60) AS DOUBLE) AS gap FROM {EV_SQL}",
)
def inter_arrival_gap(spark, d):
    return temporal.inter_arrival(ev(spark, d).select("dt", "id"), ["dt", "id"], "gap")


@query(
    "velocity_features",
    f"""SELECT id, key, dt, dt - lag(dt) OVER (PARTITION BY key ORDER BY dt, id) AS since_last,
        coalesce(count(*) OVER (PARTITION BY key ORDER BY dt RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING), 0) AS last_hour FROM {EV_SQL}""",
)
def velocity_features(spark, d):
    base = ev(spark, d).select("id", "key", "dt")
    out = temporal.time_since_last(base, "key", ["dt", "id"], "since_last")
    return temporal.recent_count(out, "key", "dt", 3600, "last_hour")
