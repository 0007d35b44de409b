"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import bands, binning, scalars, text
from riskloom.operators import aggregates, quality
from riskloom.operators.quantiles import exact_quantiles
from riskloom.plans.registry import query
from riskloom.plans.views import (
    DOC_SQL, EV_SQL, LINE_FEATURES, LINE_SQL, TXN_SQL, doc, ev, line, rounded, table, txn,
)

# A frame with infinities and nulls derived from line items: the discount is a
# divisor that is often zero.
_DIRTY = "orderkey, linenumber, price, disc"


def _dirty(spark, d):
    ratio = F.when(F.col("disc") == 0, F.lit(float("inf"))).when(
        F.col("disc") > 0.09, F.lit(float("nan"))
    ).otherwise(F.col("price") / F.col("disc"))
    return line(spark, d).select("orderkey", "linenumber", "price", "disc", "qty", ratio.alias("ratio"))


@query(
    "inf_to_null",
    f"""SELECT count(*) AS n, CAST(count(*) FILTER (WHERE disc > 0 AND disc <= 0.09) AS BIGINT) AS n_finite,
        round(sum(price / disc) FILTER (WHERE disc > 0 AND disc <= 0.09) / 1e6, 4) AS total_millions
        FROM {LINE_SQL}""",
)
def inf_to_null(spark, d):
    clean = quality.drop_infinities(_dirty(spark, d))
    return clean.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ratio").alias("n_finite"),
        rounded(F.sum("ratio") / 1e6, 4).alias("total_millions"),
    )


@query("normalized_column_names", "SELECT o_orderkey AS order_key, o_totalprice AS total_price FROM orders")
def normalized_column_names(spark, d):
    raw = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order-key"), F.col("o_totalprice").alias("total-price")
    )
    return quality.normalize_names(raw)


@query(
    "narrowed_types",
    f"""WITH m AS (SELECT max(orderkey) AS orderkey, max(linenumber) AS linenumber, max(y) AS y FROM {LINE_SQL}),
        w AS (UNPIVOT (SELECT orderkey, CAST(linenumber AS BIGINT) AS linenumber, CAST(y AS BIGINT) AS y FROM m)
        ON orderkey, linenumber, y INTO NAME feature VALUE high)
        SELECT feature, CASE WHEN high < 128 THEN 'tinyint' WHEN high < 32768 THEN 'smallint'
        WHEN high < 2147483648 THEN 'int' ELSE 'bigint' END AS narrow_type FROM w
        UNION ALL SELECT unnest(['disc', 'price', 'qty', 'tax']), 'float'""",
)
def narrowed_types(spark, d):
    df = line(spark, d).select("orderkey", "linenumber", "qty", "price", "disc", "tax", "y")
    narrow = quality.narrow_types(df)
    # Types become rows so that the result can be compared.
    kinds = F.array(*[F.struct(F.lit(f.name).alias("feature"), F.typeof(f.name).alias("narrow_type")) for f in narrow.schema])
    return narrow.select(F.explode(kinds).alias("k")).select("k.*").distinct()


@query(
    "device_os_normalized",
    """SELECT CASE WHEN contains(v, 'chrome') THEN 'Chrome' WHEN contains(v, 'safari') THEN 'Safari'
        WHEN contains(v, 'firefox') THEN 'Firefox' WHEN contains(v, 'opera') THEN 'Opera'
        WHEN contains(v, 'edge') THEN 'Edge' WHEN contains(v, 'ie') OR contains(v, 'internet explorer') THEN 'IE'
        WHEN contains(v, 'windows') THEN 'Windows'
        WHEN contains(v, 'ios') OR contains(v, 'iphone') OR contains(v, 'ipad') THEN 'iOS'
        WHEN contains(v, 'android') THEN 'Android' WHEN contains(v, 'mac') THEN 'MacOS'
        WHEN contains(v, 'linux') THEN 'Linux' ELSE raw END AS device, count(*) AS n
        FROM (SELECT p_name AS raw, lower(p_name) AS v FROM part) GROUP BY 1""",
)
def device_os_normalized(spark, d):
    padded = F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "))
    return (
        table(spark, d, "part")
        .select(text.normalize_device_os(padded).alias("device"))
        .groupBy("device").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "categorical_cleaned",
    f"""SELECT coalesce(CASE WHEN quality = 1 THEN 'good' END, 'Missing') AS grade, lang,
        count(*) AS n FROM {DOC_SQL} GROUP BY 1, 2""",
)
def categorical_cleaned(spark, d):
    raw = doc(spark, d).select("lang", F.when(F.col("quality") == 1, " good ").when(F.col("quality") == 0, "None").alias("grade"))
    return text.clean_categorical_columns(raw).groupBy("grade", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "numeric_imputed",
    f"""WITH s AS (SELECT quantile_cont(quality, 0.5) AS med, avg(quality) AS mean FROM {DOC_SQL})
        SELECT doc_id, CAST(coalesce(quality, med) AS DOUBLE) AS by_median,
        round(coalesce(quality, mean), 6) AS by_mean FROM {DOC_SQL}, s""",
)
def numeric_imputed(spark, d):
    base = doc(spark, d).select("doc_id", F.col("quality").cast("double").alias("by_median"), F.col("quality").cast("double").alias("by_mean"))
    out = quality.impute(base, "median", ["by_median"])
    return quality.impute(out, "mean", ["by_mean"]).select("doc_id", "by_median", rounded("by_mean").alias("by_mean"))


@query(
    "browser_and_os_families",
    """SELECT CASE WHEN contains(v, 'chrome') THEN 'Chrome' WHEN contains(v, 'safari') THEN 'Safari'
        WHEN contains(v, 'ie') OR contains(v, 'trident') THEN 'IE' WHEN contains(v, 'firefox') THEN 'Firefox'
        WHEN contains(v, 'edge') THEN 'Edge' WHEN contains(v, 'opera') THEN 'Opera' ELSE 'Other' END AS browser,
        CASE WHEN contains(v, 'windows') THEN 'Windows' WHEN contains(v, 'mac') THEN 'macOS'
        WHEN contains(v, 'ios') OR contains(v, 'ipad') OR contains(v, 'iphone') THEN 'iOS'
        WHEN contains(v, 'android') THEN 'Android' WHEN contains(v, 'linux') THEN 'Linux' ELSE 'Other' END AS os,
        count(*) AS n FROM (SELECT lower(text) AS v FROM documents) GROUP BY 1, 2""",
)
def browser_and_os_families(spark, d):
    return (
        table(spark, d, "documents")
        .select(text.browser_family("text").alias("browser"), text.os_family("text").alias("os"))
        .groupBy("browser", "os").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "time_features",
    f"""SELECT id, round((dt % 86400) / 3600.0, 6) AS hour_of_day, CAST((dt // 86400) % 7 AS INTEGER) AS day_of_week,
        CAST((dt % 86400) / 3600.0 BETWEEN 9 AND 17 AS INTEGER) AS is_business_hour,
        (dt // 3600) % 24 AS hour, dt // 86400 AS day, (dt // 86400) % 7 AS dow, dt // 604800 AS week,
        dt // 2592000 AS month, round(sin((dt % 86400) / 3600.0 * 2 * pi() / 24), 6) AS hour_sin,
        round(cos((dt % 86400) / 3600.0 * 2 * pi() / 24), 6) AS hour_cos FROM {EV_SQL}""",
)
def time_features(spark, d):
    family = scalars.time_family("dt")
    family["hour_of_day"] = rounded(family["hour_of_day"])
    cyclic = {k: rounded(v) for k, v in scalars.cyclic_hour("dt").items()}
    columns = {**family, **scalars.calendar_buckets("dt"), **cyclic}
    return ev(spark, d).select("id", *[c.alias(n) for n, c in columns.items()])


@query(
    "amount_features",
    f"""SELECT id, round(ln(1 + amt), 6) AS log_amount, CAST(amt > 150 AS INTEGER) AS is_high_value,
        round(amt % 1.0, 6) AS cents, round(amt / CASE WHEN key % 5 = 0 THEN 1 ELSE key % 5 END, 6) AS amount_per_count
        FROM {EV_SQL}""",
)
def amount_features(spark, d):
    family = scalars.amount_family("amt")
    return ev(spark, d).select(
        "id",
        rounded(family["log_amount"]).alias("log_amount"),
        family["is_high_value"].alias("is_high_value"),
        rounded(family["cents"]).alias("cents"),
        rounded(scalars.amount_per_count("amt", F.col("key") % 5)).alias("amount_per_count"),
    )


_FREE = ", ".join(f"'{x}'" for x in scalars.FREE_MAIL_DOMAINS)
_MAIL_SQL = """(SELECT d.doc_id, regexp_extract(text, '@([A-Za-z0-9.-]+)', 1) AS m, lang,
    CASE WHEN l.quality = 1 THEN 'gmail.com' WHEN l.quality = 0 THEN 'corp.example' END AS r
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(
    "email_features",
    f"""SELECT doc_id, CAST(nullif(lower(m), '') IS NOT DISTINCT FROM r AS INTEGER) AS email_match,
        CAST(lower(m) IN ({_FREE}) AS INTEGER) AS p_is_free,
        CAST(coalesce(r IN ({_FREE}), false) AS INTEGER) AS r_is_free FROM {_MAIL_SQL}""",
)
def email_features(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    mail = F.regexp_extract("text", "@([A-Za-z0-9.-]+)", 1)
    docs = docs.select(
        "doc_id",
        F.when(mail != "", mail).alias("p"),
        F.when(F.col("quality") == 1, "gmail.com").when(F.col("quality") == 0, "corp.example").alias("r"),
    )
    return docs.select("doc_id", *[c.alias(n) for n, c in scalars.email_family("p", "r").items()])


@query(
    "device_and_card_features",
    """SELECT doc_id, CAST(contains(v, 'windows') AS INTEGER) AS is_windows,
        CAST(contains(v, 'ios') OR contains(v, 'mac') OR contains(v, 'iphone') AS INTEGER) AS is_apple,
        CAST(contains(v, 'android') OR contains(v, 'samsung') OR contains(v, 'huawei') AS INTEGER) AS is_android,
        CAST(contains(v, 'visa') AS INTEGER) AS is_visa, CAST(contains(v, 'mastercard') AS INTEGER) AS is_mastercard
        FROM (SELECT doc_id, lower(text) AS v FROM documents)""",
)
def device_and_card_features(spark, d):
    flags = {**scalars.device_family("text"), **scalars.card_family("text")}
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query(
    "address_features",
    f"""SELECT doc_id, CAST(quality IS NULL AS INTEGER) AS quality_is_missing,
        CAST(toxic IS NULL AS INTEGER) AS toxic_is_missing,
        CASE WHEN quality IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY quality) END AS quality_frequency
        FROM {DOC_SQL}""",
)
def address_features(spark, d):
    base = doc(spark, d)
    flags = scalars.missing_flags(["quality", "toxic"])
    out = aggregates.with_frequency(base, "quality", "quality_frequency")
    return out.select("doc_id", *[c.alias(n) for n, c in flags.items()], "quality_frequency")


@query(
    "identity_completeness",
    f"""SELECT doc_id, ((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) / 2.0::DOUBLE AS completeness_score
        FROM {DOC_SQL}""",
)
def identity_completeness(spark, d):
    return doc(spark, d).select("doc_id", scalars.completeness(["quality", "toxic"]).alias("completeness_score"))


@query(
    "safe_arithmetic",
    f"""SELECT orderkey, linenumber, qty, price, disc, tax,
        round(CASE WHEN disc = 0 THEN 0 ELSE coalesce(disc / nullif(tax, 0), 1.0) END, 6) AS ratio,
        round(disc - tax, 6) AS difference, round(qty * disc, 6) AS product,
        round(coalesce(qty / nullif(disc, 0), 0), 6) AS quotient, round(qty + tax, 6) AS total,
        round(qty - tax, 6) AS gap, round(coalesce(qty / nullif(tax, 0), -1.0), 6) AS divided FROM {LINE_SQL}""",
)
def safe_arithmetic(spark, d):
    return line(spark, d).select(
        "orderkey", "linenumber", "qty", "price", "disc", "tax",
        rounded(scalars.safe_ratio("disc", "tax")).alias("ratio"),
        rounded(scalars.safe_difference("disc", "tax")).alias("difference"),
        rounded(scalars.interaction("qty", "disc", "multiply")).alias("product"),
        rounded(scalars.interaction("qty", "disc", "divide")).alias("quotient"),
        rounded(scalars.interaction("qty", "tax", "add")).alias("total"),
        rounded(scalars.interaction("qty", "tax", "subtract")).alias("gap"),
        rounded(scalars.safe_divide("qty", "tax", -1.0)).alias("divided"),
    )


@query(
    "discovered_pair_features",
    f"""WITH s AS (SELECT key, avg(amt) AS amt_mean, max(amt) AS amt_max FROM {TXN_SQL} GROUP BY key)
        SELECT id, round(amt / amt_mean, 6) AS amt_mean_ratio, round(amt / amt_max, 6) AS amt_max_ratio,
        round(amt - amt_mean, 6) AS amt_mean_diff, round(amt - amt_max, 6) AS amt_max_diff
        FROM {TXN_SQL} JOIN s USING (key)""",
)
def discovered_pair_features(spark, d):
    base = txn(spark, d)
    wide = aggregates.attach_entity_stats(
        base, aggregates.entity_stats(base, "key", "amt", ["mean", "max"], prefix="amt"), "key"
    )
    pairs = scalars.discover_pairs(wide.columns, ["amt"], ["_mean", "_max"])
    return wide.select(
        "id",
        *[rounded(scalars.safe_ratio(n, s)).alias(f"{s}_ratio") for n, s in pairs],
        *[rounded(scalars.safe_difference(n, s)).alias(f"{s}_diff") for n, s in pairs],
    )


_ASKED = ["quality", "toxic", "not_there"]


@query(
    "missing_features",
    f"""SELECT doc_id, CAST(quality IS NULL AS DOUBLE) AS quality_missing, CAST(toxic IS NULL AS DOUBLE) AS toxic_missing,
        1.0::DOUBLE AS not_there_missing, (quality IS NULL)::INT + (toxic IS NULL)::INT + 1 AS missing_count,
        round(((quality IS NULL)::INT + (toxic IS NULL)::INT + 1) / 3.0, 6) AS missing_ratio,
        round(1 - ((quality IS NULL)::INT + (toxic IS NULL)::INT + 1) / 3.0, 6) AS completeness,
        (quality IS NULL)::BIGINT + 2 * (toxic IS NULL)::BIGINT + 4 AS pattern FROM {DOC_SQL}""",
)
def missing_features(spark, d):
    df = doc(spark, d)
    stats = scalars.row_missing_stats(df, _ASKED)
    return df.select(
        "doc_id",
        *[c.alias(n) for n, c in scalars.missing_indicators(df, _ASKED).items()],
        stats["missing_count"].alias("missing_count"),
        rounded(stats["missing_ratio"]).alias("missing_ratio"),
        rounded(stats["completeness"]).alias("completeness"),
        scalars.missing_pattern(df, _ASKED).alias("pattern"),
    )


@query(
    "missing_family_signatures",
    f"""SELECT CASE WHEN quality IS NULL OR toxic IS NULL THEN 'Identity' ELSE 'No Missing Families' END AS signature,
        count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM {DOC_SQL} GROUP BY 1""",
)
def missing_family_signatures(spark, d):
    df = doc(spark, d)
    families = {"Identity": ["quality", "toxic"], "Document": ["lang", "source", "n_chars"]}
    return aggregates.value_shares(df.select(scalars.family_signature(families).alias("signature")), "signature")


@query(
    "amount_bins",
    f"""SELECT CASE WHEN amt <= 20 THEN 'Very Low' WHEN amt <= 100 THEN 'Low' WHEN amt <= 500 THEN 'Medium'
        WHEN amt <= 2000 THEN 'High' ELSE 'Very High' END AS band, count(*) AS n, sum(y)::BIGINT AS positives
        FROM {EV_SQL} WHERE amt > 0 GROUP BY 1""",
)
def amount_bins(spark, d):
    return (
        ev(spark, d).withColumn("band", binning.amount_bin("amt")).filter("band IS NOT NULL")
        .groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
    )


@query(
    "quartile_bins",
    f"""WITH q AS (SELECT quantile_cont(price, 0.25) a, quantile_cont(price, 0.5) b, quantile_cont(price, 0.75) c FROM {LINE_SQL})
        SELECT CASE WHEN price <= a THEN 'Q1' WHEN price <= b THEN 'Q2' WHEN price <= c THEN 'Q3' ELSE 'Q4' END AS bin,
        count(*) AS n, round(min(price), 4) AS low, round(max(price), 4) AS high FROM {LINE_SQL}, q GROUP BY 1""",
)
def quartile_bins(spark, d):
    df = line(spark, d).select("price")
    edges = binning.unique_edges(exact_quantiles(df, ["price"], [0, 0.25, 0.5, 0.75, 1])["price"])
    return (
        df.groupBy(binning.quartile_label("price", edges).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), rounded(F.min("price"), 4).alias("low"), rounded(F.max("price"), 4).alias("high"))
    )


_BANDS = {
    "imbalance": "n / 10.0", "cardinality": "n", "profile_cardinality": "n", "dominance": "share",
    "skewness": "share / 10.0 - 2", "kurtosis": "share / 10.0 - 2", "missing_level": "share",
    "missing_action": "share", "availability": "share", "psi_level": "share / 100.0",
    "drift_report": "share / 100.0", "stability_class": "share", "effect_size": "share / 40.0",
    "risk_label": "share", "quality_rating": "share", "leakage_category": "share",
    "significance": "share / 100.0", "encoding_strategy": "n",
}


@query(
    "threshold_labels",
    "WITH s AS (SELECT o_custkey AS key, count(*) AS n, 4.0::DOUBLE * count(*) AS share FROM orders GROUP BY 1) "
    "SELECT key, " + ", ".join(f"{bands.rule_sql(r, e)} AS {r}" for r, e in _BANDS.items()) + " FROM s",
)
def threshold_labels(spark, d):
    s = txn(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 4.0).alias("share"))
    return s.select("key", *[bands.classify(r, F.expr(e)).alias(r) for r, e in _BANDS.items()])


@query(
    "masked_values",
    """SELECT c_custkey, substr(m, 1, 1) || '***@' || seg AS mail, '***' AS plain,
        substr(c_name, 1, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) AS secret
        FROM (SELECT c_custkey, c_name, c_name AS m, lower(c_mktsegment) AS seg FROM customer)""",
)
def masked_values(spark, d):
    mail = F.concat("c_name", F.lit("@"), F.lower("c_mktsegment"))
    base = table(spark, d, "customer").select("c_custkey", mail.alias("mail"), F.col("c_name").alias("plain"), text.mask_secret("c_name").alias("secret"))
    return text.mask_columns(base, ["mail", "plain"])


@query("encrypted_field_round_trip", "SELECT count(*) AS n, count(*) AS n_same, CAST(0 AS BIGINT) AS n_plain FROM customer")
def encrypted_field_round_trip(spark, d):
    key = F.lit("0123456789abcdef")
    names = table(spark, d, "customer").select("c_name")
    # The nonce is random, so the cipher text is computed once per row and both
    # checks read that one value.
    sealed = names.withColumn("sealed", text.encrypt("c_name", key))
    opened = sealed.withColumn("opened", text.decrypt("sealed", key))
    return opened.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("opened") == F.col("c_name")).cast("long")).alias("n_same"),
        F.sum((F.col("sealed") == F.col("c_name")).cast("long")).alias("n_plain"),
    )


_ASSIGN = text.SECRET_PATTERNS["assignment"].replace("'", "''")
_BEARER = text.SECRET_PATTERNS["bearer"]


@query(
    "secret_scan",
    f"""WITH d AS (SELECT doc_id, replace(text, 'token = "', 'bearer x1 api_key = "') AS text FROM documents),
        h AS (SELECT doc_id, 'assignment' AS kind, regexp_extract_all(text, '{_ASSIGN}', 0) AS hits FROM d
        UNION ALL SELECT doc_id, 'bearer', regexp_extract_all(text, '{_BEARER}', 0) FROM d),
        x AS (SELECT doc_id, kind, generate_subscripts(hits, 1) - 1 AS pos, unnest(hits) AS hit FROM h)
        SELECT doc_id, kind, CAST(pos AS INTEGER) AS pos, CASE WHEN length(hit) <= 4 THEN '****'
        ELSE substr(hit, 1, 2) || repeat('*', length(hit) - 4) || right(hit, 2) END AS masked FROM x""",
)
def secret_scan(spark, d):
    # The documents hold tokens: they become both kinds of credential.
    named = F.replace(F.col("text"), F.lit('token = "'), F.lit('bearer x1 api_key = "'))
    return text.scan_secrets(table(spark, d, "documents").withColumn("text", named), "doc_id", "text")


@query(
    "clean_scores",
    f"""SELECT orderkey, linenumber, disc, qty, CASE WHEN disc = 0 THEN 1.0 WHEN disc > 0.09 THEN 0.0 ELSE round(disc * 10, 6) END AS score,
        CASE WHEN disc = 0 THEN 1.0 WHEN disc > 0.09 THEN 0.0 ELSE least(1.0, round(qty * disc, 6)) END AS clipped FROM {LINE_SQL}""",
)
def clean_scores(spark, d):
    raw = lambda v: (
        F.when(F.col("disc") == 0, F.lit(float("inf"))).when(F.col("disc") > 0.09, F.lit(float("nan"))).otherwise(v)
    )
    return line(spark, d).select(
        "orderkey", "linenumber", "disc", "qty",
        scalars.clean_score(raw(F.round(F.col("disc") * 10, 6))).alias("score"),
        scalars.clip_probability(scalars.clean_score(raw(F.round(F.col("qty") * F.col("disc"), 6)))).alias("clipped"),
    )


@query(
    "standard_scaled",
    f"""WITH s AS (SELECT avg(qty) mq, stddev_samp(qty) sq, avg(price) mp, stddev_samp(price) sp FROM {LINE_SQL})
        SELECT orderkey, linenumber, qty, price, round((qty - mq) / sq, 5) AS qty_z, round((price - mp) / sp, 5) AS price_z FROM {LINE_SQL}, s""",
)
def standard_scaled(spark, d):
    df = line(spark, d)
    scaled = aggregates.standard_scale(df, aggregates.fit_scaler(df, ["qty", "price"]))
    return scaled.select("orderkey", "linenumber", "qty", "price", rounded("qty_z", 5).alias("qty_z"), rounded("price_z", 5).alias("price_z"))


@query(
    "serving_projection",
    f"""SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(coalesce(quality, 0) AS DOUBLE) AS quality, CAST(0 AS DOUBLE) AS absent FROM {DOC_SQL}""",
)
def serving_projection(spark, d):
    return scalars.project_features(doc(spark, d), ["n_chars", "quality", "absent"], ["doc_id"])


@query(
    "two_valued_as_binary",
    f"SELECT orderkey, linenumber, price, CAST(status = (SELECT max(status) FROM {LINE_SQL}) AS INTEGER) AS status_flag FROM {LINE_SQL}",
)
def two_valued_as_binary(spark, d):
    df = line(spark, d)
    values = aggregates.two_values(df, "status")
    return df.select("orderkey", "linenumber", "price", aggregates.as_binary("status", values).alias("status_flag"))


@query(
    "model_matrix",
    f"""SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(coalesce(quality, 0) AS DOUBLE) AS quality,
        CAST(coalesce(toxic, 0) AS DOUBLE) AS toxic FROM {DOC_SQL}""",
)
def model_matrix(spark, d):
    df = doc(spark, d)
    aligned = scalars.align_features(df, ["n_chars", "quality", "toxic"], ["doc_id"])
    return scalars.model_matrix(aligned, ["n_chars", "quality", "toxic"], ["doc_id"])
