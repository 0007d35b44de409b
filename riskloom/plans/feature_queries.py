"""Joins, entity statistics, encoders, folds, sources and the feature store."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import scalars
from riskloom.operators import aggregates, encode, joins, sets, temporal
from riskloom.operators.quality import feature_gate
from riskloom.operators.rows import with_row
from riskloom.plans.profile_queries import _round
from riskloom.plans.registry import query
from riskloom.plans.views import (
    DOC_SQL, EV_SQL, TEST_SQL, TRAIN_SQL, TXN_SQL, doc, ev, rounded, table, txn,
)
from riskloom.session import work_path
from riskloom.sources import readers, sinks, store

# --- flagship -------------------------------------------------------------------


@query(
    "flagship_entity_risk",
    f"""WITH s AS (SELECT key, avg(amt) AS m, median(amt) AS md, coalesce(stddev_samp(amt), 0) AS sd, min(amt) AS lo, max(amt) AS hi, count(amt) AS n FROM {TRAIN_SQL} GROUP BY key),
        g AS (SELECT avg(m) AS m, avg(md) AS md, avg(lo) AS lo, avg(hi) AS hi FROM s),
        w AS (SELECT *, coalesce(avg(amt) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pm,
        count(amt) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc,
        coalesce(avg(amt) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS pr FROM {TXN_SQL})
        SELECT w.id, w.key, amt, round(pm, 6) AS key_amt_prior_mean, pc AS key_amt_prior_count, round(pr, 6) AS key_amt_roll_mean,
        round(coalesce(s.m, g.m), 6) AS key_amt_mean, round(coalesce(s.sd, 0), 4) AS key_amt_std, coalesce(s.n, 0) AS key_amt_count,
        round(amt / coalesce(s.m, g.m), 6) AS amt_to_mean FROM w LEFT JOIN s ON w.key = s.key, g ORDER BY amt / coalesce(s.m, g.m) DESC, id LIMIT 100""",
)
def flagship_entity_risk(spark, d):
    base = temporal.prior_windows(txn(spark, d).select("id", "key", "amt"), "key", ["id"], "amt")
    stats = aggregates.entity_stats(txn(spark, d, "train"), "key", "amt", ["mean", "std", "count"])
    wide = aggregates.attach_entity_stats(base, stats, "key")
    wide = wide.withColumn("amt_to_mean", scalars.safe_ratio("amt", "key_amt_mean"))
    top = wide.orderBy(F.col("amt_to_mean").desc(), "id").limit(100)
    return _round(top, key_amt_std=4).select(
        "id", "key", "amt", "key_amt_prior_mean", "key_amt_prior_count", "key_amt_roll_mean",
        "key_amt_mean", "key_amt_std", "key_amt_count", "amt_to_mean",
    )


# --- joins ------------------------------------------------------------------------


@query("identity_merge", f"SELECT * FROM {DOC_SQL}")
def identity_merge(spark, d):
    return doc(spark, d)


@query(
    "family_merge",
    f"""SELECT id, round(ln(1 + amt), 6) AS log_amount, (dt // 3600) % 24 AS hour, count(*) OVER (PARTITION BY key) AS key_frequency FROM {EV_SQL}""",
)
def family_merge(spark, d):
    df = ev(spark, d)
    amounts = df.select("id", rounded(F.log1p("amt")).alias("log_amount"))
    times = df.select("id", F.pmod(F.floor(F.col("dt") / 3600), F.lit(24)).alias("hour"), F.lit(0).alias("log_amount"))
    cards = aggregates.with_frequency(df.select("id", "key"), "key", "key_frequency").select("id", "key_frequency")
    return joins.merge_families([amounts, times, cards], "id")


_KEY_VIEW = f"(SELECT key, count(*) AS n_txn, round(max(amt), 2) AS max_amt FROM {TRAIN_SQL} GROUP BY key)"


def _key_view(spark, d):
    return txn(spark, d, "train").groupBy("key").agg(F.count(F.lit(1)).alias("n_txn"), rounded(F.max("amt"), 2).alias("max_amt"))


@query(
    "historical_features",
    f"""SELECT c_custkey AS key, c_nationkey, n_txn, max_amt, n_events FROM customer LEFT JOIN {_KEY_VIEW} v ON c_custkey = v.key
        LEFT JOIN (SELECT key AS k2, count(*) AS n_events FROM {EV_SQL} GROUP BY 1) e ON c_custkey = k2""",
)
def historical_features(spark, d):
    entities = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey")
    events = ev(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n_events"))
    return store.historical_features(entities, {"txn": _key_view(spark, d), "gone": None, "events": events}, "key")


@query(
    "feature_label_join",
    f"SELECT d.doc_id, n_chars, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def feature_label_join(spark, d):
    features = table(spark, d, "documents").select("doc_id", "n_chars")
    return features.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "inner")


@query(
    "feature_raw_join",
    f"SELECT t.id, t.amt, v.n_txn FROM {TXN_SQL} t LEFT JOIN {_KEY_VIEW} v ON t.key = v.key",
)
def feature_raw_join(spark, d):
    out = joins.lookup_join(txn(spark, d), _key_view(spark, d), ["key"])
    return out.select("id", "amt", "n_txn")


@query(
    "membership_flags",
    "SELECT doc_id, CAST(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS INTEGER) AS is_flagged FROM documents",
)
def membership_flags(spark, d):
    flagged = table(spark, d, "labels").filter("toxic = 1")
    return joins.flag_membership(table(spark, d, "documents").select("doc_id"), flagged, "doc_id", "is_flagged")


@query("membership_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def membership_semi_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_semi")


_DUP = ["lang", "quality", "toxic"]
_DUP_A, _DUP_B = f"(SELECT * FROM {DOC_SQL} WHERE n_chars < 2000)", f"(SELECT * FROM {DOC_SQL} WHERE n_chars >= 2000)"


@query(
    "duplicate_overlap",
    f"""WITH p AS (SELECT count(*) AS n FROM {_DUP_A} a JOIN {_DUP_B} b ON {' AND '.join(f'a.{c} IS NOT DISTINCT FROM b.{c}' for c in _DUP)})
        SELECT (SELECT count(*) FROM {_DUP_A}) AS train_rows, (SELECT count(*) FROM {_DUP_B}) AS test_rows, n AS duplicate_matches,
        round(n / (SELECT count(*) FROM {_DUP_A})::DOUBLE, 6) AS overlap_fraction, CASE WHEN n / (SELECT count(*) FROM {_DUP_A})::DOUBLE > 0.05 THEN 'CRITICAL' ELSE 'SAFE' END AS risk FROM p""",
)
def duplicate_overlap(spark, d):
    df = doc(spark, d)
    return _round(joins.duplicate_overlap(df.filter("n_chars < 2000"), df.filter("n_chars >= 2000"), _DUP))


@query(
    "aligned_category_shares",
    f"""WITH a AS (SELECT key % 40 + CASE WHEN key % 2 = 0 THEN 3 ELSE 0 END AS region, count(*) AS n_train FROM {TRAIN_SQL} GROUP BY 1),
        b AS (SELECT key % 40 AS region, count(*) AS n_test FROM {TEST_SQL} GROUP BY 1)
        SELECT coalesce(a.region, b.region) AS region, coalesce(n_train, 0) AS n_train, coalesce(n_test, 0) AS n_test FROM a FULL JOIN b ON a.region = b.region""",
)
def aligned_category_shares(spark, d):
    region = F.col("key") % 40
    train = txn(spark, d, "train").groupBy((region + F.when(F.col("key") % 2 == 0, 3).otherwise(0)).alias("region")).agg(F.count(F.lit(1)).alias("n_train"))
    test = txn(spark, d, "test").groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("n_test"))
    return joins.align_counts(train, test, ["region"], "n_train", "n_test")


# --- entity statistics --------------------------------------------------------------


@query(
    "entity_statistics",
    f"""WITH s AS (SELECT key, avg(amt) AS m, median(amt) AS md, coalesce(stddev_samp(amt), 0) AS sd, min(amt) AS lo, max(amt) AS hi, count(amt) AS n FROM {TRAIN_SQL} GROUP BY key),
        g AS (SELECT avg(m) AS m, avg(md) AS md, avg(lo) AS lo, avg(hi) AS hi FROM s)
        SELECT t.id, t.key, round(coalesce(s.m, g.m), 6) AS key_amt_mean, round(coalesce(s.md, g.md), 6) AS key_amt_median, round(coalesce(s.sd, 0), 4) AS key_amt_std,
        round(coalesce(s.lo, g.lo), 6) AS key_amt_min, round(coalesce(s.hi, g.hi), 6) AS key_amt_max, coalesce(s.n, 0) AS key_amt_count
        FROM {TEST_SQL} t LEFT JOIN s ON t.key = s.key, g""",
)
def entity_statistics(spark, d):
    stats = aggregates.entity_stats(txn(spark, d, "train"), "key", "amt")
    out = aggregates.attach_entity_stats(txn(spark, d, "test").select("id", "key"), stats, "key")
    return _round(out, key_amt_std=4)


@query(
    "frequency_features",
    f"SELECT id, count(*) OVER (PARTITION BY product) AS product_count, count(*) OVER (PARTITION BY key) AS key_frequency FROM {TXN_SQL}",
)
def frequency_features(spark, d):
    df = aggregates.with_frequency(txn(spark, d), "product", "product_count", null_label="nan")
    return aggregates.with_frequency(df, "key", "key_frequency").select("id", "product_count", "key_frequency")


@query(
    "card_graph_features",
    f"""WITH c AS (SELECT id, key, count(*) OVER (PARTITION BY key) AS degree FROM {TXN_SQL})
        SELECT id, key, degree, round(greatest(0.001, least(1.0, degree / (SELECT max(degree) FROM c)::DOUBLE)), 6) AS normalised_degree,
        CAST(CASE WHEN degree > 10 THEN 0.8 ELSE 0.1 END AS DOUBLE) AS community_risk FROM c""",
)
def card_graph_features(spark, d):
    return _round(sets.degree_features(txn(spark, d).select("id", "key"), "key"))


# --- encoders ---------------------------------------------------------------------


_TEST_VALUE = "CASE WHEN key % 11 = 0 THEN 'new' ELSE product END"


def _encode_test(spark, d):
    return txn(spark, d, "test").select("id", F.when(F.col("key") % 11 == 0, "new").otherwise(F.col("product")).alias("product"))


@query(
    "label_encoder",
    f"""WITH m AS (SELECT product AS v, CAST(dense_rank() OVER (ORDER BY product) - 1 AS INTEGER) AS c FROM (SELECT DISTINCT product FROM {TRAIN_SQL}))
        SELECT id, product, coalesce(c, -1) AS product_label FROM (SELECT id, {_TEST_VALUE} AS product FROM {TEST_SQL}) LEFT JOIN m ON product = v""",
)
def label_encoder(spark, d):
    return encode.transform_label(_encode_test(spark, d), "product", encode.fit_label(txn(spark, d, "train"), "product"))


@query(
    "frequency_encoder",
    f"""WITH m AS (SELECT product AS v, count(*) / (SELECT count(*) FROM {TRAIN_SQL})::DOUBLE AS c FROM {TRAIN_SQL} GROUP BY 1)
        SELECT id, product, round(coalesce(c, 0), 8) AS product_freq FROM (SELECT id, {_TEST_VALUE} AS product FROM {TEST_SQL}) LEFT JOIN m ON product = v""",
)
def frequency_encoder(spark, d):
    return _round(encode.transform_frequency(_encode_test(spark, d), "product", encode.fit_frequency(txn(spark, d, "train"), "product")), 8)


@query(
    "count_encoder",
    f"""WITH c AS (SELECT CAST(key AS VARCHAR) AS v, count(*) AS n FROM {TRAIN_SQL} GROUP BY 1),
        m AS (SELECT *, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / (SELECT count(*) FROM c) AS p FROM c)
        SELECT id, key, CAST(coalesce(n, 0) AS DOUBLE) AS key_count, round(coalesce(ln(1 + n), 0), 6) AS key_log, round(coalesce(p, 0), 6) AS key_percentile
        FROM {TEST_SQL} LEFT JOIN m ON CAST(key AS VARCHAR) = v""",
)
def count_encoder(spark, d):
    train, out = txn(spark, d, "train"), txn(spark, d, "test").select("id", "key")
    for mode in encode.COUNT_MODES:
        out = encode.transform_count(out, "key", encode.fit_count(train, "key", mode))
    return _round(out)


_SMOOTH = "w * s / n + (1 - w) * {prior}"


@query(
    "target_encoder",
    f"""WITH p AS (SELECT avg(y) AS prior FROM {TRAIN_SQL}), m AS (SELECT CAST(key AS VARCHAR) AS v, count(y) AS n, sum(y) AS s, 1 / (1 + exp(-(count(y) - 20) / 10.0)) AS w FROM {TRAIN_SQL} GROUP BY 1)
        SELECT id, key, round(coalesce({_SMOOTH.format(prior='prior')}, prior), 8) AS key_target FROM {TEST_SQL} LEFT JOIN m ON CAST(key AS VARCHAR) = v, p""",
)
def target_encoder(spark, d):
    mapping, prior = encode.fit_target(txn(spark, d, "train"), "key", "y")
    return _round(encode.transform_target(txn(spark, d, "test").select("id", "key"), "key", mapping, prior), 8)


@query(
    "out_of_fold_target_encoder",
    f"""WITH t AS (SELECT *, id % 5 AS f FROM {TXN_SQL}), c AS (SELECT key, f, count(y) AS n0, sum(y) AS s0 FROM t GROUP BY 1, 2),
        k AS (SELECT *, sum(n0) OVER (PARTITION BY key) - n0 AS n, sum(s0) OVER (PARTITION BY key) - s0 AS s FROM c),
        p AS (SELECT f, ((SELECT sum(y) FROM t) - sum(y)) / ((SELECT count(*) FROM t) - count(*))::DOUBLE AS prior FROM t GROUP BY f)
        SELECT id, key, round(CASE WHEN n > 0 THEN (1 / (1 + exp(-(n - 20) / 10.0))) * s / n + (1 - 1 / (1 + exp(-(n - 20) / 10.0))) * prior ELSE prior END, 8) AS key_oof
        FROM t JOIN k USING (key, f) JOIN p USING (f)""",
)
def out_of_fold_target_encoder(spark, d):
    df = txn(spark, d)
    out = encode.out_of_fold_target(df, "key", "y", F.pmod("id", F.lit(5)).cast("int"))
    return _round(out.select("id", "key", "key_oof"), 8)


@query(
    "one_hot_encoder",
    f"""SELECT id, CAST(b = 'low' AS INTEGER) AS band_low, CAST(b = 'high' AS INTEGER) AS band_high, CAST(b NOT IN ('low', 'high') AS INTEGER) AS band_unknown
        FROM (SELECT id, CASE WHEN amt > 495000 THEN 'rare' WHEN amt > 250000 THEN 'high' ELSE 'low' END AS b FROM {TXN_SQL})""",
)
def one_hot_encoder(spark, d):
    band = F.when(F.col("amt") > 495000, "rare").when(F.col("amt") > 250000, "high").otherwise("low")
    df = txn(spark, d).select("id", band.alias("band"))
    return encode.transform_one_hot(df, "band", encode.fit_one_hot(df, "band")).drop("band")


@query(
    "encoder_bundle",
    f"""SELECT 'product_label' AS feature, product AS value, CAST(dense_rank() OVER (ORDER BY product) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT product FROM {TRAIN_SQL})
        UNION ALL SELECT 'product_freq', product, round(count(*) / (SELECT count(*) FROM {TRAIN_SQL})::DOUBLE, 6) FROM {TRAIN_SQL} GROUP BY 2""",
)
def encoder_bundle(spark, d):
    train = txn(spark, d, "train")
    bundle = encode.encoder_bundle({"product_label": encode.fit_label(train, "product"), "product_freq": encode.fit_frequency(train, "product")})
    path = sinks.write_stage(bundle, work_path(spark, "encoders"))
    return _round(spark.read.parquet(path))


# --- folds ------------------------------------------------------------------------


@query(
    "time_ordered_folds",
    f"""WITH n AS (SELECT count(*) AS n, count(*) // 6 AS b FROM {TXN_SQL}), t AS (SELECT id, row_number() OVER (ORDER BY dt, id) - 1 AS ordinal FROM {TXN_SQL}),
        f AS (SELECT unnest(range(5)) AS fold), x AS (SELECT id, ordinal, fold, n - b * 5 + b * fold AS s, b FROM t, f, n)
        SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN ordinal < s THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(ordinal) AS first, max(ordinal) AS last, sum(id)::BIGINT AS id_sum
        FROM x WHERE ordinal < s + b GROUP BY 1, 2""",
)
def time_ordered_folds(spark, d):
    folds = encode.time_folds(txn(spark, d).select("dt", "id"), ["dt", "id"], 5)
    return folds.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.sum("id").alias("id_sum")
    )


@query(
    "time_ordered_holdout",
    f"""WITH t AS (SELECT id, row_number() OVER (ORDER BY dt, id) - 1 AS ordinal FROM {TXN_SQL})
        SELECT id, ordinal, CASE WHEN ordinal < CAST(floor(0.8 * (SELECT count(*) FROM {TXN_SQL})) AS BIGINT) THEN 'train' ELSE 'test' END AS role FROM t""",
)
def time_ordered_holdout(spark, d):
    return encode.time_holdout(txn(spark, d).select("dt", "id"), ["dt", "id"]).select("id", "ordinal", "role")


@query(
    "stratified_folds",
    f"""SELECT y, fold, count(*) AS n, sum(id)::BIGINT AS id_sum FROM (SELECT id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY (id * 7919) % 10007, id) - 1) % 5 AS INTEGER) AS fold FROM {TXN_SQL}) GROUP BY 1, 2""",
)
def stratified_folds(spark, d):
    out = encode.stratified_folds(txn(spark, d).select("id", "y"), "y", (F.col("id") * 7919) % 10007, 5)
    return out.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


def _id_hash_sql(seed: int) -> str:
    return f"('0x' || substr(md5(id::VARCHAR || '|{seed}'), 1, 13))::BIGINT"


@query(
    "hashed_stratified_folds",
    f"""SELECT y, CAST(r % 5 AS INTEGER) AS fold, count(*) AS n FROM (
        SELECT y, row_number() OVER (PARTITION BY y ORDER BY {_id_hash_sql(42)}, id) - 1 AS r FROM {TXN_SQL}) GROUP BY 1, 2""",
)
def hashed_stratified_folds(spark, d):
    out = encode.stratified_folds(txn(spark, d).select("id", "y"), "y", sets.id_hash(["id"], 42), 5)
    return out.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"))


# --- sorts, limits and sets ------------------------------------------------------------


@query(
    "report_sorted_by_magnitude",
    f"SELECT key, round(corr_, 6) AS lean FROM (SELECT key, avg(y) - (SELECT avg(y) FROM {TXN_SQL}) AS corr_ FROM {TXN_SQL} GROUP BY key) ORDER BY abs(corr_) DESC, key",
)
def report_sorted_by_magnitude(spark, d):
    df = txn(spark, d)
    overall = df.agg(F.avg("y").alias("m"))
    lean = df.groupBy("key").agg(F.avg("y").alias("r")).transform(with_row, overall).select("key", (F.col("r") - F.col("m")).alias("lean"))
    return _round(sets.sort_by_magnitude(lean, "lean", "key"))


@query("top_rows", f"SELECT id, amt FROM {TXN_SQL} ORDER BY amt DESC, id LIMIT 50")
def top_rows(spark, d):
    return sets.top_rows(txn(spark, d).select("id", "amt"), [F.col("amt").desc(), F.col("id")], 50)


@query(
    "top_rows_per_group",
    f"SELECT product, id, amt, CAST(r AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY amt DESC, id) AS r FROM {TXN_SQL}) WHERE r <= 5",
)
def top_rows_per_group(spark, d):
    out = sets.top_per_group(txn(spark, d), ["product"], [F.col("amt").desc(), F.col("id")], 5)
    return out.select("product", "id", "amt", "position")


@query(
    "largest_row_per_key",
    f"SELECT key, id, amt FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY amt DESC, id DESC) AS r FROM {TXN_SQL}) WHERE r = 1",
)
def largest_row_per_key(spark, d):
    return store.latest_per_key(txn(spark, d).select("key", "id", "amt"), "key", ["amt", "id"])


@query("seeded_sample", f"SELECT id, amt, y FROM {TXN_SQL} ORDER BY {_id_hash_sql(42)}, id LIMIT 500")
def seeded_sample(spark, d):
    return sets.seeded_sample(txn(spark, d), ["id"], 500, seed=42).select("id", "amt", "y")


@query("seeded_fraction", f"SELECT id FROM {TXN_SQL} WHERE {_id_hash_sql(42)} % 1000000 < 100000")
def seeded_fraction(spark, d):
    return sets.seeded_fraction(txn(spark, d), ["id"], 0.1, seed=42).select("id")


_POISSON_SQL = " + ".join(f"(u >= {step!r})::INT" for step in sets.poisson_steps())


@query(
    "bootstrap_sample",
    f"""SELECT y, sum(times)::BIGINT AS n FROM (
        SELECT y, {_POISSON_SQL} AS times FROM (SELECT y, ({_id_hash_sql(7)} + 0.5)::DOUBLE / 4503599627370496.0 AS u FROM {TXN_SQL})) GROUP BY 1""",
)
def bootstrap_sample(spark, d):
    return sets.bootstrap(txn(spark, d).select("id", "y"), ["id"], seed=7).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query(
    "train_test_union",
    f"SELECT *, 'train' AS split FROM {TRAIN_SQL} UNION ALL SELECT *, 'test' FROM {TEST_SQL}",
)
def train_test_union(spark, d):
    return sets.stack({"train": txn(spark, d, "train"), "test": txn(spark, d, "test")}, "split")


@query(
    "report_union",
    f"""SELECT product, NULL::BIGINT AS day, count(*) AS n, 'product' AS report FROM {TXN_SQL} GROUP BY 1 UNION ALL SELECT NULL, dt // 86400, count(*), 'day' FROM {TXN_SQL} GROUP BY 2""",
)
def report_union(spark, d):
    df = txn(spark, d)
    by_product = df.groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    by_day = df.groupBy(F.floor(F.col("dt") / 86400).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sets.stack({"product": by_product, "day": by_day}, "report")


_SET_A = f"(SELECT DISTINCT key % 60 AS region FROM {TXN_SQL})"
_SET_B = f"(SELECT DISTINCT key % 75 + 10 AS region FROM {EV_SQL})"


def _sets(spark, d):
    # Regions of customers and of users: each side has some of its own.
    return txn(spark, d).select((F.col("key") % 60).alias("region")), ev(spark, d).select((F.col("key") % 75 + 10).alias("region"))


@query(
    "new_and_vanished_categories",
    f"SELECT region, 'new' AS kind FROM ({_SET_B} EXCEPT {_SET_A}) UNION ALL SELECT region, 'vanished' FROM ({_SET_A} EXCEPT {_SET_B})",
)
def new_and_vanished_categories(spark, d):
    return sets.category_changes(*_sets(spark, d), "region")


@query(
    "shared_categories",
    f"""WITH i AS (SELECT count(*) AS n FROM ({_SET_A} INTERSECT {_SET_B})), a AS (SELECT count(*) AS n FROM {_SET_A}), b AS (SELECT count(*) AS n FROM {_SET_B})
        SELECT a.n AS n_train, b.n AS n_test, i.n AS n_shared, round(100.0 * i.n / a.n, 6) AS overlap_pct, CASE WHEN 100.0 * i.n / a.n > 90 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS level FROM i, a, b""",
)
def shared_categories(spark, d):
    return _round(sets.category_overlap(*_sets(spark, d), "region"))


@query("distinct_values", f"SELECT DISTINCT product FROM {TXN_SQL}")
def distinct_values(spark, d):
    return txn(spark, d).select("product").distinct()


# --- sources and sinks -------------------------------------------------------------------


@query("csv_scan", f"SELECT id, key, product, amt, y FROM {TXN_SQL}")
def csv_scan(spark, d):
    path = work_path(spark, "csv")
    txn(spark, d).select("id", "key", "product", "amt", "y").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "id long, key long, product string, amt double, y int", 5)


@query("csv_contract", "SELECT * FROM (VALUES ('id'), ('amt'), ('y')) t(header)")
def csv_contract(spark, d):
    path = work_path(spark, "csv")
    txn(spark, d).select("id", "amt", "y").write.option("header", True).csv(path)
    names = readers.check_csv(spark, path, 3)
    written = readers.read_csv(spark, path, "id long, amt double, y int")
    return written.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("header")).distinct()


@query("pruned_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def pruned_parquet_scan(spark, d):
    wanted = readers.read_columns(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice", "o_missing"])
    return wanted.filter("o_totalprice > 400000")


@query(
    "limited_ingest",
    "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000) GROUP BY 1",
)
def limited_ingest(spark, d):
    _, lines = readers.limited_ingest(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", 1000)
    return lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("versioned_feature_sink", f"SELECT key, n_txn, max_amt FROM {_KEY_VIEW}")
def versioned_feature_sink(spark, d):
    base = work_path(spark, "features")
    view = store.FeatureView("customer", "key", ("n_txn", "max_amt"), "v1")
    return store.ingest(_key_view(spark, d).withColumn("extra", F.lit(1)), view, base)


@query(
    "family_sink",
    f"SELECT id, round(ln(1 + amt), 6) AS log_amount, dt // 86400 AS day FROM {TXN_SQL}",
)
def family_sink(spark, d):
    df = txn(spark, d)
    families = {"amount": df.select("id", rounded(F.log1p("amt")).alias("log_amount")), "time": df.select("id", F.floor(F.col("dt") / 86400).alias("day"))}
    return sinks.write_families(families, work_path(spark, "families"), "v1", "id")


@query("report_sink", f"SELECT product, count(*) AS n FROM {TXN_SQL} GROUP BY 1")
def report_sink(spark, d):
    report = txn(spark, d).groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    path = sinks.write_report(report, work_path(spark, "report"), "json")
    return spark.read.schema("product string, n long").json(path)


@query(
    "keyed_upsert",
    f"""SELECT key, CASE WHEN key % 3 = 0 THEN n_txn + 100 ELSE n_txn END AS n_txn, max_amt FROM {_KEY_VIEW}
        UNION ALL SELECT CAST(-1 AS BIGINT), count(*), max(max_amt) FROM {_KEY_VIEW}""",
)
def keyed_upsert(spark, d):
    base = work_path(spark, "upsert")
    sinks.write_features(_key_view(spark, d), base, "customer", "v1")
    current = spark.read.parquet(sinks.feature_path(base, "customer", "v1"))
    changed = current.filter("key % 3 = 0").withColumn("n_txn", F.col("n_txn") + 100)
    added = current.agg(F.count(F.lit(1)).alias("n_txn"), F.max("max_amt").alias("max_amt")).withColumn("key", F.lit(-1).cast("long"))
    return store.upsert_version(spark, base, "customer", "v1", "v2", changed.unionByName(added), "key")


@query(
    "key_lookup",
    f"SELECT c_custkey AS key, CAST(c_custkey * 7 % 1000 AS BIGINT) AS ordinal, n_txn FROM customer LEFT JOIN {_KEY_VIEW} v ON v.key = c_custkey ORDER BY ordinal",
)
def key_lookup(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 7 % 1000).alias("ordinal"))
    return store.lookup(_key_view(spark, d), keys, "key", "ordinal", ["n_txn"])


def _registry(spark, d):
    """One view per user: its features are the event types the user has."""
    users = table(spark, d, "events").groupBy("user_id").agg(
        F.array_sort(F.collect_set("event_type")).alias("features"), F.count(F.lit(1)).alias("n")
    )
    return users.select(
        F.concat(F.lit("user_"), F.col("user_id")).alias("name"), F.lit("user_id").alias("entity"), "features",
        F.concat(F.lit("v"), F.col("n") % 3).alias("version"), F.lit("").alias("description"),
        F.struct(F.lit("events").alias("source"), F.lit("ingest").alias("stage")).alias("lineage"),
        F.array(F.lit("reviewed")).alias("tags"),
    )


_VIEWS = """(SELECT 'user_' || user_id AS name, 'user_id' AS entity, 'v' || (count(*) % 3) AS version, 'ingest' AS stage,
    list_sort(list(DISTINCT event_type)) AS features FROM events GROUP BY user_id)"""


@query(
    "feature_catalog",
    f"SELECT name, entity, version, stage, CAST(generate_subscripts(features, 1) - 1 AS INTEGER) AS position, unnest(features) AS feature FROM {_VIEWS}",
)
def feature_catalog(spark, d):
    path = work_path(spark, "registry")
    store.save_registry(_registry(spark, d), path)
    return store.feature_catalog(store.load_registry(spark, path))


@query("catalog_search", f"SELECT name, version FROM {_VIEWS} WHERE regexp_matches(name, '(?i)R_1') OR NOT list_contains(features, 'view')")
def catalog_search(spark, d):
    registry = _registry(spark, d)
    lacking = registry.filter(~F.array_contains("features", "view"))
    found = store.search_views(registry.select("name", "version", F.array(F.lit("x")).alias("features")), "R_1")
    return found.select("name", "version").unionByName(lacking.select("name", "version")).distinct()


@query("catalog_feature_search", f"SELECT name, version FROM {_VIEWS} WHERE regexp_matches(array_to_string(features, ' '), '(?i)SIGNUP|purch')")
def catalog_feature_search(spark, d):
    return store.search_views(_registry(spark, d), "SIGNUP|purch").select("name", "version")


@query("newest_view_versions", f"SELECT entity, max(version) AS version FROM {_VIEWS} GROUP BY 1")
def newest_view_versions(spark, d):
    by_entity = _registry(spark, d).withColumn("name", F.col("entity"))
    return store.newest_versions(by_entity).select("entity", "version")


@query(
    "feature_documents",
    f"SELECT name, '## ' || name || ' (' || version || ')' || chr(10) || '- ' || array_to_string(features, chr(10) || '- ') AS markdown FROM {_VIEWS}",
)
def feature_documents(spark, d):
    return store.view_documents(_registry(spark, d)).select("name", "markdown")


@query("feature_view_gate", "SELECT 'n_txn' AS feature, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_infinite, false AS is_constant, 'PASS' AS status UNION ALL SELECT 'max_amt', 0, 0, false, 'PASS'")
def feature_view_gate(spark, d):
    return feature_gate(_key_view(spark, d), ["n_txn", "max_amt"])
