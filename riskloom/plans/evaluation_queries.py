"""Model evaluation, monitoring metrics, selection, vectors and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import evaluate, vectors
from riskloom.operators import select as selection
from riskloom.operators.rows import with_row
from riskloom.plans.comparison_queries import _MI, _WCOLS, _WIDE, _wide, _pairs_sql
from riskloom.plans.profile_queries import _MISSING, _round, long_sql
from riskloom.plans.registry import query
from riskloom.plans.views import (
    DOC_SQL, EV_SQL, LINE_SQL, MODEL_SCORES_SQL, SCORES_SQL, TXN_SQL, doc, ev, line, model_scores, scores, table, txn,
)

_CURVE = f"""(WITH c AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM {SCORES_SQL} GROUP BY 1)
    SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER ()::DOUBLE AS tot_p, sum(neg) OVER ()::DOUBLE AS tot_n FROM c)"""


def _lam_p(ks: str, n: str, m: str) -> str:
    lam = f"({ks} * sqrt({n} * {m} / ({n} + {m})))"
    return f"CASE WHEN {lam} < 0.2 THEN 1.0 ELSE greatest(0, least(1, (SELECT sum((CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * k * k * {lam} * {lam})) FROM range(1, 101) t(k)))) END"


@query(
    "curve_metrics",
    f"""WITH s AS (SELECT sum(neg * (tp - pos / 2.0)) / (any_value(tot_p) * any_value(tot_n)) AS auc, sum(pos * tp / (tp + fp)) / any_value(tot_p) AS ap, max(abs(tp / tot_p - fp / tot_n)) AS ks,
        arg_max(p, (abs(tp / tot_p - fp / tot_n), p)) AS t, any_value(tot_p) AS n, any_value(tot_n) AS m FROM {_CURVE})
        SELECT round(auc, 6) AS roc_auc, round(ap, 6) AS pr_auc, round(ks, 6) AS ks, t AS ks_threshold, round({_lam_p('ks', 'n', 'm')}, 6) AS ks_p FROM s""",
)
def curve_metrics(spark, d):
    return _round(evaluate.curve_metrics(evaluate.score_curve(evaluate.validated(scores(spark, d)))))


@query(
    "roc_pr_curve",
    f"SELECT p AS threshold, round(fp / tot_n, 6) AS fpr, round(tp / tot_p, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM {_CURVE}",
)
def roc_pr_curve(spark, d):
    return _round(evaluate.curve_points(evaluate.score_curve(scores(spark, d))))


def _metrics_sql(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""(WITH c AS (SELECT {k}count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
        count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn FROM {source} {group}),
        r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
        SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0) AS f2, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
        coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0) AS mcc, fp / (fp + tn) AS fpr, fn / (fn + tp) AS fnr,
        coalesce(fp / nullif(fp + tp, 0), 0) AS fdr, coalesce(tn / nullif(tn + fn, 0), 0) AS npv FROM r)"""


_RATES = ["precision", "recall", "f1", "f2", "accuracy", "mcc", "fpr", "fnr", "fdr", "npv"]


@query("threshold_metrics", f"SELECT tp, fp, tn, fn, {', '.join(f'round({c}, 6) AS {c}' for c in _RATES)} FROM {_metrics_sql(SCORES_SQL)}")
def threshold_metrics(spark, d):
    return _round(evaluate.threshold_metrics(scores(spark, d)))


def _bin_case(op: str) -> str:
    edges = [i * 0.1 for i in range(10)] + [1.0]
    if op == ">=":
        return "CASE WHEN p = 1.0 THEN 9 ELSE " + " + ".join(f"(p >= {e!r}::DOUBLE)::INT" for e in edges) + " - 1 END"
    return "CASE WHEN p = 0.0 THEN 0 ELSE " + " + ".join(f"(p > {e!r}::DOUBLE)::INT" for e in edges) + " - 1 END"


@query(
    "calibration",
    f"""WITH b AS (SELECT {_bin_case('>=')} AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM {SCORES_SQL} GROUP BY 1)
        SELECT round((SELECT avg((p - y) * (p - y)) FROM {SCORES_SQL}), 6) AS brier, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b""",
)
def calibration(spark, d):
    return _round(evaluate.calibration(scores(spark, d)))


@query(
    "reliability_curve",
    f"SELECT CAST({_bin_case('>')} AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS observed_rate FROM {SCORES_SQL} GROUP BY 1",
)
def reliability_curve(spark, d):
    return _round(evaluate.reliability_curve(scores(spark, d)))


@query(
    "lift_gain_deciles",
    f"""WITH r AS (SELECT y, row_number() OVER (ORDER BY p DESC, orderkey, linenumber, y) - 1 AS i FROM {SCORES_SQL}), n AS (SELECT count(*) - 1 AS m, sum(y) AS pos FROM {SCORES_SQL}),
        c AS (SELECT greatest(1, (i * 10 + m - 1) // m) AS decile, count(*) AS n, sum(y)::BIGINT AS positives FROM r, n GROUP BY 1)
        SELECT decile, c.n, positives, round(sum(positives) OVER (ORDER BY decile) / pos, 6) AS cumulative_gain, round((positives / c.n) / (pos / (m + 1)), 6) AS lift FROM c, n""",
)
def lift_gain_deciles(spark, d):
    return _round(evaluate.lift_gain(scores(spark, d), ["orderkey", "linenumber", "y"]))


def _sweep_sql(beta: float) -> str:
    b = beta * beta
    return f"""(WITH g AS (SELECT unnest(range(1, 100)) AS k), h AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM {SCORES_SQL} GROUP BY 1),
        c AS (SELECT k, sum(pos) FILTER (WHERE p >= k / 100.0::DOUBLE) AS tp, coalesce(sum(neg) FILTER (WHERE p >= k / 100.0::DOUBLE), 0) AS fp, coalesce(sum(pos) FILTER (WHERE p < k / 100.0::DOUBLE), 0) AS fn FROM h, g GROUP BY 1),
        r AS (SELECT k, coalesce(tp, 0) AS tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM c)
        SELECT k / 100.0::DOUBLE AS threshold, pr, re, coalesce({1 + b} * pr * re / nullif({b} * pr + re, 0), 0)::DOUBLE AS fbeta, (fp * 10 + fn * 100)::DOUBLE AS cost FROM r)"""


@query("threshold_sweep", f"SELECT threshold, round(pr, 6) AS precision, round(re, 6) AS recall, round(fbeta, 6) AS fbeta, cost FROM {_sweep_sql(1.0)}")
def threshold_sweep(spark, d):
    return _round(evaluate.threshold_sweep(scores(spark, d)))


@query(
    "best_thresholds",
    f"SELECT arg_min(threshold, (-fbeta, threshold)) AS best_threshold, round(max(fbeta), 6) AS best_score, arg_min(threshold, (cost, threshold)) AS cheapest_threshold, min(cost) AS lowest_cost FROM {_sweep_sql(2.0)}",
)
def best_thresholds(spark, d):
    return _round(evaluate.best_thresholds(evaluate.threshold_sweep(scores(spark, d), beta=2.0)))


@query(
    "business_value",
    f"""WITH s AS (SELECT sum(amount) FILTER (WHERE y = 1 AND p >= 0.5) AS prevented, sum(amount) FILTER (WHERE y = 1 AND p < 0.5) AS missed, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn,
        count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp FROM {SCORES_SQL})
        SELECT round(prevented, 2) AS prevented, round(missed + fn * 15, 2) AS missed_loss, (fp * 2)::DOUBLE AS fp_cost, ((tp + fp) * 2)::DOUBLE AS review_cost, round(prevented - (fp * 2 + (tp + fp) * 2), 2) AS net_savings FROM s""",
)
def business_value(spark, d):
    return _round(evaluate.business_value(scores(spark, d), "amount"), 2)


@query(
    "hard_errors",
    f"""SELECT * FROM (SELECT 'false_positive' AS kind, orderkey, linenumber, amount, p FROM {SCORES_SQL} WHERE y = 0 AND p >= 0.5 ORDER BY p DESC, orderkey, linenumber, amount LIMIT 10)
        UNION ALL SELECT * FROM (SELECT 'false_negative', orderkey, linenumber, amount, p FROM {SCORES_SQL} WHERE y = 1 AND p < 0.5 ORDER BY p, orderkey, linenumber, amount LIMIT 10)""",
)
def hard_errors(spark, d):
    return evaluate.hard_errors(scores(spark, d), ["orderkey", "linenumber", "amount"])


@query(
    "error_summary",
    f"""SELECT count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS false_positives, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS false_negatives,
        round(avg(p) FILTER (WHERE y = 0 AND p >= 0.5), 6) AS mean_fp_score, round(avg(p) FILTER (WHERE y = 1 AND p < 0.5), 6) AS mean_fn_score FROM {SCORES_SQL}""",
)
def error_summary(spark, d):
    return _round(evaluate.error_summary(scores(spark, d)))


_AUCS = f"""(WITH c AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM {MODEL_SCORES_SQL} GROUP BY 1, 2),
    r AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS tp, sum(pos) OVER (PARTITION BY model)::DOUBLE AS a, sum(neg) OVER (PARTITION BY model)::DOUBLE AS b FROM c)
    SELECT model, sum(neg * (tp - pos / 2.0)) / (any_value(a) * any_value(b)) AS auc FROM r GROUP BY 1)"""


@query(
    "model_comparison",
    f"SELECT model, round(auc, 6) AS roc_auc, {', '.join(f'round({c}, 6) AS {c}' for c in ('accuracy', 'precision', 'recall', 'f1', 'f2'))} FROM {_AUCS} JOIN {_metrics_sql(MODEL_SCORES_SQL, 'model')} USING (model)",
)
def model_comparison(spark, d):
    return _round(evaluate.compare_models(model_scores(spark, d)))


@query("champion_model", f"SELECT arg_min(model, (-auc, model)) AS champion, round(max(auc), 6) AS roc_auc FROM {_AUCS}")
def champion_model(spark, d):
    return _round(evaluate.champion(evaluate.compare_models(model_scores(spark, d))))


@query("performance_decay", f"SELECT model, round(auc, 6) AS roc_auc, round(0.53 - auc, 6) AS decay, 0.53 - auc > 0.03 AS has_decay FROM {_AUCS}")
def performance_decay(spark, d):
    return _round(evaluate.performance_decay(evaluate.compare_models(model_scores(spark, d)), 0.53, 0.03))


@query(
    "champion_challenger",
    f"""SELECT round(a, 6) AS current_auc, round(b, 6) AS challenger_auc, round(b - a, 6) AS gain, b - a >= 0.001 AS promote
        FROM (SELECT max(auc) FILTER (WHERE model = 'amount') AS a, max(auc) FILTER (WHERE model = 'discount') AS b FROM {_AUCS})""",
)
def champion_challenger(spark, d):
    return _round(evaluate.promotion(evaluate.compare_models(model_scores(spark, d)), "amount", "discount", 0.001))


_SERVICE = f"""(SELECT count(*) AS requests, count(*) / (max(dt) - min(dt))::DOUBLE AS per_second, avg(y) AS error_rate, quantile_cont(amt, 0.5) AS p50, quantile_cont(amt, 0.95) AS p95, quantile_cont(amt, 0.99) AS p99 FROM {EV_SQL})"""


def _service(spark, d):
    return evaluate.service_metrics(ev(spark, d), "amt", F.col("y") == 1, F.col("dt"))


@query("service_metrics", f"SELECT requests, round(per_second, 6) AS per_second, round(error_rate, 6) AS error_rate, round(p50, 4) AS p50, round(p95, 4) AS p95, round(p99, 4) AS p99 FROM {_SERVICE}")
def service_metrics(spark, d):
    return _round(_service(spark, d), p50=4, p95=4, p99=4)


@query("release_gate", f"SELECT model, round(auc, 6) AS roc_auc, round(p95, 4) AS p95, CASE WHEN auc >= 0.5 AND p95 <= 500 THEN 'PASS' ELSE 'FAIL' END AS status FROM {_AUCS}, {_SERVICE}")
def release_gate(spark, d):
    metrics = evaluate.compare_models(model_scores(spark, d)).select("model", "roc_auc").transform(with_row, _service(spark, d).select("p95"))
    return _round(evaluate.release_gate(metrics, 0.5, 500.0), p95=4)


@query(
    "group_fairness",
    f"""WITH g AS (SELECT linenumber, count(*) AS n, avg((p >= 0.5)::INT) AS r, coalesce(avg((p >= 0.5)::INT) FILTER (WHERE y = 1), 0) AS tpr, coalesce(avg((p >= 0.5)::INT) FILTER (WHERE y = 0), 0) AS fpr FROM {SCORES_SQL} GROUP BY 1)
        SELECT linenumber, n, round(r, 6) AS positive_rate, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round((SELECT min(r) / max(r) FROM g), 6) AS impact_ratio, (SELECT min(r) / max(r) FROM g) >= 0.8 AS is_fair FROM g""",
)
def group_fairness(spark, d):
    return _round(evaluate.fairness(scores(spark, d), "linenumber"))


_BLEND = f"""(SELECT orderkey, linenumber, qty, price, disc, y, round(1/(1+exp(-((price-50000)/30000))), 6) AS a, round(1/(1+exp(-(40*(disc-0.05)))), 6) AS b, round(1/(1+exp(-((qty-25.5)/10))), 6) AS c FROM {LINE_SQL})"""


def _scored(spark, d):
    logistic = lambda z: F.round(1.0 / (1.0 + F.exp(-z)), 6)
    return line(spark, d).select(
        "orderkey", "linenumber", "qty", "price", "disc", "y", logistic((F.col("price") - 50000) / 30000).alias("a"),
        logistic(40 * (F.col("disc") - 0.05)).alias("b"), logistic((F.col("qty") - 25.5) / 10).alias("c"),
    )


@query("weighted_blend", f"SELECT orderkey, linenumber, qty, price, disc, round((0.4 * a + 0.3 * b + 0.3 * c) / 1.0, 9) AS p, CAST((0.4 * a + 0.3 * b + 0.3 * c) / 1.0 >= 0.5 AS INTEGER) AS label FROM {_BLEND}")
def weighted_blend(spark, d):
    p = evaluate.blend(_scored(spark, d), ["a", "b", "c"], [0.4, 0.3, 0.3])
    return _scored(spark, d).select("orderkey", "linenumber", "qty", "price", "disc", F.round(p, 9).alias("p"), (p >= 0.5).cast("int").alias("label"))


@query("pseudo_labels", f"SELECT orderkey, linenumber, qty, price, disc, CASE WHEN c >= 0.9 THEN 1 ELSE 0 END AS pseudo_label FROM {_BLEND} WHERE c >= 0.9 OR c <= 0.1")
def pseudo_labels(spark, d):
    out = evaluate.pseudo_labels(_scored(spark, d), "c", 0.9, 0.1)
    return out.select("orderkey", "linenumber", "qty", "price", "disc", "pseudo_label")


@query("fallback_scores", f"SELECT doc_id, CAST(coalesce(CASE WHEN quality = 1 THEN 0.9 END, CASE WHEN toxic = 1 THEN 0.4 END, 0.05) AS DOUBLE) AS p FROM {DOC_SQL}")
def fallback_scores(spark, d):
    primary = F.when(F.col("quality") == 1, 0.9)
    fallback = F.when(F.col("toxic") == 1, 0.4)
    return doc(spark, d).select("doc_id", evaluate.fallback_score(primary, fallback).alias("p"))


# --- selection -------------------------------------------------------------------------------


@query("null_selector", f"SELECT feature, round(missing_pct / 100, 6) AS ratio, missing_pct / 100 <= 0.05 AS keep FROM {_MISSING}")
def null_selector(spark, d):
    df = doc(spark, d)
    return _round(selection.null_selector(df, df.columns))


_SEL = f"(SELECT qty, price, 1.0::DOUBLE AS flat, disc * 0.01 AS faint FROM {LINE_SQL})"


def _sel(spark, d):
    return line(spark, d).select("qty", "price", F.lit(1.0).alias("flat"), (F.col("disc") * 0.01).alias("faint"))


@query("variance_selector", f"SELECT feature, round(var_pop(value), 4) AS variance, var_pop(value) > 0 AS keep FROM {long_sql(_SEL, ['qty', 'price', 'flat', 'faint'], 'DOUBLE')} GROUP BY 1")
def variance_selector(spark, d):
    return _round(selection.variance_selector(_sel(spark, d), ["qty", "price", "flat", "faint"]), 4)


@query("interaction_variance_filter", f"SELECT feature, round(var_samp(value), 4) AS variance, var_samp(value) >= 0.01 AS keep FROM {long_sql(_SEL, ['qty', 'price', 'flat', 'faint'], 'DOUBLE')} GROUP BY 1")
def interaction_variance_filter(spark, d):
    return _round(selection.variance_selector(_sel(spark, d), ["qty", "price", "flat", "faint"], 0.01, sample=True), 4)


_COLS = ", ".join(f"'{c}'" for c in _WCOLS)


@query(
    "correlation_selector",
    f"""WITH v AS (SELECT feature, var_pop(value) AS v FROM {long_sql(_WIDE, _WCOLS, 'DOUBLE')} GROUP BY 1),
        x AS (SELECT DISTINCT CASE WHEN a.v >= b.v THEN "right" ELSE "left" END AS feature FROM {_pairs_sql(_WIDE, _WCOLS)} JOIN v a ON a.feature = "left" JOIN v b ON b.feature = "right" WHERE abs(r) > 0.95)
        SELECT v.feature, round(v, 4) AS variance, x.feature IS NULL AS keep FROM v LEFT JOIN x ON v.feature = x.feature""",
)
def correlation_selector(spark, d):
    out = selection.correlation_selector(_wide(spark, d), _WCOLS)
    return _round(out, 4)


@query("information_selector", f"SELECT feature, round(mi, 8) AS mi, round(mi / max(mi) OVER (), 4) AS score, mi / max(mi) OVER () >= 0.5 AS keep FROM {_MI}")
def information_selector(spark, d):
    return _round(selection.information_selector(line(spark, d), ["qty", "price", "disc", "tax"], "y", 0.5), mi=8, score=4)


@query(
    "selector_chain",
    "SELECT * FROM (VALUES (1, 'variance', 'flat'), (2, 'correlation', 'qty2')) t(step, selector, feature)",
)
def selector_chain(spark, d):
    df = line(spark, d).select("qty", "price", "disc", F.lit(1.0).alias("flat"), (F.col("qty") * 0.5).alias("qty2"))
    steps = [
        ("nulls", lambda f, c: selection.dropped(selection.null_selector(f, c))),
        ("variance", lambda f, c: selection.dropped(selection.variance_selector(f, c))),
        ("correlation", lambda f, c: selection.dropped(selection.correlation_selector(f, c))),
    ]
    return selection.run_chain(df, df.columns, steps)[1]


@query("selection_gate", f"SELECT count(*) AS n_rows, 2 AS n_features FROM {TXN_SQL}")
def selection_gate(spark, d):
    df = txn(spark, d).select((F.col("amt") + F.col("y") * 9000).alias("amt"), (F.col("dt") + F.col("y") * 5_000_000).alias("dt"), "y")
    selection.selection_gate(df, ["amt", "dt"], "y")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(2).alias("n_features"))


# --- vectors and audits ---------------------------------------------------------------------------


@query(
    "averaged_vectors",
    "SELECT label, pos, round(avg(v), 6) AS value FROM (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1, 2",
)
def averaged_vectors(spark, d):
    means = vectors.average_vectors(table(spark, d, "embeddings"), "embedding", ["label"])
    return _round(means.select("label", F.posexplode("mean_vector").alias("pos", "value")))


@query(
    "dataset_fingerprint",
    f"SELECT count(*) AS n_rows, 7 AS n_columns, sum((quality IS NULL)::INT + (toxic IS NULL)::INT)::BIGINT AS missing_cells, true AS order_insensitive FROM {DOC_SQL}",
)
def dataset_fingerprint(spark, d):
    df = doc(spark, d)
    here = vectors.dataset_fingerprint(df)
    shuffled = vectors.dataset_fingerprint(df.orderBy(F.col("doc_id").desc())).select(F.col("fingerprint").alias("other"))
    return here.transform(with_row, shuffled).select("n_rows", "n_columns", "missing_cells", (F.col("fingerprint") == F.col("other")).alias("order_insensitive"))


@query(
    "audit_chain",
    """WITH e AS (SELECT user_id AS chain, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM events)
        SELECT chain, position, 'changed content' AS problem FROM e WHERE position = 1 AND event_id % 10 = 3
        UNION ALL SELECT chain, 0, 'broken link' FROM e WHERE position = 0 AND event_id % 10 = 4""",
)
def audit_chain(spark, d):
    # The log of each user holds all of the user's events.
    events = table(spark, d, "events").select("event_id", F.col("user_id").alias("chain"), "event_type", "value")
    log = events.select(
        "chain", "event_id", F.col("event_id").cast("string").alias("ts"),
        F.col("chain").cast("string").alias("user"), F.col("event_type").alias("action"), F.col("value").cast("string").alias("resource"), F.lit("SUCCESS").alias("status"),
    )
    chain = vectors.hash_chain(log, "event_id")
    # Tamper: one kind of row loses its content, another its link.
    changed = F.when((F.col("position") == 1) & (F.col("event_id") % 10 == 3), "FAILURE").otherwise(F.col("status"))
    unlinked = F.when((F.col("position") == 0) & (F.col("event_id") % 10 == 4), F.lit("f" * 64)).otherwise(F.col("previous_hash"))
    return vectors.verify_chain(chain.withColumns({"status": changed, "previous_hash": unlinked}), "position")


@query(
    "unified_report",
    f"""SELECT 'scores' AS module, unnest(['brier', 'ece']) AS metric, unnest([round(brier, 6), round(ece, 6)]) AS value FROM (WITH b AS (SELECT {_bin_case('>=')} AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM {SCORES_SQL} GROUP BY 1)
        SELECT (SELECT avg((p - y) * (p - y)) FROM {SCORES_SQL}) AS brier, sum(n * abs(acc - conf)) / sum(n) AS ece FROM b)
        UNION ALL SELECT 'rows', 'n', count(*)::DOUBLE FROM {TXN_SQL}""",
)
def unified_report(spark, d):
    return _round(vectors.report_table({"scores": evaluate.calibration(scores(spark, d)), "rows": txn(spark, d).agg(F.count(F.lit(1)).alias("n"))}))
