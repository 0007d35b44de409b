"""Training, importance-based selection, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import evaluate, explain, model
from riskloom.plans.profile_queries import _round
from riskloom.plans.registry import query
from riskloom.plans.views import TXN_SQL, line, table, txn

FEATURES = ["qty", "price", "disc", "tax", "linenumber"]
IDS = ["orderkey", "partkey", "suppkey", "linenumber"]


def learnable(spark, d):
    """Line items with a label that depends on quantity and discount, plus hashed noise."""
    noise = (F.pmod(F.xxhash64("orderkey", "partkey", "linenumber"), F.lit(1000)) / 1000.0 - 0.5) * 2.0
    z = (F.col("qty") - 25.5) / 15.0 + 12.0 * (F.col("disc") - 0.05) + noise
    return line(spark, d).withColumn("y", (z > 0).cast("int"))


def _parts(spark, d):
    df = learnable(spark, d)
    held = F.pmod(F.xxhash64("orderkey"), F.lit(5)) == 0
    return df.filter(~held), df.filter(held)


def _report(name, fitted, test):
    scored = model.score(fitted, test, FEATURES).select("y", "p")
    return evaluate.curve_metrics(evaluate.score_curve(scored)).withColumn("model", F.lit(name))


@query("logistic_baseline")
def logistic_baseline(spark, d):
    train, test = _parts(spark, d)
    return _report("logistic", model.fit_logistic(train, FEATURES), test)


@query("forest_model")
def forest_model(spark, d):
    train, test = _parts(spark, d)
    return _report("forest", model.fit_forest(train, FEATURES), test)


@query("boosted_model")
def boosted_model(spark, d):
    train, test = _parts(spark, d)
    return _report("boosted", model.fit_boosted(train, FEATURES), test)


@query("fit_and_validate")
def fit_and_validate(spark, d):
    return model.fit_and_validate(txn(spark, d).withColumn("half", F.col("key") % 2), ["amt", "half"], ["dt", "id"])


@query("retrained_model")
def retrained_model(spark, d):
    train, test = _parts(spark, d)
    return _report("retrained", model.fit_forest(train.unionByName(test), FEATURES, trees=30), test)


@query("scorer_smoke_check")
def scorer_smoke_check(spark, d):
    train, test = _parts(spark, d)
    return model.smoke_check(model.fit_logistic(train, FEATURES), test, FEATURES)


@query("batch_scoring")
def batch_scoring(spark, d):
    train, test = _parts(spark, d)
    scored = model.predict(model.fit_logistic(train, FEATURES), test, FEATURES)
    return scored.groupBy("fraud_label").agg(F.count(F.lit(1)).alias("n"), F.avg("fraud_probability").alias("mean_p"))


@query("stacked_model")
def stacked_model(spark, d):
    df = learnable(spark, d)
    _, scored = model.stacked(df, FEATURES, F.pmod(F.xxhash64("orderkey", "partkey"), F.lit(3)), 3)
    return evaluate.curve_metrics(evaluate.score_curve(scored.select("y", "p")))


@query("parameter_search")
def parameter_search(spark, d):
    return model.search(learnable(spark, d), FEATURES)


@query("best_trial")
def best_trial(spark, d):
    return model.best_trial(model.search(learnable(spark, d), FEATURES))


@query("reconstruction_anomalies")
def reconstruction_anomalies(spark, d):
    return model.reconstruction_error(table(spark, d, "embeddings"), "embedding").select("vec_id", "label", "error")


@query("perceptron_model")
def perceptron_model(spark, d):
    df = table(spark, d, "embeddings")
    fitted = model.fit_perceptron(df, "embedding", "label")
    from pyspark.ml.functions import array_to_vector

    scored = fitted.transform(df.withColumn("features", array_to_vector(F.transform("embedding", lambda v: v.cast("double")))))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


@query("monotonicity_probe")
def monotonicity_probe(spark, d):
    train, test = _parts(spark, d)
    return model.monotonicity_probe(model.fit_logistic(train, FEATURES), test, FEATURES, "qty", 5.0)


@query("perturbation_robustness")
def perturbation_robustness(spark, d):
    train, test = _parts(spark, d)
    return model.perturbation_robustness(model.fit_logistic(train, FEATURES), test, FEATURES, IDS)


@query("forest_importance")
def forest_importance(spark, d):
    return model.forest_importance(learnable(spark, d), FEATURES)


@query("weak_features")
def weak_features(spark, d):
    return model.weak_features(learnable(spark, d), FEATURES)


@query("permutation_importance")
def permutation_importance(spark, d):
    return model.permutation_importance(learnable(spark, d), FEATURES, IDS)


@query("recursive_elimination")
def recursive_elimination(spark, d):
    return model.recursive_elimination(learnable(spark, d), FEATURES, keep=2, step=0.5)


@query("shadow_selection")
def shadow_selection(spark, d):
    return model.shadow_selection(learnable(spark, d), FEATURES, IDS)


@query("importance_stability")
def importance_stability(spark, d):
    return model.importance_stability(learnable(spark, d), FEATURES, IDS)


# --- explanations ----------------------------------------------------------------------------

_WEIGHTS = {"amt": 1e-5, "dt": 2e-8, "key": -0.001}
_PARTS = f"""(WITH m AS (SELECT avg(amt) AS ma, avg(dt) AS md, avg(key) AS mk FROM {TXN_SQL})
    SELECT id, 'amt' AS feature, CAST(amt AS DOUBLE) AS value, (amt - ma) * 1e-5::DOUBLE AS contribution FROM {TXN_SQL}, m UNION ALL
    SELECT id, 'dt', dt::DOUBLE, (dt - md) * 2e-8::DOUBLE FROM {TXN_SQL}, m UNION ALL SELECT id, 'key', key::DOUBLE, (key - mk) * (-0.001)::DOUBLE FROM {TXN_SQL}, m)"""


def _contributions(spark, d):
    return explain.contributions(txn(spark, d), _WEIGHTS, ["id"])


@query("local_contributions", f"SELECT id, feature, value, round(contribution, 6) AS contribution FROM {_PARTS}")
def local_contributions(spark, d):
    return _round(_contributions(spark, d))


@query("global_importance", f"SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs, round(avg(abs(contribution)) / sum(avg(abs(contribution))) OVER (), 6) AS importance FROM {_PARTS} GROUP BY 1")
def global_importance(spark, d):
    return _round(explain.global_importance(_contributions(spark, d)))


@query(
    "waterfall_steps",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, feature) AS step FROM {_PARTS}),
        e AS (SELECT *, 0.5 + sum(contribution) OVER (PARTITION BY id ORDER BY step) AS e FROM r WHERE step <= 2)
        SELECT id, feature, value, round(contribution, 6) AS contribution, CAST(step AS INTEGER) AS step, round(e, 6) AS end_value, round(e - contribution, 6) AS start_value FROM e""",
)
def waterfall_steps(spark, d):
    return _round(explain.waterfall(_contributions(spark, d), ["id"], 0.5, 2))


@query(
    "contribution_forces",
    f"SELECT id, feature, value, round(contribution, 6) AS contribution, CASE WHEN contribution > 0 THEN 'positive' ELSE 'negative' END AS direction FROM {_PARTS} WHERE contribution <> 0",
)
def contribution_forces(spark, d):
    return _round(explain.forces(_contributions(spark, d)))


@query("model_contributions")
def model_contributions(spark, d):
    df = learnable(spark, d)
    weights = explain.linear_weights(model.fit_logistic(df, FEATURES), FEATURES)
    return explain.global_importance(explain.contributions(df, weights, IDS[:1]))


@query("partial_dependence")
def partial_dependence(spark, d):
    train, test = _parts(spark, d)
    return explain.partial_dependence(model.fit_forest(train, FEATURES), test, FEATURES, "qty", 10)


@query("individual_curves")
def individual_curves(spark, d):
    train, test = _parts(spark, d)
    curves = explain.individual_curves(model.fit_logistic(train, FEATURES), test, FEATURES, "disc", ["orderkey"], 5)
    return curves.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_score"))


@query("partial_dependence_2d")
def partial_dependence_2d(spark, d):
    train, test = _parts(spark, d)
    return explain.partial_dependence_2d(model.fit_logistic(train, FEATURES), test, FEATURES, ("qty", "disc"), 4)


@query("surrogate_rules")
def surrogate_rules(spark, d):
    train, test = _parts(spark, d)
    return explain.surrogate_rules(model.fit_forest(train, FEATURES), test, FEATURES)
