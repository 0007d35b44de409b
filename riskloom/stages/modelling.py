"""Training, evaluation, scoring and monitoring stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import drift, encode, evaluate, explain, model, quality
from riskloom.operators.rows import with_row
from riskloom.operators.sets import stack
from riskloom.session import cut_lineage


def train_and_compare(df: DataFrame, features: Sequence[str], order: Sequence[str]) -> dict[str, DataFrame]:
    """Time-ordered holdout, three models, then comparison, thresholds, calibration and champion."""
    parts = cut_lineage(encode.time_holdout(df, order))
    train, test = parts.filter("role = 'train'"), parts.filter("role = 'test'")
    fitted = {
        "logistic": model.fit_logistic(train, features),
        "forest": model.fit_forest(train, features),
        "boosted": model.fit_boosted(train, features),
    }
    scored = stack({n: model.score(m, test, features).select("y", "p") for n, m in fitted.items()}, "model")
    comparison = evaluate.compare_models(scored)
    sweep = evaluate.threshold_sweep(scored, ["model"])
    return {
        "comparison": comparison, "thresholds": evaluate.best_thresholds(sweep, ["model"]), "champion": evaluate.champion(comparison),
        "calibration": evaluate.calibration(scored.filter("model = 'logistic'")),
    }


def cross_validate(df: DataFrame, features: Sequence[str], order: Sequence[str], folds: int = 3) -> DataFrame:
    """Expanding-window folds along time, one logistic fit and AUC per fold."""
    marked = cut_lineage(encode.time_folds(df, order, folds))
    rows = []
    for k in range(folds):
        part = marked.filter(F.col("fold") == k)
        fitted = model.fit_logistic(part.filter("role = 'train'"), features)
        rows.append((k, model.auc(model.score(fitted, part.filter("role = 'test'"), features))))
    return df.sparkSession.createDataFrame(rows, "fold int, roc_auc double")


def evaluation_reports(scored: DataFrame, amount: str, ids: Sequence[str], ties: Sequence[str]) -> dict[str, DataFrame]:
    curve = evaluate.score_curve(scored)
    return {
        "curve": evaluate.curve_metrics(curve), "threshold": evaluate.threshold_metrics(scored), "calibration": evaluate.calibration(scored),
        "lift": evaluate.lift_gain(scored, ties), "sweep": evaluate.threshold_sweep(scored), "business": evaluate.business_value(scored, amount),
        "errors": evaluate.hard_errors(scored, ids), "error_summary": evaluate.error_summary(scored),
    }


def explanation_reports(fitted: Model, df: DataFrame, features: Sequence[str], ids: Sequence[str]) -> dict[str, DataFrame]:
    parts = explain.contributions(df, explain.linear_weights(fitted, features), ids)
    return {
        "importance": explain.global_importance(parts), "waterfall": explain.waterfall(parts, ids, 0.0), "forces": explain.forces(parts),
        "dependence": explain.partial_dependence(fitted, df, features, features[0]), "rules": explain.surrogate_rules(fitted, df, features),
    }


def monitoring_reports(reference: DataFrame, current: DataFrame, features: Sequence[str], target: str, baseline_auc: float) -> dict[str, DataFrame]:
    """Drift, concept drift, prediction drift, health, decay, alerts and the retrain decision."""
    data = drift.data_drift_monitor(reference, current, features)
    health = quality.feature_health(current, features, 0.1)
    decay = evaluate.performance_decay(
        evaluate.curve_metrics(evaluate.score_curve(current.select(F.col(target).alias("y"), "p"))).withColumn("model", F.lit("current")), baseline_auc
    )
    has_drift = data.agg(F.max("is_drifted").alias("has_drift"))
    return {
        "data": data, "concept": drift.concept_drift(reference, current, target), "prediction": drift.prediction_drift(reference, current, "p"),
        "health": health, "decay": decay, "alerts": drift.alerts(data, health),
        "retrain": drift.retrain_trigger(has_drift.transform(with_row, decay.select("has_decay"))),
    }
