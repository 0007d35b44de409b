"""Explanations: additive contributions, importance, waterfall, partial dependence, rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.model import fit_tree, score
from riskloom.operators.quantiles import exact_quantiles
from riskloom.operators.rows import with_row


def linear_weights(model: Model, features: Sequence[str]) -> dict[str, float]:
    """Weights on the raw columns of a scaled logistic model."""
    scaler, lr = model.stages[1], model.stages[2]
    return {f: float(b) / float(s or 1.0) for f, b, s in zip(features, lr.coefficients.toArray(), scaler.std.toArray())}


def contributions(df: DataFrame, weights: Mapping[str, float], ids: Sequence[str]) -> DataFrame:
    """weight x (value - mean) per row and column: exact for a linear score."""
    means = df.agg(*[F.avg(c).alias(c) for c in weights]).first()
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                ((F.col(c).cast("double") - F.lit(means[c])) * w).alias("contribution"),
            )
            for c, w in weights.items()
        ]
    )
    return df.select(*ids, F.explode(rows).alias("r")).select(*ids, "r.*")


def global_importance(parts: DataFrame) -> DataFrame:
    """Mean absolute contribution per column, scaled to sum to 1."""
    means = parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    total = means.agg(F.sum("mean_abs").alias("t"))
    share = F.coalesce(F.try_divide(F.col("mean_abs"), F.col("t")), F.lit(0.0))
    return means.transform(with_row, total).select("feature", "mean_abs", share.alias("importance"))


def waterfall(parts: DataFrame, ids: Sequence[str], base: float, top: int = 10) -> DataFrame:
    """Steps of the ``top`` contributions from the base value, largest first.

    The windows run within one explained row, which has one entry per column.
    """
    order = Window.partitionBy(*ids).orderBy(F.abs("contribution").desc(), "feature")
    ranked = parts.withColumn("step", F.row_number().over(order)).filter(F.col("step") <= top)
    upto = Window.partitionBy(*ids).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    end = F.lit(base) + F.sum("contribution").over(upto)
    return ranked.withColumn("end_value", end).withColumn("start_value", F.col("end_value") - F.col("contribution"))


def forces(parts: DataFrame) -> DataFrame:
    """Contributions split by sign; zeros push neither way."""
    return parts.filter("contribution <> 0").withColumn("direction", F.when(F.col("contribution") > 0, "positive").otherwise("negative"))


def _grid(df: DataFrame, feature: str, points: int) -> list[float]:
    low, high = exact_quantiles(df, [feature], [0.05, 0.95])[feature]
    return [low + (high - low) * i / (points - 1) for i in range(points)]


def _on_grid(df: DataFrame, feature: str, grid: Sequence[float]) -> DataFrame:
    # Each row meets every grid value: an explode of a short literal array.
    return df.withColumn(feature, F.explode(F.array(*[F.lit(float(g)) for g in grid])))


def partial_dependence(model: Model, df: DataFrame, features: Sequence[str], feature: str, points: int = 20) -> DataFrame:
    if feature not in features:
        raise ValueError(f"unknown feature {feature!r}")
    spread = _on_grid(df.select(*features), feature, _grid(df, feature, points))
    return score(model, spread, features).groupBy(F.col(feature).alias("value")).agg(F.avg("p").alias("mean_score"))


def individual_curves(model: Model, df: DataFrame, features: Sequence[str], feature: str, ids: Sequence[str], points: int = 15) -> DataFrame:
    """One curve per row."""
    spread = _on_grid(df.select(*ids, *[f for f in features if f not in ids]), feature, _grid(df, feature, points))
    return score(model, spread, features).select(*ids, F.col(feature).alias("value"), "p")


def partial_dependence_2d(model: Model, df: DataFrame, features: Sequence[str], pair: tuple[str, str], points: int = 10) -> DataFrame:
    a, b = pair
    spread = _on_grid(_on_grid(df.select(*features), a, _grid(df, a, points)), b, _grid(df, b, points))
    return score(model, spread, features).groupBy(F.col(a).alias("value_1"), F.col(b).alias("value_2")).agg(F.avg("p").alias("mean_score"))


def surrogate_rules(model: Model, df: DataFrame, features: Sequence[str], depth: int = 3) -> DataFrame:
    """A shallow tree that imitates the model: its rules and its agreement."""
    labelled = score(model, df.select(*features), features, "p").withColumn("pseudo", (F.col("p") >= 0.5).cast("int"))
    tree = fit_tree(labelled, features, "pseudo", depth)
    both = score(tree, labelled, features, "q")
    rules = tree.stages[-1].toDebugString
    for i in reversed(range(len(features))):
        rules = rules.replace(f"feature {i} ", f"{features[i]} ")
    agree = F.avg(((F.col("q") > 0.5).cast("int") == F.col("pseudo")).cast("double"))
    return both.agg(agree.alias("fidelity")).withColumns({"depth": F.lit(depth), "rules": F.lit(rules)})
