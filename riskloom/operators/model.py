"""Model training and scoring with Spark ML."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, Bucketizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import finite
from riskloom.operators import aggregates, blocks, encode
from riskloom.operators.evaluate import curve_metrics, score_curve, threshold_metrics
from riskloom.operators.ordered import with_ordinal
from riskloom.operators.sets import bootstrap
from riskloom.session import cut_lineage, held

LABEL = "y"
SEED = 42
#: Rows of one task of a forest, which holds some 300 bytes for each of them.
TASK_ROWS = 500_000
#: Tables of more rows are trained on weighted cells.
WHOLE_ROWS = 1_000_000
#: Rows that settle the thresholds of the bins; Spark itself takes 10,000.
SAMPLE_ROWS = 200_000
BINS = 32
CELL_TASKS = 32


def _clean(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(finite(f), F.lit(0.0)) for f in features})


def _chain(features: Sequence[str], estimator, *, scale: bool = False) -> Pipeline:
    assembled = "__raw" if scale else "features"
    stages = [VectorAssembler(inputCols=list(features), outputCol=assembled)]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, estimator])


def fit_logistic(df: DataFrame, features: Sequence[str], label: str = LABEL) -> Model:
    return _chain(features, LogisticRegression(labelCol=label, maxIter=50), scale=True).fit(_clean(df, features))


def _thresholds(values: np.ndarray, most: int = BINS - 1) -> list[float]:
    """At most ``most`` midpoints between neighbouring values, spread evenly over the rows."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) <= most:
        return middles.tolist()
    below = np.cumsum(counts)
    targets = below[-1] * np.arange(1, most + 1) / (most + 1)
    return middles[np.unique(np.abs(below[:-1] - targets[:, None]).argmin(axis=1))].tolist()


def _binner(sample: np.ndarray, features: Sequence[str]) -> PipelineModel:
    """Bin numbers ``__b_<feature>`` of every feature, between thresholds of a sample."""
    splits = [[-math.inf, *(_thresholds(sample[:, i]) or [0.0]), math.inf] for i in range(len(features))]
    bins = Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=[f"__raw_{f}" for f in features])
    # A sum drops the bucketizer's mark of a category: bins are ordered numbers.
    plain = ", ".join(f"`__raw_{f}` + 0.0D AS `__b_{f}`" for f in features)
    return PipelineModel([bins, SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__")])


def _spread(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Partitions of at most about ``task_rows`` rows; partitions small enough stay as they are."""
    sizes = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    return rows if (sizes["most"] or 0) <= task_rows else rows.repartition(math.ceil(sizes["n"] / task_rows))


def _fit_trees(df: DataFrame, features: Sequence[str], label: str, estimator, *, bagged: bool, whole_rows: int | None = None) -> Model:
    """Fit on all rows; above ``whole_rows`` rows on the cells of equal bins and label, weighted by their rows.

    Trees look at a feature only through its 32 bins, so cells lose nothing for
    boosting. Bootstrap draws of a forest stay as fine as those of a table of
    ``whole_rows`` rows: a large cell is cut into that many equal pieces, each
    drawn on its own. Thresholds come from a sample, as in Spark. Where bins
    hardly repeat, cells save nothing and the rows themselves are used.
    """
    whole_rows = whole_rows or WHOLE_ROWS
    names = list(dict.fromkeys(features))
    with held(_clean(df.select(label, *[f for f in names if f != label]), names)) as rows:
        n = rows.count()
        if n <= whole_rows:
            return _chain(features, estimator).fit(rows)
        sample = rows.select(*names).sample(min(1.0, SAMPLE_ROWS / n), seed=SEED).toPandas().to_numpy(dtype=float)
        binner = _binner(sample, names)
        bins = [f"__b_{f}" for f in names]
        edges = [s[1:-1] for s in binner.stages[0].getSplitsArray()]
        codes = np.stack([np.searchsorted(e, sample[:, i], side="right") for i, e in enumerate(edges)], axis=1)
        if len(np.unique(codes, axis=0)) > 0.95 * len(codes):
            return _chain(features, estimator).fit(_spread(rows))
        cells = binner.transform(rows).groupBy(label, *bins).agg(F.count(F.lit(1)).cast("double").alias("__w"))
        if bagged:
            pieces = F.greatest(F.lit(1), F.ceil(F.col("__w") * (whole_rows / n))).cast("int")
            cells = cells.withColumn("__w", F.explode(F.array_repeat(F.col("__w") / pieces, pieces)))
        with held(cells) as kept:
            spread = kept.repartition(max(CELL_TASKS, math.ceil(kept.count() / TASK_ROWS)))
            chain = _chain([f"__b_{f}" for f in features], estimator.copy().setWeightCol("__w"))
            fitted = chain.fit(spread)
    return PipelineModel([*binner.stages, *fitted.stages])


def fit_forest(df: DataFrame, features: Sequence[str], label: str = LABEL, trees: int = 50, depth: int = 6) -> Model:
    rf = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED)
    return _fit_trees(df, features, label, rf, bagged=True)


# Depth and step of the boosting presets.
BOOST_PRESETS = {"shallow": (5, 0.1), "deep": (6, 0.1)}


def fit_boosted(df: DataFrame, features: Sequence[str], label: str = LABEL, rounds: int = 100, preset: str = "shallow") -> Model:
    depth, step = BOOST_PRESETS[preset]
    gbt = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=SEED)
    return _fit_trees(df, features, label, gbt, bagged=False)


def fit_tree(df: DataFrame, features: Sequence[str], label: str = LABEL, depth: int = 5) -> Model:
    return _chain(features, DecisionTreeClassifier(labelCol=label, maxDepth=depth, seed=SEED)).fit(_clean(df, features))


def score(model: Model, df: DataFrame, features: Sequence[str], out: str = "p") -> DataFrame:
    """Add the probability of class 1; the work columns of the model are dropped."""
    # The clean copies are scored under the model's names, the input stays as it is.
    staged = _clean(df.withColumn("__row", F.struct(*df.columns)), features)
    scored = model.transform(staged)
    p = vector_to_array("probability")[1]
    return scored.select("__row.*", p.alias(out))


def predict(model: Model, df: DataFrame, features: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Batch scoring: probability and label for every row."""
    return score(model, df, features, "fraud_probability").withColumn(
        "fraud_label", (F.col("fraud_probability") >= threshold).cast("int")
    )


def auc(scored: DataFrame) -> float:
    return curve_metrics(score_curve(scored.select("y", "p"))).first()["roc_auc"]


def fit_and_validate(df: DataFrame, features: Sequence[str], order: Sequence[str], share: float = 0.8) -> DataFrame:
    """Time-ordered holdout, scaling by train statistics only, forest, metrics of both parts."""
    parts = encode.time_holdout(df, order, share)
    scaler = aggregates.fit_scaler(parts.filter("role = 'train'"), features)
    scaled = aggregates.standard_scale(parts, scaler)
    names = [f"{f}_z" for f in features]
    model = fit_forest(scaled.filter("role = 'train'"), names)
    scored = score(model, scaled, names).select("role", "y", "p")
    metrics = curve_metrics(score_curve(scored, ["role"]), ["role"]).select("role", "roc_auc", "pr_auc", "ks")
    return metrics.join(threshold_metrics(scored, 0.5, ["role"]).select("role", "accuracy"), "role")


def smoke_check(model: Model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One scored row: is the probability in [0, 1] and the label 0 or 1?"""
    one = predict(model, df.limit(1), features)
    ok = F.col("fraud_probability").between(0.0, 1.0) & F.col("fraud_label").isin(0, 1)
    return one.select("fraud_probability", "fraud_label", ok.alias("ok"))


def stacked(df: DataFrame, features: Sequence[str], fold: Column, folds: int = 3) -> tuple[Model, DataFrame]:
    """Out-of-fold base scores (forest and logistic), then a logistic on top of them."""
    staged = df.withColumn("__fold", fold)
    parts = None
    for k in range(folds):
        train, held = staged.filter(F.col("__fold") != k), staged.filter(F.col("__fold") == k)
        first = score(fit_forest(train, features, trees=20, depth=5), held, features, "s_forest")
        both = score(fit_logistic(train, features), first, features, "s_logistic")
        parts = both if parts is None else parts.unionByName(both)
    parts = cut_lineage(parts)  # the base scores are made once, not in every pass of the top model
    meta = fit_logistic(parts, ["s_forest", "s_logistic"])
    return meta, score(meta, parts, ["s_forest", "s_logistic"]).drop("__fold")


def search(df: DataFrame, features: Sequence[str], trials: int = 4, folds: int = 3, parallelism: int = 2) -> DataFrame:
    """Seeded random search with cross-validation: one row per trial, best first."""
    import random

    rng = random.Random(SEED)
    lr = LogisticRegression(labelCol=LABEL, maxIter=20)
    grid = [
        {lr.regParam: 10 ** rng.uniform(-4, 0), lr.elasticNetParam: rng.uniform(0, 1)} for _ in range(trials)
    ]
    chain = _chain(features, lr, scale=True)
    cv = CrossValidator(
        estimator=chain, estimatorParamMaps=grid, numFolds=folds, seed=SEED, parallelism=parallelism,
        evaluator=BinaryClassificationEvaluator(labelCol=LABEL),
    )
    fitted = cv.fit(_clean(df.select(LABEL, *[f for f in features if f != LABEL]), features))  # folds are kept in memory
    rows = [
        (i, float(g[lr.regParam]), float(g[lr.elasticNetParam]), float(m)) for i, (g, m) in enumerate(zip(grid, fitted.avgMetrics))
    ]
    return df.sparkSession.createDataFrame(rows, "trial int, reg double, elastic double, mean_auc double").orderBy(F.col("mean_auc").desc(), "trial")


def best_trial(trials: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("trial", "reg", "elastic", "mean_auc"), F.struct(-F.col("mean_auc"), F.col("trial"))).alias("b")
    return trials.agg(best).select("b.*")


def reconstruction_error(df: DataFrame, vector: str, k: int = 3) -> DataFrame:
    """Mean squared residual after projection on ``k`` principal axes.

    The axes are orthonormal, so the residual is |x|^2 - |z|^2.
    """
    staged = df.withColumn("__x", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    z = PCA(k=k, inputCol="__x", outputCol="__z").fit(staged).transform(staged)
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)
    residual = square(vector_to_array("__x")) - square(vector_to_array("__z"))
    return z.withColumn("error", F.greatest(F.lit(0.0), residual) / F.size(vector)).drop("__x", "__z")


def fit_perceptron(df: DataFrame, vector: str, label: str, hidden: int = 16, classes: int | None = None) -> Model:
    staged = df.withColumn("features", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    width = df.select(F.size(vector)).first()[0]
    classes = classes or int(df.agg(F.max(label)).first()[0]) + 1
    return MultilayerPerceptronClassifier(labelCol=label, layers=[width, hidden, classes], maxIter=30, seed=SEED).fit(staged)


def monotonicity_probe(model: Model, df: DataFrame, features: Sequence[str], feature: str, delta: float) -> DataFrame:
    """Share of rows whose score falls when ``feature`` grows by ``delta``."""
    base = score(model, df, features, "low")
    raised = base.withColumns({"__keep": F.col(feature), feature: F.col(feature) + delta})
    both = score(model, raised, features, "high")
    falls = (F.col("high") < F.col("low") - 1e-5).cast("double")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg("low").alias("mean_low"), F.avg("high").alias("mean_high"), F.avg(falls).alias("violations"))


def perturbation_robustness(model: Model, df: DataFrame, features: Sequence[str], ids: Sequence[str], noise: float = 0.05, seed: int = SEED) -> DataFrame:
    """Shift of the score under Gaussian noise of ``noise`` standard deviations.

    The noise is made from a hash of the row (Box-Muller), so a task that runs
    again draws the same numbers.
    """
    scaler = aggregates.fit_scaler(df, features)
    unit = lambda i: (F.pmod(F.xxhash64(*ids, F.lit(seed + i)), F.lit(1_000_003)) + 1) / F.lit(1_000_005.0)
    normal = lambda i: F.sqrt(-2.0 * F.log(unit(2 * i))) * F.cos(2.0 * F.pi() * unit(2 * i + 1))
    base = score(model, df, features, "p0")
    noisy = base.withColumns({f: F.col(f) + normal(i) * (noise * scaler[f][1]) for i, f in enumerate(features)})
    both = score(model, noisy, features, "p1")
    gap = F.abs(F.col("p0") - F.col("p1"))
    return both.agg(F.avg(gap).alias("mean_shift"), F.max(gap).alias("max_shift")).withColumn("robustness", F.lit(1.0) - F.col("mean_shift"))


# --- importance-based selection ------------------------------------------------------------


def _importance_rows(df: DataFrame, features: Sequence[str], values: Sequence[float], limit: float) -> DataFrame:
    top = max(values) or 1.0
    rows = [(f, float(v), float(v / top), bool(v / top >= limit)) for f, v in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, score double, keep boolean")


def forest_importance(df: DataFrame, features: Sequence[str], limit: float = 0.05, trees: int = 30, depth: int = 6) -> DataFrame:
    forest = fit_forest(df, features, trees=trees, depth=depth).stages[-1]
    return _importance_rows(df, features, forest.featureImportances.toArray(), limit)


def weak_features(df: DataFrame, features: Sequence[str], limit: float = 0.01, depth: int = 5) -> DataFrame:
    tree = fit_tree(df, features, depth=depth).stages[-1]
    out = _importance_rows(df, features, tree.featureImportances.toArray(), 0.0).select("feature", "importance")
    return out.withColumn("is_weak", F.col("importance") < limit)


def shuffled_copies(df: DataFrame, columns: Sequence[str], ids: Sequence[str], seeds: Sequence[int], label: str = LABEL) -> Iterator[DataFrame]:
    """For each seed, label and ``columns`` of every row with the ``columns`` of another row, as ``shadow_*``.

    Both orders are numbered block-wise and joined on the position, so the
    shuffle is a distributed permutation that repeats for the same seed. The
    rows' own order is numbered once for all seeds; ids enter as hashes only,
    rows of one hash are told apart by their values. A copy lasts until the
    next one is asked for.
    """
    columns = [c for c in columns if c != label]
    shadows = [F.col(c).alias(f"shadow_{c}") for c in columns]
    left = with_ordinal(df.select(F.xxhash64(*ids).alias("__a"), label, *columns), ["__a", *columns], "__i").drop("__a")
    with held(left.repartition("__i")) as own:
        for seed in seeds:
            other = df.select(F.xxhash64(*ids, F.lit(seed)).alias("__b"), *shadows)
            right = with_ordinal(other, ["__b", *[f"shadow_{c}" for c in columns]], "__i").drop("__b")
            with held(own.join(right, "__i").drop("__i")) as both:
                yield both


def _score_edges(model: Model, features: Sequence[str]) -> list[list[float]]:
    """Per feature the values from which on a forest's score may differ: rows between the same edges score the same."""
    found: list[set[float]] = [set() for _ in features]
    splits = [s.getSplitsArray() for s in model.stages if isinstance(s, Bucketizer)]
    for i, last in re.findall(r"feature (\d+) <= ([^)]+)\)", model.stages[-1].toDebugString):
        i, last = int(i), float(last)
        found[i].add(splits[0][i][math.floor(last) + 1] if splits else float(np.nextafter(last, math.inf)))
    return [sorted(edges) for edges in found]


def permutation_importance(df: DataFrame, features: Sequence[str], ids: Sequence[str], repeats: int = 3) -> DataFrame:
    """Loss of AUC when one column is shuffled, averaged over repeats.

    One shuffled copy per repeat serves all columns, and one curve job with the
    swapped column as its key evaluates them. All rows are paired and counted as
    codes between the forest's thresholds; each combination of codes is scored once.
    """
    model = fit_forest(df, features, trees=30)
    edges = _score_edges(model, features)

    def aucs(pairs: DataFrame, *, swapped: bool) -> dict[str, float]:
        cells = blocks.cells(pairs, features, edges, LABEL, swapped=swapped)
        with held(score(model, cells, features).select("feature", F.col(LABEL).alias("y"), "p", "__n")) as scored:
            curve = score_curve(scored, ["feature"], times="__n")
            return {row["feature"]: row["roc_auc"] for row in curve_metrics(curve, ["feature"]).select("feature", "roc_auc").collect()}

    sums = {f: 0.0 for f in features}
    copies = blocks.shuffled_blocks(df, features, ids, [SEED + r for r in range(repeats)], LABEL, df.count(), lambda _: edges)
    (base,) = aucs(next(copies)[0], swapped=False).values()
    for both, _ in copies:
        for feature, shuffled in aucs(both, swapped=True).items():
            sums[feature] += base - shuffled
        del both
    rows = [(f, s / repeats) for f, s in sums.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, auc_drop double")


def recursive_elimination(df: DataFrame, features: Sequence[str], keep: int = 1, step: float = 0.3) -> DataFrame:
    """Drop the least important share of the columns until ``keep`` are left; score is 1/rank."""
    left, rank, ranks = list(features), len(features), {}
    while len(left) > keep:
        forest = fit_forest(df, left, trees=20, depth=5).stages[-1]
        order = sorted(zip(forest.featureImportances.toArray(), left))
        for _, f in order[: max(1, int(len(left) * step))]:
            if len(left) > keep:
                ranks[f] = rank
                rank -= 1
                left.remove(f)
    ranks |= {f: 1 for f in left}
    rows = [(f, ranks[f], 1.0 / ranks[f], 1.0 / ranks[f] >= 0.05) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, score double, keep boolean")


def _shadow_importances(df: DataFrame, features: Sequence[str], ids: Sequence[str], seeds: Sequence[int], trees: int = 20, depth: int = 5) -> Iterator[np.ndarray]:
    """For each seed the importances of the features and of their shadows, in a forest over all rows.

    Above ``WHOLE_ROWS`` rows the bins of pairs hardly repeat, and Spark's
    forest would hold some 300 bytes for each; it is grown on blocks of codes.
    """
    size = df.agg(F.count(F.lit(1)).alias("n"), F.max(LABEL).alias("top")).first()
    if size["n"] <= WHOLE_ROWS:
        shadows = [f"shadow_{f}" for f in features]
        for both in shuffled_copies(df, features, ids, seeds):
            yield fit_forest(both, [*features, *shadows], trees=trees, depth=depth).stages[-1].featureImportances.toArray()
        return
    copies = blocks.shuffled_blocks(df, features, ids, seeds, LABEL, size["n"], lambda sample: [_thresholds(values) for values in sample])
    next(copies)
    for seed, (both, edges) in zip(seeds, copies):
        with held(both) as pairs:
            yield blocks.forest_importances(pairs, 2 * len(features), max(map(len, edges)) + 1, int(size["top"]) + 1, trees, depth, seed)
        del both, pairs


def shadow_selection(df: DataFrame, features: Sequence[str], ids: Sequence[str], rounds: int = 5, limit: float = 0.05) -> DataFrame:
    """Share of rounds in which a column beats every shuffled shadow column.

    The shadows of one round come from the same shuffled row, which breaks their
    link with the label and keeps the links among them.
    """
    hits = {f: 0 for f in features}
    for values in _shadow_importances(df, features, ids, [SEED + r for r in range(rounds)]):
        bar = max(values[len(features) :])
        for f, v in zip(features, values):
            hits[f] += int(v > bar)
    rows = [(f, h / rounds, h / rounds >= limit) for f, h in hits.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, hit_rate double, keep boolean")


def importance_stability(df: DataFrame, features: Sequence[str], ids: Sequence[str], rounds: int = 5) -> DataFrame:
    """Mean and spread of forest importance over bootstrap samples."""
    rows = []
    for r in range(rounds):
        forest = fit_forest(bootstrap(df, ids, SEED + r), features, trees=20, depth=5).stages[-1]
        rows += [(f, float(v)) for f, v in zip(features, forest.featureImportances.toArray())]
    runs = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return runs.groupBy("feature").agg(F.avg("importance").alias("mean_importance"), F.stddev_pop("importance").alias("std_importance"))
