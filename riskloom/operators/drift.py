"""Distribution comparison of two frames: PSI variants, total variation, KS.

All PSI variants share one counting step and one divergence step; what differs
(edges, closed side, smoothing, renormalisation) is an argument.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.bands import classify
from riskloom.functions.binning import unique_edges
from riskloom.functions.scalars import numeric_columns
from riskloom.functions.tails import ks_sf
from riskloom.operators.aggregates import few_valued, wide_aggregate
from riskloom.operators.bins import Edges, add_bins
from riskloom.operators.ordered import prefix_sums
from riskloom.operators.quantiles import exact_quantiles
from riskloom.operators.rows import with_row

EPS = 1e-4


@dataclass(frozen=True)
class PsiRule:
    """How a PSI variant bins and smooths."""

    closed: str = "left"
    open_ends: bool = False
    renormalise: bool = True
    #: "zeros" replaces only empty bins, "all" lifts every share to at least EPS.
    smooth: str = "zeros"
    min_rows: int = 1
    #: Columns with at most this many values are compared value by value.
    categorical_up_to: int = 0


#: Decile histogram inside the train range; values outside are dropped.
HISTOGRAM = PsiRule()
#: Open ends, left-closed, at least ten rows.
OPEN_LEFT = PsiRule(open_ends=True, min_rows=10)
#: Open ends, right-closed, no renormalisation, few-valued columns as categories.
MONITOR = PsiRule(closed="right", open_ends=True, renormalise=False, categorical_up_to=10)
#: Categories with smoothing of empty ones, at least ten rows.
CATEGORY = PsiRule(min_rows=10)
#: Joint cells: every share at least EPS, no renormalisation.
CELLS = PsiRule(renormalise=False, smooth="all")


def two_sided(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both frames stacked with ``side`` 0 for train and 1 for test."""
    a = train.select(*columns).withColumn("side", F.lit(0))
    return a.unionByName(test.select(*columns).withColumn("side", F.lit(1)))


def side_counts(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).agg(
        F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).cast("long").alias("n_train"),
        F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).cast("long").alias("n_test"),
    )


def divergence(cells: DataFrame, totals: DataFrame, rule: PsiRule, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """PSI per feature from ``(feature, cell, n_train, n_test)`` and the row totals."""
    keys = list(keys)

    def share(n: str, total: str) -> Column:
        raw = F.col(n) / F.col(total)
        return F.greatest(raw, F.lit(EPS)) if rule.smooth == "all" else F.when(F.col(n) == 0, EPS).otherwise(raw)

    staged = cells.join(F.broadcast(totals), keys).filter((F.col("t_train") > 0) & (F.col("t_test") > 0))
    staged = staged.withColumns({"p": share("n_train", "t_train"), "q": share("n_test", "t_test")})
    if rule.renormalise:
        sums = staged.groupBy(*keys).agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
        staged = staged.join(F.broadcast(sums), keys).withColumns({"p": F.col("p") / F.col("sp"), "q": F.col("q") / F.col("sq")})
    psi = staged.groupBy(*keys).agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))
    few = (F.col("t_train") < rule.min_rows) | (F.col("t_test") < rule.min_rows)
    value = F.when(few, 0.0).otherwise(F.coalesce(F.col("psi"), F.lit(0.0)))
    return totals.join(psi, keys, "left").select(*keys, value.alias("psi"))


def _edges(train: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    q = exact_quantiles(train, columns, [i / bins for i in range(bins + 1)])
    return {c: unique_edges(v) for c, v in q.items()}


def numeric_psi(
    train: DataFrame, test: DataFrame, columns: Sequence[str], rule: PsiRule = HISTOGRAM, bins: int = 10
) -> DataFrame:
    """PSI of many numeric columns: one quantile job, one counting job.

    Edges come from the train frame.  The cell grid (columns x bins) is known on
    the driver, so bins empty on both sides still take part.
    """
    columns = list(columns)
    edges = _edges(train, columns, bins)
    as_category = few_valued(train, columns, rule.categorical_up_to) if rule.categorical_up_to else set()

    specs = {}
    for c in columns:
        e = edges[c]
        if c not in as_category and len(e) >= 2:
            specs[c] = Edges([-math.inf, *e[1:-1], math.inf] if rule.open_ends else e, rule.closed)
    binned = add_bins(two_sided(train, test, columns), specs)

    def cell(c: str) -> Column:
        if c in as_category:
            return F.col(c).cast("string")
        if c not in specs:
            return F.when(F.col(c).isNotNull(), F.lit("0"))
        return F.when(F.col(c).isNotNull(), F.coalesce(F.col(f"__bin_{c}").cast("string"), F.lit("out")))

    rows = F.array(*[F.struct(F.lit(c).alias("feature"), cell(c).alias("cell")) for c in columns])
    long = binned.select("side", F.explode(rows).alias("r")).select("side", "r.*").filter("cell IS NOT NULL")
    counts = side_counts(long, ["feature", "cell"])
    totals = counts.groupBy("feature").agg(F.sum("n_train").alias("t_train"), F.sum("n_test").alias("t_test"))
    grid = [(c, str(i)) for c in columns if c not in as_category for i in range(max(1, len(edges[c]) - 1))]
    found = counts.filter("cell <> 'out'")
    if grid:
        full = train.sparkSession.createDataFrame(grid, "feature string, cell string")
        found = full.join(found, ["feature", "cell"], "full_outer").fillna(0, ["n_train", "n_test"])
    return divergence(found, totals, rule)


def categorical_psi(train: DataFrame, test: DataFrame, columns: Sequence[str], rule: PsiRule = CATEGORY) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("cell")) for c in columns])
    long = two_sided(train, test, columns).select("side", F.explode(rows).alias("r")).select("side", "r.*").filter("cell IS NOT NULL")
    counts = side_counts(long, ["feature", "cell"])
    totals = counts.groupBy("feature").agg(F.sum("n_train").alias("t_train"), F.sum("n_test").alias("t_test"))
    return divergence(counts, totals, rule)


def total_variation(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Half the L1 distance of category shares, with new and vanished categories."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("cell")) for c in columns])
    long = two_sided(train, test, columns).select("side", F.explode(rows).alias("r")).select("side", "r.*").filter("cell IS NOT NULL")
    counts = side_counts(long, ["feature", "cell"])
    totals = counts.groupBy("feature").agg(F.sum("n_train").alias("t_train"), F.sum("n_test").alias("t_test"))
    p = F.coalesce(F.try_divide(F.col("n_train"), F.col("t_train")), F.lit(0.0))
    q = F.coalesce(F.try_divide(F.col("n_test"), F.col("t_test")), F.lit(0.0))
    return (
        counts.join(F.broadcast(totals), "feature").groupBy("feature")
        .agg(
            (F.sum(F.abs(p - q)) / 2.0).alias("tv_distance"),
            F.sum((F.col("n_train") == 0).cast("long")).alias("new_categories"),
            F.sum((F.col("n_test") == 0).cast("long")).alias("missing_categories"),
        )
        .withColumn("stability", classify("tv_stability", "tv_distance"))
    )


# --- Kolmogorov-Smirnov -----------------------------------------------------------------


def sided_value_counts(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
    """``(feature, value, n0, n1)``: non-null values of each column counted per side."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.col(side).alias("__s"), F.explode(rows).alias("r")).select("__s", "r.*")
    return (
        long.filter(F.col("value").isNotNull() & F.col("__s").isNotNull()).groupBy("feature", "value")
        .agg(
            F.sum((F.col("__s") == 0).cast("long")).alias("n0"),
            F.sum((F.col("__s") == 1).cast("long")).alias("n1"),
        )
    )


def running_counts(df: DataFrame, columns: Sequence[str], side: str, *, rows_per_block: int | None = None) -> DataFrame:
    """``sided_value_counts`` with ``c0`` and ``c1``, the rows of each side up to the value; KS and rank tests can share it."""
    counts = sided_value_counts(df, columns, side)
    return prefix_sums(counts, ["feature"], ["value"], {"c0": F.col("n0"), "c1": F.col("n1")}, rows_per_block=rows_per_block)


def ks_by_side(
    df: DataFrame, columns: Sequence[str], side: str, *, rows_per_block: int | None = None, running: DataFrame | None = None
) -> DataFrame:
    """Two-sample KS of each column between side 0 and side 1 on the full data.

    Works on value counts with block-wise running sums; ``running`` are those of ``running_counts``, if they are there.
    """
    running = running_counts(df, columns, side, rows_per_block=rows_per_block) if running is None else running
    totals = running.groupBy("feature").agg(F.sum("n0").alias("m0"), F.sum("n1").alias("m1"))
    gap = F.abs(F.try_divide(F.col("c0"), F.col("m0")) - F.try_divide(F.col("c1"), F.col("m1")))
    stats = running.join(F.broadcast(totals), "feature").groupBy("feature").agg(
        F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"), F.max("m0").alias("n0"), F.max("m1").alias("n1")
    )
    n, m = F.col("n0").cast("double"), F.col("n1").cast("double")
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    return stats.withColumns(
        {
            "ks_p": F.when(both, ks_sf("ks", n, m)).otherwise(1.0),
            "ks_critical": F.when(both, F.lit(1.36) * F.sqrt((n + m) / (n * m))),
        }
    )


def ks_two_sample(train: DataFrame, test: DataFrame, columns: Sequence[str], *, rows_per_block: int | None = None) -> DataFrame:
    return ks_by_side(two_sided(train, test, columns), columns, "side", rows_per_block=rows_per_block)


# --- reports ------------------------------------------------------------------------------


def moment_drift(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute change of mean, median, std and missing share per column."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        medians = exact_quantiles(df, columns, [0.5])
        lookup = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(medians[c][0]))])
        out = wide_aggregate(
            df, columns,
            {
                f"mean_{tag}": lambda c: F.avg(c),
                f"std_{tag}": lambda c: F.stddev_samp(c),
                f"missing_{tag}": lambda c: F.avg(F.col(c).isNull().cast("double")) * 100.0,
            },
        )
        return out.withColumn(f"median_{tag}", lookup[F.col("feature")])

    both = side(train, "a").join(side(test, "b"), "feature")
    diff = lambda s: F.abs(F.col(f"{s}_a") - F.col(f"{s}_b")).alias(f"{s}_diff")
    return both.select("feature", diff("mean"), diff("median"), diff("std"), diff("missing"))


def drift_report(train: DataFrame, test: DataFrame, columns: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """PSI, KS and status of every shared column."""
    out = numeric_psi(train, test, columns, MONITOR).join(
        ks_two_sample(train, test, columns).select("feature", "ks", "ks_p"), "feature", "left"
    )
    if texts:
        other = categorical_psi(train, test, texts, PsiRule(renormalise=False)).withColumns({"ks": F.lit(0.0), "ks_p": F.lit(1.0)})
        out = out.unionByName(other)
    return out.withColumn("status", classify("drift_report", "psi"))


def stability_report(psi: DataFrame, ks: DataFrame) -> DataFrame:
    """Score, severity, priority and probable cause per feature."""
    joined = psi.join(ks.select("feature", "ks"), "feature", "left")
    base = F.lit(100.0) * (F.lit(1.0) - F.least(F.lit(1.0), F.col("psi")))
    score = F.greatest(F.lit(0.0), base - F.coalesce(F.col("ks"), F.lit(0.0)) * 10.0)
    out = joined.withColumn("stability", score).withColumn("class", classify("stability_class", "stability"))
    level = (
        F.when((F.col("psi") < 0.05) & (F.col("stability") >= 95), 0)
        .when(F.col("psi") < 0.10, 1).when(F.col("psi") < 0.20, 2).when(F.col("psi") < 0.35, 3).otherwise(4)
    )
    out = out.withColumn("__l", level)
    pick = lambda *labels: F.get(F.array(*[F.lit(x) for x in labels]), F.col("__l"))
    return out.withColumns(
        {
            "severity": pick("NO DRIFT", "MINOR DRIFT", "MODERATELY DRIFTED", "MAJOR DRIFT", "CRITICAL DRIFT"),
            "priority": pick("LOW", "LOW", "MEDIUM", "HIGH", "IMMEDIATE ACTION"),
            "risk_score": pick(0, 2, 5, 8, 10),
            "cause": pick("normal variance", "normal variance", "temporal shift", "population change", "definition decay"),
        }
    ).drop("__l")


def data_drift_monitor(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.2) -> DataFrame:
    columns = list(columns or [c for c in numeric_columns(reference) if c in current.columns])
    return numeric_psi(reference, current, columns, MONITOR).withColumn("is_drifted", F.col("psi") >= limit)


def concept_drift(reference: DataFrame, current: DataFrame, target: str, limit: float = 0.05) -> DataFrame:
    a = reference.agg(F.avg(target).alias("reference_rate"))
    b = current.agg(F.avg(target).alias("current_rate"))
    gap = F.abs(F.col("reference_rate") - F.col("current_rate"))
    return a.transform(with_row, b).withColumns({"rate_change": gap, "is_drifted": gap > limit})


def prediction_drift(reference: DataFrame, current: DataFrame, p: str, limit: float = 0.1) -> DataFrame:
    psi = numeric_psi(reference, current, [p], MONITOR).select("psi")
    means = reference.agg(F.avg(p).alias("reference_mean")).transform(with_row, current.agg(F.avg(p).alias("current_mean")))
    return psi.transform(with_row, means).withColumn("is_drifted", F.col("psi") >= limit)


def alerts(data_drift: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """Alert rows ``(alert, severity, message)`` from metric frames."""
    one = data_drift.agg(F.sum(F.col("is_drifted").cast("long")).alias("k")).filter("k > 0")
    out = one.select(
        F.lit("DataDriftDetected").alias("alert"), F.lit("WARNING").alias("severity"),
        F.format_string("Severe data drift detected in %d features.", F.col("k")).alias("message"),
    )
    if health is not None:
        bad = health.filter("is_unhealthy").select(
            F.lit("FeatureHealth").alias("alert"), F.lit("CRITICAL").alias("severity"),
            F.concat(F.lit("Too many nulls in "), F.col("feature")).alias("message"),
        )
        out = out.unionByName(bad)
    return out


def retrain_trigger(metrics: DataFrame) -> DataFrame:
    """Retrain when data drifted or the model decayed."""
    return metrics.withColumn("retrain", F.col("has_drift") | F.col("has_decay"))


def feature_drift_gate(train: DataFrame, test: DataFrame, columns: Sequence[str], limit: float = 0.25) -> DataFrame:
    return numeric_psi(train, test, columns, HISTOGRAM).withColumn("is_drifted", F.col("psi") > limit)


def governance_audit(train: DataFrame, test: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Null share over 5 %, zero variance or PSI over .25 fails a feature."""
    columns = list(columns)
    base = wide_aggregate(
        train, columns,
        {
            "null_ratio": lambda c: F.avg(F.col(c).isNull().cast("double")),
            "variance": lambda c: F.coalesce(F.var_pop(F.col(c).cast("double")), F.lit(0.0)),
        },
    )
    out = base.join(numeric_psi(train, test, columns, HISTOGRAM), "feature", "left")
    bad = (F.col("null_ratio") > 0.05) | (F.col("variance") == 0) | (F.col("psi") > 0.25)
    return out.withColumns(
        {"status": F.when(bad, "FAIL").otherwise("PASS"), "tag": F.when(bad, "CRITICAL").otherwise("OK")}
    )
