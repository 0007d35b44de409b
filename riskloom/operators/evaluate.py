"""Model evaluation on ``(y, p[, amount])`` frames.

Curves work on counts per distinct score with block-wise running sums, so no
task ever sorts all rows; thresholds work on a histogram of 101 buckets.
Every function takes ``keys`` (for instance ``["model"]``) to evaluate several
scorers in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.binning import bin_index
from riskloom.functions.scalars import clip_probability, safe_divide
from riskloom.functions.tails import ks_sf
from riskloom.operators.ordered import prefix_sums, with_ordinal
from riskloom.operators.quantiles import exact_quantiles
from riskloom.operators.rows import with_row


def validated(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Clip scores to [0, 1]; a null label or score stops the job."""
    ok = F.col(y).isNotNull() & F.col(p).isNotNull()
    checked = F.when(F.assert_true(ok, "null label or score").isNull(), clip_probability(p))
    return df.withColumn(p, checked)


def score_curve(df: DataFrame, keys: Sequence[str] = (), *, times: str | None = None, rows_per_block: int | None = None) -> DataFrame:
    """One row per distinct score, from the highest: counts, running TP and FP, totals. A row counts ``times`` times."""
    keys = list(keys)
    y = F.col("y")
    pos, neg = (y, 1 - y) if times is None else (y * F.col(times), (1 - y) * F.col(times))
    counts = df.groupBy(*keys, "p").agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg")).withColumn("__down", -F.col("p"))
    running = prefix_sums(
        counts, keys, ["__down"], {"tp": F.col("pos"), "fp": F.col("neg")}, rows_per_block=rows_per_block
    ).drop("__down")
    totals = df.groupBy(*keys).agg(F.sum(pos).alias("all_pos"), F.sum(neg).alias("all_neg"))
    # One row per scorer.
    return running.join(F.broadcast(totals), keys) if keys else running.transform(with_row, totals)


def curve_points(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall coordinates, one row per threshold."""
    return curve.select(
        *keys, F.col("p").alias("threshold"),
        safe_divide("fp", "all_neg").alias("fpr"), safe_divide("tp", "all_pos").alias("tpr"),
        safe_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
    )


def curve_metrics(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties half), average precision (step), KS with its threshold and p-value."""
    d = lambda c: F.col(c).cast("double")
    gap = F.abs(safe_divide("tp", "all_pos") - safe_divide("fp", "all_neg"))
    sums = curve.groupBy(*keys).agg(
        F.sum(d("neg") * (d("tp") - d("pos") / 2.0)).alias("a"),
        F.sum(d("pos") * safe_divide("tp", F.col("tp") + F.col("fp"))).alias("ap"),
        F.max(gap).alias("ks"), F.max(F.struct(gap.alias("g"), F.col("p"))).alias("best"),
        F.max(d("all_pos")).alias("all_pos"), F.max(d("all_neg")).alias("all_neg"),
    )
    both = (F.col("all_pos") > 0) & (F.col("all_neg") > 0)
    return sums.select(
        *keys,
        F.when(both, F.try_divide(F.col("a"), F.col("all_pos") * F.col("all_neg"))).otherwise(0.5).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("ap"), F.col("all_pos"))).otherwise(0.0).alias("pr_auc"),
        F.when(both, F.col("ks")).otherwise(0.0).alias("ks"),
        F.when(both, F.col("best.p")).otherwise(0.5).alias("ks_threshold"),
        F.when(both, ks_sf("ks", "all_pos", "all_neg")).otherwise(1.0).alias("ks_p"),
    )


def _confusion(df: DataFrame, t: float, keys: Sequence[str]) -> DataFrame:
    hit = F.col("p") >= t
    count = lambda c: F.sum(c.cast("long"))
    return df.groupBy(*keys).agg(
        count((F.col("y") == 1) & hit).alias("tp"), count((F.col("y") == 0) & hit).alias("fp"),
        count((F.col("y") == 0) & ~hit).alias("tn"), count((F.col("y") == 1) & ~hit).alias("fn"),
    )


def _fbeta(beta: float) -> Column:
    b = beta * beta
    top = F.lit(1 + b) * F.col("precision") * F.col("recall")
    return safe_divide(top, F.lit(b) * F.col("precision") + F.col("recall"))


def threshold_metrics(df: DataFrame, t: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and every rate at one threshold."""
    d = lambda c: F.col(c).cast("double")
    tp, fp, tn, fn = d("tp"), d("fp"), d("tn"), d("fn")
    out = _confusion(df, t, keys).withColumns({"precision": safe_divide(tp, tp + fp), "recall": safe_divide(tp, tp + fn)})
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return out.withColumns(
        {
            "f1": _fbeta(1.0), "f2": _fbeta(2.0), "accuracy": safe_divide(tp + tn, tp + tn + fp + fn),
            "mcc": safe_divide(tp * tn - fp * fn, root),
            "fpr": safe_divide(fp, fp + tn), "fnr": safe_divide(fn, fn + tp),
            "fdr": safe_divide(fp, fp + tp), "npv": safe_divide(tn, tn + fn),
        }
    )


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error; left-closed bins, the last one closed."""
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    staged = df.withColumn("__bin", bin_index("p", edges, closed="left"))
    per_bin = staged.groupBy("__bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("acc"), F.avg("p").alias("conf"),
        F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"),
    )
    return per_bin.agg(
        (F.sum("sq") / F.sum("n")).alias("brier"),
        (F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"),
    )


def reliability_curve(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score against observed rate per right-closed bin."""
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    return (
        df.withColumn("bin", bin_index("p", edges, closed="right")).groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_score"), F.avg("y").alias("observed_rate"))
    )


def lift_gain(df: DataFrame, ties: Sequence[str], deciles: int = 10, *, rows_per_block: int | None = None) -> DataFrame:
    """Lift and cumulative gain of ``deciles`` equal slices from the highest score.

    ``ties`` orders rows of equal score; positions are assigned block-wise.
    """
    n = df.count()
    ranked = with_ordinal(df.withColumn("__down", -F.col("p")), ["__down", *ties], "__i", rows_per_block=rows_per_block)
    # Integer form of max(1, ceil(i * deciles / (n - 1))).
    step = max(1, n - 1)
    decile = F.greatest(F.lit(1).cast("long"), F.floor((F.col("__i") * deciles + (step - 1)) / step))
    cells = ranked.groupBy(decile.alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
    totals = cells.agg(F.sum("n").alias("all_n"), F.sum("positives").alias("all_p"))
    # One row per decile.
    upto = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = cells.withColumn("cum", F.sum("positives").over(upto))
    return running.transform(with_row, totals).select(
        "decile", "n", "positives", safe_divide("cum", "all_p").alias("cumulative_gain"),
        safe_divide(safe_divide("positives", "n"), safe_divide("all_p", "all_n")).alias("lift"),
    )


def threshold_sweep(df: DataFrame, keys: Sequence[str] = (), beta: float = 1.0, cost_fp: float = 10.0, cost_fn: float = 100.0) -> DataFrame:
    """Precision, recall, F-beta and cost at .01, .02, ... .99.

    Rows are reduced to 101 buckets first; only the buckets meet the thresholds.
    """
    keys = list(keys)
    guess = F.floor(F.col("p") * 100).cast("int")
    bucket = F.when(F.col("p") >= (guess + 1) / 100.0, guess + 1).when(F.col("p") < guess / 100.0, guess - 1).otherwise(guess)
    hist = df.groupBy(*keys, bucket.alias("b")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    above = F.col("b") >= F.col("k")
    swept = (
        hist.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(99)))).groupBy(*keys, "k")
        .agg(
            F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"),
        )
    )
    d = lambda c: F.col(c).cast("double")
    out = swept.withColumns({"precision": safe_divide(d("tp"), d("tp") + d("fp")), "recall": safe_divide(d("tp"), d("tp") + d("fn"))})
    return out.select(
        *keys, (F.col("k") / 100.0).alias("threshold"), "precision", "recall", _fbeta(beta).alias("fbeta"),
        (d("fp") * cost_fp + d("fn") * cost_fn).alias("cost"),
    )


def best_thresholds(sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First threshold with the best F-beta and first with the lowest cost."""
    t = F.col("threshold")
    return sweep.groupBy(*keys).agg(
        F.min_by("threshold", F.struct(-F.col("fbeta"), t)).alias("best_threshold"), F.max("fbeta").alias("best_score"),
        F.min_by("threshold", F.struct(F.col("cost"), t)).alias("cheapest_threshold"), F.min("cost").alias("lowest_cost"),
    )


def business_value(
    df: DataFrame, amount: str, t: float = 0.5, review: float = 2.0, fee: float = 15.0, *, count_fp_twice: bool = True
) -> DataFrame:
    """Money prevented, missed and spent on reviews at a threshold.

    The review cost of false positives is subtracted twice unless
    ``count_fp_twice`` is False.
    """
    hit, bad = F.col("p") >= t, F.col("y") == 1
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col(amount).cast("double"))), F.lit(0.0))
    count = lambda c: F.sum(c.cast("long"))
    one = df.agg(
        money(bad & hit).alias("prevented"), money(bad & ~hit).alias("missed_amount"), count(bad & ~hit).alias("fn"),
        count(~bad & hit).alias("fp"), count(bad & hit).alias("tp"),
    )
    fp_cost = F.col("fp") * review
    review_cost = (F.col("tp") + F.col("fp")) * review
    spent = fp_cost + review_cost if count_fp_twice else review_cost
    return one.select(
        "prevented", (F.col("missed_amount") + F.col("fn") * fee).alias("missed_loss"), fp_cost.alias("fp_cost"),
        review_cost.alias("review_cost"), (F.col("prevented") - spent).alias("net_savings"),
    )


def hard_errors(df: DataFrame, ids: Sequence[str], t: float = 0.5, k: int = 10) -> DataFrame:
    """The most confident false positives and false negatives."""
    fp = df.filter((F.col("y") == 0) & (F.col("p") >= t)).orderBy(F.col("p").desc(), *ids).limit(k).withColumn("kind", F.lit("false_positive"))
    fn = df.filter((F.col("y") == 1) & (F.col("p") < t)).orderBy("p", *ids).limit(k).withColumn("kind", F.lit("false_negative"))
    return fp.unionByName(fn).select("kind", *ids, "p")


def error_summary(df: DataFrame, t: float = 0.5) -> DataFrame:
    hit = F.col("p") >= t
    fp, fn = (F.col("y") == 0) & hit, (F.col("y") == 1) & ~hit
    return df.agg(
        F.sum(fp.cast("long")).alias("false_positives"), F.sum(fn.cast("long")).alias("false_negatives"),
        F.coalesce(F.avg(F.when(fp, F.col("p"))), F.lit(0.0)).alias("mean_fp_score"),
        F.coalesce(F.avg(F.when(fn, F.col("p"))), F.lit(0.0)).alias("mean_fn_score"),
    )


def compare_models(df: DataFrame, t: float = 0.5) -> DataFrame:
    """AUC, accuracy, precision, recall, F1 and F2 per model of a ``(model, y, p)`` frame."""
    aucs = curve_metrics(score_curve(df, ["model"]), ["model"]).select("model", "roc_auc")
    return aucs.join(threshold_metrics(df, t, ["model"]).select("model", "accuracy", "precision", "recall", "f1", "f2"), "model")


def champion(comparison: DataFrame, metric: str = "roc_auc") -> DataFrame:
    return comparison.agg(F.min_by("model", F.struct(-F.col(metric), F.col("model"))).alias("champion"), F.max(metric).alias(metric))


def performance_decay(comparison: DataFrame, baseline: float, limit: float = 0.05) -> DataFrame:
    drop = F.lit(baseline) - F.col("roc_auc")
    return comparison.select("model", "roc_auc", drop.alias("decay"), (drop > limit).alias("has_decay"))


def promotion(comparison: DataFrame, current: str, challenger: str, gain: float = 0.01) -> DataFrame:
    """Promote the challenger when its AUC gains at least ``gain``."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("roc_auc")))
    one = comparison.agg(pick(current).alias("current_auc"), pick(challenger).alias("challenger_auc"))
    delta = F.col("challenger_auc") - F.col("current_auc")
    return one.select("*", delta.alias("gain"), (delta >= gain).alias("promote"))


def release_gate(metrics: DataFrame, min_auc: float = 0.8, max_p95: float = 50.0) -> DataFrame:
    """PASS when the AUC is high enough and the p95 latency low enough."""
    ok = (F.col("roc_auc") >= min_auc) & (F.col("p95") <= max_p95)
    return metrics.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def service_metrics(df: DataFrame, latency: str, is_error: Column, seconds: Column) -> DataFrame:
    """Requests, rate per second, error share and exact latency percentiles, one row."""
    p50, p95, p99 = exact_quantiles(df, [latency], [0.5, 0.95, 0.99])[latency]
    one = df.agg(
        F.count(F.lit(1)).alias("requests"), F.avg(is_error.cast("double")).alias("error_rate"),
        (F.max(seconds) - F.min(seconds)).alias("span"),
    )
    return one.select(
        "requests", F.try_divide(F.col("requests").cast("double"), F.col("span")).alias("per_second"), "error_rate",
        F.lit(p50).alias("p50"), F.lit(p95).alias("p95"), F.lit(p99).alias("p99"),
    )


def fairness(df: DataFrame, group: str, t: float = 0.5) -> DataFrame:
    """Positive rate, TPR and FPR per group, with the min/max rate ratio on each row."""
    hit = (F.col("p") >= t).cast("double")
    per = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("positive_rate"),
        F.coalesce(F.avg(F.when(F.col("y") == 1, hit)), F.lit(0.0)).alias("tpr"),
        F.coalesce(F.avg(F.when(F.col("y") == 0, hit)), F.lit(0.0)).alias("fpr"),
    )
    span = per.agg(safe_divide(F.min("positive_rate"), F.max("positive_rate"), 1.0).alias("impact_ratio"))
    return per.transform(with_row, span).withColumn("is_fair", F.col("impact_ratio") >= 0.8)


def blend(df: DataFrame, columns: Sequence[str], weights: Sequence[float]) -> Column:
    """Weighted mean of score columns."""
    total = float(sum(weights))
    return sum((F.col(c) * w for c, w in zip(columns, weights)), F.lit(0.0)) / total


def pseudo_labels(df: DataFrame, p: str, high: float = 0.95, low: float = 0.05) -> DataFrame:
    """Confident scores become labels; the rest is dropped."""
    label = F.when(F.col(p) >= high, 1).when(F.col(p) <= low, 0)
    return df.withColumn("pseudo_label", label).filter(F.col("pseudo_label").isNotNull())


def fallback_score(primary: Column, fallback: Column, default: float = 0.05) -> Column:
    return F.coalesce(primary, fallback, F.lit(default))
