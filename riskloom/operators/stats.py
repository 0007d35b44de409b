"""Statistical tests on value counts, moments and cell counts; full data, no sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.bands import classify
from riskloom.functions.binning import unique_edges
from riskloom.functions.tails import chi2_sf, f_sf, normal_sf
from riskloom.operators.aggregates import few_valued, long_values
from riskloom.operators.bins import Edges, add_bins
from riskloom.operators.drift import sided_value_counts
from riskloom.operators.ordered import prefix_sums
from riskloom.operators.quantiles import exact_quantiles
from riskloom.operators.rows import with_row


def value_ranks(counts: DataFrame, n: Column, *, rows_per_block: int | None = None) -> DataFrame:
    """Average rank of each value from ``(feature, value, ...)`` counts."""
    ranked = prefix_sums(
        counts, ["feature"], ["value"], {"__before": n}, inclusive=False, rows_per_block=rows_per_block
    )
    return ranked.withColumn("rank", F.col("__before") + (n + 1) / 2.0).drop("__before")


def rank_tests(
    df: DataFrame, columns: Sequence[str], target: str, *, rows_per_block: int | None = None, running: DataFrame | None = None
) -> DataFrame:
    """Mann-Whitney U, rank-biserial, Cliff's delta and Spearman with a binary label.

    Everything follows from average ranks of value counts, so no pair of rows
    is ever formed.  Class 1 is the first sample; ``running`` are the counts of
    ``running_counts``, if they are there.
    """
    n = F.col("n0") + F.col("n1")
    if running is None:
        ranked = value_ranks(sided_value_counts(df, columns, target), n, rows_per_block=rows_per_block)
    else:
        # The rows before a value, then the middle of its own.
        ranked = running.withColumn("rank", F.col("c0") + F.col("c1") - n + (n + 1) / 2.0)
    d = lambda c: F.col(c).cast("double")
    sums = ranked.groupBy("feature").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
        F.sum(d("n1") * F.col("rank")).alias("r1"),
        F.sum(n.cast("double") * F.col("rank") * F.col("rank")).alias("rr"),
        F.sum(n.cast("double") * n * n - n).alias("ties"),
    )
    n0, n1, total = d("n0"), d("n1"), d("n0") + d("n1")
    u = F.col("r1") - n1 * (n1 + 1) / 2.0
    mean_rank = (total + 1) / 2.0
    cov = F.col("r1") - n1 * mean_rank
    spread = F.col("rr") - total * mean_rank * mean_rank
    enough = (F.col("n0") > 5) & (F.col("n1") > 5)
    sigma = F.sqrt(n0 * n1 / 12.0 * ((total + 1) - F.try_divide(F.col("ties"), total * (total - 1))))
    z = F.try_divide(F.abs(u - n0 * n1 / 2.0) - 0.5, sigma)
    return sums.select(
        "feature", "n0", "n1",
        F.when(enough, u).otherwise(0.0).alias("u"),
        F.when(enough, F.lit(1.0) - F.try_divide(u * 2.0, n0 * n1)).otherwise(0.0).alias("rank_biserial"),
        F.when(enough, F.try_divide(u * 2.0, n0 * n1) - 1.0).otherwise(0.0).alias("cliffs_delta"),
        F.coalesce(F.try_divide(cov, F.sqrt(spread * n1 * n0 / total)), F.lit(0.0)).alias("spearman"),
        F.when(enough, z).alias("z"),
    )


def mann_whitney_p(tests: DataFrame) -> DataFrame:
    """Two-sided asymptotic p-value with tie and continuity correction."""
    p = F.least(F.lit(1.0), normal_sf(F.greatest(F.col("z"), F.lit(0.0))) * 2.0)
    return tests.withColumn("p_value", F.coalesce(p, F.lit(1.0)))


def effect_sizes(df: DataFrame, columns: Sequence[str], target: str, *, running: DataFrame | None = None) -> DataFrame:
    """Cohen's d (pooled sample variance) and Cliff's delta with its magnitude."""
    one = lambda k: F.when(F.col("__y") == k, F.col("value"))
    m = long_values(df, columns, keep=[F.col(target).alias("__y")], kind="double").groupBy("feature").agg(
        *[f(one(k)).alias(f"{s}{k}") for k in (0, 1) for s, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    pooled = F.sqrt(
        F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), (F.col("n0") + F.col("n1") - 2).cast("double"))
    )
    cohen = F.coalesce(F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled), F.lit(0.0))
    ranks = rank_tests(df, columns, target, running=running).select("feature", "cliffs_delta")
    return m.join(ranks, "feature").select(
        "feature", F.when((F.col("n0") > 5) & (F.col("n1") > 5), cohen).otherwise(0.0).alias("cohens_d"), "cliffs_delta",
        classify("effect_size", F.abs("cliffs_delta")).alias("magnitude"),
    )


def chi_square(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Independence of each category column and a 0/1 label, Yates-corrected for one degree of freedom."""
    long = long_values(
        df.filter(F.col(target).isNotNull()).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("Missing")) for c in columns}),
        columns, keep=[F.col(target).alias("__y")],
    )
    cells = long.groupBy("feature", "value").agg(
        F.sum((F.col("__y") == 0).cast("long")).alias("o0"), F.sum((F.col("__y") == 1).cast("long")).alias("o1")
    )
    totals = cells.groupBy("feature").agg(
        F.sum("o0").cast("double").alias("t0"), F.sum("o1").cast("double").alias("t1"), F.count(F.lit(1)).alias("rows")
    )
    staged = cells.join(F.broadcast(totals), "feature")
    row = F.col("o0") + F.col("o1")

    def part(o: str, t: str) -> Column:
        expected = row * F.col(t) / (F.col("t0") + F.col("t1"))
        gap = F.abs(F.col(o) - expected)
        gap = F.when(F.col("rows") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.try_divide(gap * gap, expected)

    out = staged.groupBy("feature").agg(
        F.sum(part("o0", "t0") + part("o1", "t1")).alias("s"), F.max("rows").alias("rows"),
        F.max(F.col("t0")).alias("t0"), F.max(F.col("t1")).alias("t1"),
    )
    usable = (F.col("rows") > 1) & (F.col("t0") > 0) & (F.col("t1") > 0)
    stat = F.when(usable, F.col("s")).otherwise(0.0)
    return out.select(
        "feature", stat.alias("chi2"), F.when(usable, F.col("rows") - 1).otherwise(1).cast("int").alias("dof"),
        F.sqrt(stat / (F.col("t0") + F.col("t1"))).alias("cramers_v"),
    )


def chi_square_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof").cast("double")))


def anova_by_category(df: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """One-way ANOVA of ``value`` over each category column; every group needs more than 5 rows."""
    middle = exact_quantiles(df, [value], [0.5])[value][0]
    filled = df.withColumn("__v", F.coalesce(F.col(value).cast("double"), F.lit(middle)))
    filled = filled.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("Missing")) for c in columns})
    groups = long_values(filled, columns, keep=["__v"]).groupBy("feature", "value").agg(
        F.count("__v").alias("n"), F.avg("__v").alias("m"), F.coalesce(F.var_pop("__v"), F.lit(0.0)).alias("v")
    )
    return _anova(groups, 5)


def _anova(groups: DataFrame, more_than: int) -> DataFrame:
    """F and eta squared from group sizes, means and population variances."""
    overall = groups.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    sums = groups.join(F.broadcast(overall), "feature").groupBy("feature").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2.0))).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.min("n").alias("least"),
    )
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    usable = (F.col("k") > 1) & (F.col("least") > more_than)
    f = F.try_divide(F.try_divide(F.col("ssb"), d1), F.try_divide(F.col("ssw"), d2))
    eta = F.coalesce(F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")), F.lit(0.0))
    return sums.select(
        "feature", F.when(usable, f).otherwise(0.0).alias("f"), F.when(usable, eta).otherwise(0.0).alias("eta_squared"),
        d1.alias("dof1"), d2.alias("dof2"),
    )


def anova_by_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """ANOVA F of each numeric column over the classes; nulls become the column mean."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})
    groups = long_values(filled, columns, keep=[F.col(target).alias("label")], kind="double").groupBy("feature", "label").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("v")
    )
    return _anova(groups, 0)


def anova_p(tests: DataFrame) -> DataFrame:
    usable = F.col("dof2") > 0
    return tests.withColumn("p_value", F.when(usable, f_sf("f", "dof1", "dof2")).otherwise(1.0))


# --- mutual information on bins -----------------------------------------------------------


def fit_bins(df: DataFrame, columns: Sequence[str], bins: int = 4) -> dict[str, Edges]:
    """Quantile bins of the columns with more than ``bins`` values."""
    few = few_valued(df, columns, bins)
    many = [c for c in columns if c not in few]
    q = exact_quantiles(df, many, [i / bins for i in range(bins + 1)]) if many else {}
    return {c: Edges(unique_edges(q[c])) for c in many}


def bin_columns(df: DataFrame, columns: Sequence[str], bins: int = 4, fitted: Mapping[str, Edges] | None = None) -> DataFrame:
    """Add ``__b_<column>`` with quantile-bin labels; a column with at most ``bins`` values keeps its values.

    ``fitted`` are the bins that ``fit_bins`` found on ``df``, if they are there.
    """
    many = fit_bins(df, columns, bins) if fitted is None else fitted
    binned = add_bins(df, many)
    labels = {}
    for c in columns:
        known = F.concat(F.lit("Q"), F.col(f"__bin_{c}") + 1) if c in many else F.col(c).cast("double").cast("string")
        labels[f"__b_{c}"] = F.coalesce(known, F.lit("Missing"))
    return binned.withColumns(labels).drop(*[f"__bin_{c}" for c in many])


def _plug_in_mi(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mutual information in nats of ``(keys, cell, y, n)`` counts."""
    total = cells.groupBy(*keys).agg(F.sum("n").alias("t"))
    by_cell = cells.groupBy(*keys, "cell").agg(F.sum("n").alias("nc"))
    by_label = cells.groupBy(*keys, "y").agg(F.sum("n").alias("ny"))
    joined = (
        cells.join(by_cell, [*keys, "cell"]).join(F.broadcast(by_label), [*keys, "y"]).join(F.broadcast(total), list(keys))
    )
    n = F.col("n").cast("double")
    mi = F.sum(n / F.col("t") * F.log(n * F.col("t") / (F.col("nc").cast("double") * F.col("ny"))))
    return joined.groupBy(*keys).agg(F.greatest(F.lit(0.0), mi).alias("mi"))


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information between binned columns and the label, on the full data."""
    rows = df.select(target, *columns)
    many = fit_bins(rows, columns, bins)
    code = lambda c: F.col(f"__bin_{c}" if c in many else c).cast("double")
    codes = F.array(*[F.struct(F.lit(i).alias("i"), code(c).alias("code")) for i, c in enumerate(columns)])
    # Rows are counted by numbers; the few cells that are left get their names.
    counts = (
        add_bins(rows, many).select(F.col(target).alias("y"), F.explode(codes).alias("r")).select("y", "r.*")
        .groupBy("i", "code", "y").agg(F.count(F.lit(1)).alias("n"))
    )
    name = F.get(F.array(*map(F.lit, columns)), F.col("i"))
    cells = counts.select(name.alias("feature"), F.coalesce(F.col("code").cast("string"), F.lit("Missing")).alias("cell"), "y", "n")
    return _plug_in_mi(cells, ["feature"])


# --- multiple testing and ranking -----------------------------------------------------------


def corrected_p_values(tests: DataFrame, p: str = "p_value", key: str = "feature") -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg; one row per test, so the windows are small."""
    m = tests.agg(F.count(F.lit(1)).alias("__m"))
    order = Window.orderBy(p, key)
    ranked = tests.transform(with_row, m).withColumn("__r", F.row_number().over(order))
    one = F.lit(1.0)
    holm = F.max(F.col(p) * (F.col("__m") - F.col("__r") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.col(p) * F.col("__m") / F.col("__r")).over(order.rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumns(
        {"bonferroni": F.least(one, F.col(p) * F.col("__m")), "holm": F.least(one, holm), "fdr": F.least(one, bh)}
    ).drop("__m", "__r")


def significance_ranking(corrected: DataFrame, mi: DataFrame, ks: DataFrame) -> DataFrame:
    """Score, category and action per feature."""
    joined = corrected.join(mi.select("feature", "mi"), "feature", "left").join(ks.select("feature", "ks"), "feature", "left").fillna(0.0, ["mi", "ks"])
    score = -F.log10(F.col("p_value") + 1e-15) + F.col("mi") * 100.0 + F.col("ks") * 10.0
    kind = classify("significance", "fdr")
    action = (
        F.when((kind == "HIGHLY SIGNIFICANT") & (F.col("mi") > 0.005), "RETAIN")
        .when(kind == "NOT SIGNIFICANT", "PRUNE").otherwise("MONITOR")
    )
    return joined.select("feature", "p_value", "fdr", "mi", "ks", score.alias("score"), kind.alias("category"), action.alias("action"))
