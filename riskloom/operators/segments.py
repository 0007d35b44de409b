"""Positive-label rates per segment: one aggregate behind every risk table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.bands import classify
from riskloom.functions.binning import bin_label, quartile_label, unique_edges
from riskloom.functions.scalars import col, completeness
from riskloom.operators.aggregates import long_values
from riskloom.operators.quality import missing_report
from riskloom.operators.quantiles import exact_quantiles
from riskloom.operators.rows import largest, with_row


def _need(df: DataFrame, *columns: str) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}")


def pct(part: Column | str, whole: Column | str) -> Column:
    return F.coalesce(F.try_divide(col(part) * 100.0, col(whole)), F.lit(0.0))


def with_risk(rates: DataFrame, df: DataFrame, target: str) -> DataFrame:
    """Add rate, share of rows and risk relative to the overall rate (a one-row side)."""
    overall = df.agg(F.count(F.lit(1)).alias("__rows"), F.avg(col(target)).alias("__rate"))
    return (
        rates.transform(with_row, overall)
        .withColumns({"rate_pct": pct("positives", "total"), "share_pct": pct("total", "__rows")})
        .withColumn("relative_risk", F.try_divide(F.col("rate_pct"), F.col("__rate") * 100.0))
        .drop("__rows", "__rate")
    )


def _rate_aggs(target: str, amount: str | None) -> list[Column]:
    aggs = [F.count(target).alias("total"), F.sum(target).alias("positives")]
    if amount:
        aggs.append(F.avg(amount).alias("mean_amount"))
    return aggs


def segment_rates(
    df: DataFrame, keys: Sequence[str], target: str, amount: str | None = None, *, keep_null: bool = False
) -> DataFrame:
    """Rows, positives, rate, share and relative risk per combination of ``keys``."""
    _need(df, *keys, target)
    known = df if keep_null else df.dropna(subset=list(keys))
    return with_risk(known.groupBy(*keys).agg(*_rate_aggs(target, amount)), df, target)


def rates_by_feature(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Rate, lift, class ratio and share of all positives per (feature, value)."""
    _need(df, *columns, target)
    long = long_values(df, columns, keep=[F.col(target).alias("__y")]).filter(F.col("value").isNotNull())
    rates = long.groupBy("feature", "value").agg(F.count("__y").alias("total"), F.sum("__y").alias("positives"))
    every = df.agg(F.sum(target).alias("all_positives"))
    out = with_risk(rates, df, target).transform(with_row, every)
    legit = F.lit(100.0) - F.col("rate_pct")
    return out.withColumns(
        {
            "legit_pct": legit,
            "odds": F.try_divide(F.col("rate_pct"), legit),
            "share_of_positives_pct": pct("positives", "all_positives"),
        }
    ).drop("all_positives")


def rates_by_sets(df: DataFrame, sets: Mapping[str, Sequence[str]], target: str, amount: str | None = None) -> DataFrame:
    """Several groupings in one pass: ``GROUPING SETS`` with the set name as a column.

    Rows with a null in a set's own keys are left out of that set only.
    """
    keys = list(dict.fromkeys(k for cols in sets.values() for k in cols))
    grouped = df.groupingSets([[F.col(k) for k in cols] for cols in sets.values()], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("__gid"), *_rate_aggs(target, amount)
    )
    names, tests = F, F.lit(False)
    for name, cols in sets.items():
        gid = sum(0 if k in cols else 1 << (len(keys) - 1 - i) for i, k in enumerate(keys))
        here = F.col("__gid") == gid
        names = names.when(here, F.lit(name))
        tests = tests | (here & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    return with_risk(grouped.filter(tests).withColumn("grouping", names), df, target).drop("__gid")


def risk_profiles(df: DataFrame, keys: Sequence[str], target: str, k: int | None = None) -> DataFrame:
    """All segments, or the ``k`` largest, with a risk label."""
    rates = segment_rates(df, keys, target)
    return largest(rates.withColumn("risk", classify("risk_label", "rate_pct")), [F.col("total").desc(), *keys], k)


# --- label ----------------------------------------------------------------------


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and share per class, nulls as their own class."""
    _need(df, target)
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    counts = df.groupBy(F.coalesce(F.col(target).cast("string"), F.lit("missing")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.transform(with_row, total).select("label", "n", pct("n", "__n").alias("pct"))


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    one = df.agg(
        F.sum((F.col(target) == 0).cast("long")).alias("negatives"),
        F.sum((F.col(target) == 1).cast("long")).alias("positives"),
        F.count(F.lit(1)).alias("n"),
    )
    ratio = F.coalesce(F.try_divide(F.col("negatives").cast("double"), F.col("positives")), F.lit(0.0))
    return one.select(
        "negatives", "positives", pct("negatives", "n").alias("majority_pct"), pct("positives", "n").alias("minority_pct"),
        ratio.alias("ratio"), classify("imbalance", ratio).alias("severity"),
    )


def missing_vs_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Positive rate where a column is missing and where it is present."""
    _need(df, *columns, target)
    flags = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNull().alias("gone")) for c in columns])
    long = df.select(F.col(target).alias("y"), F.explode(flags).alias("f")).select("y", "f.*")
    one = long.groupBy("feature").agg(
        F.sum(F.col("gone").cast("long")).alias("missing_count"),
        F.coalesce(F.sum(F.when(F.col("gone"), F.col("y"))), F.lit(0)).alias("missing_positives"),
        F.sum((~F.col("gone")).cast("long")).alias("available_count"),
        F.coalesce(F.sum(F.when(~F.col("gone"), F.col("y"))), F.lit(0)).alias("available_positives"),
    )
    a, b = pct("missing_positives", "missing_count"), pct("available_positives", "available_count")
    risk = F.when(b > 0, F.try_divide(a, b)).when(a == 0, 1.0)
    return one.withColumns({"missing_rate": a, "available_rate": b, "difference": a - b, "relative_risk": risk})


def identity_rates(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Missing/available rates (percent), cardinality and the riskiest category."""
    base = missing_vs_target(df, columns, target)
    counts = long_values(df, columns, keep=[F.col(target).alias("y")]).filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")
    )
    cards = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("cardinality"))
    rate = F.col("p") * 100.0 / F.col("n")
    riskiest = (
        counts.groupBy("feature")
        .agg(F.min_by("value", F.struct(-rate, F.col("value"))).alias("riskiest_category"), F.max(rate).alias("riskiest_rate"))
    )
    return (
        base.select("feature", "missing_count", "missing_rate", "available_count", "available_rate")
        .join(cards, "feature", "left").join(riskiest, "feature", "left")
    )


def rates_by_amount(df: DataFrame, amount: str, target: str) -> DataFrame:
    """Rates in the bands between the 0, 10, 30, 70, 90 and 100 percentiles."""
    labels = ["Very Low", "Low", "Medium", "High", "Very High"]
    edges = unique_edges(exact_quantiles(df, [amount], [0, 0.1, 0.3, 0.7, 0.9, 1.0])[amount])
    if len(edges) < 2:
        top = edges[0] if edges else 0.0
        edges, labels = [0.0, top + 1.0], ["All"]
    else:
        edges[0] = 0.0
    band = bin_label(amount, edges, labels[: len(edges) - 1], include_ends=True)
    out = df.withColumn("band", band).filter(F.col("band").isNotNull()).groupBy("band").agg(*_rate_aggs(target, None))
    low = F.create_map(*[x for i, n in enumerate(labels[: len(edges) - 1]) for x in (F.lit(n), F.lit(edges[i]))])
    high = F.create_map(*[x for i, n in enumerate(labels[: len(edges) - 1]) for x in (F.lit(n), F.lit(edges[i + 1]))])
    return out.select("band", "total", "positives", pct("positives", "total").alias("rate_pct"), low[F.col("band")].alias("low"), high[F.col("band")].alias("high"))


def class_conditional_statistics(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Count, mean, std, min, quartiles and max per feature and class."""
    from riskloom.operators.quantiles import grouped_quantiles

    long = long_values(df, columns, keep=[F.col(target).alias("label")], kind="double").filter(
        F.col("value").isNotNull() & F.col("label").isNotNull()
    )
    quartiles = grouped_quantiles(long, ["feature", "label"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return (
        long.groupBy("feature", "label")
        .agg(
            F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("low"), F.max("value").alias("high"),
        )
        .join(quartiles, ["feature", "label"])
    )


# --- transaction and identity views -------------------------------------------------


def key_features(df: DataFrame, columns: Sequence[str], target: str, top: int = 5) -> DataFrame:
    """Uniques, missing share, dominant value, riskiest value and the ``top`` riskiest per column."""
    rates = rates_by_feature(df, columns, target)
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.col("rate_pct").desc(), F.col("total").desc(), "value"))
    listed = (
        rates.withColumn("r", rank).filter(F.col("r") <= top).groupBy("feature")
        .agg(F.array_sort(F.collect_list(F.struct("r", "value", "rate_pct"))).alias("t"))
    )
    shown = F.transform("t", lambda x: F.concat(x["value"], F.lit("("), F.format_string("%.1f", x["rate_pct"]), F.lit("%)")))
    worst = F.element_at("t", 1)
    sums = rates.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.min_by("value", F.struct(-F.col("total"), F.col("value"))).alias("dominant_value"),
        (F.max("total") * 100.0 / F.sum("total")).alias("dominant_pct"),
    )
    missing = missing_report(df, columns).select("feature", "missing_pct")
    overall = df.agg((F.avg(target) * 100.0).alias("__rate"))
    return (
        sums.join(missing, "feature").join(listed, "feature").transform(with_row, overall)
        .select(
            "feature", "n_unique", "missing_pct", "dominant_value", "dominant_pct",
            worst["value"].alias("riskiest_value"), worst["rate_pct"].alias("riskiest_rate"),
            F.try_divide(worst["rate_pct"], F.col("__rate")).alias("relative_risk"),
            F.array_join(shown, ", ").alias("riskiest_values"),
        )
    )


def rates_by_quartile(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Rates per quartile bin, with the column's mean, median and std on each row."""
    q = exact_quantiles(df, columns, [0, 0.25, 0.5, 0.75, 1])
    bins = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), quartile_label(c, unique_edges(q[c]))).alias("bin"), F.col(c).cast("double").alias("v"))
            for c in columns
        ]
    )
    long = df.select(F.col(target).alias("y"), F.explode(bins).alias("b")).select("y", "b.*").filter("v IS NOT NULL")
    rates = long.groupBy("feature", "bin").agg(F.count("y").alias("total"), F.sum("y").alias("positives"))
    stats = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    medians = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(q[c][2]))])
    return (
        rates.join(F.broadcast(stats), "feature")
        .withColumns({"rate_pct": pct("positives", "total"), "median": medians[F.col("feature")]})
    )


def rates_by_hour(df: DataFrame, dt: str, target: str, amount: str | None = None) -> DataFrame:
    """24 rows, hours without transactions filled with 0."""
    hour = F.pmod(F.floor(F.col(dt) / 3600), F.lit(24))
    rates = df.groupBy(hour.alias("hour")).agg(*_rate_aggs(target, amount))
    hours = df.sparkSession.range(24).select(F.col("id").alias("hour"))
    zero = F.lit(0)
    out = hours.join(F.broadcast(rates), "hour", "left").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("total", "positives", *(["mean_amount"] if amount else []))}
    )
    return with_risk(out, df, target)


def availability_bands(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Rates by how many identity columns are present."""
    share = completeness(columns) * 100.0
    band = F.when(share <= 0, "None").when(share <= 30, "Low").when(share <= 70, "Medium").otherwise("High")
    return segment_rates(df.withColumn("availability", band), ["availability"], target)


def hotspots(df: DataFrame, category: str, numeric: Sequence[str], target: str) -> DataFrame:
    """For each (category, quartile of a column) pair the cell with the highest rate."""
    q = exact_quantiles(df, numeric, [0, 0.25, 0.5, 0.75, 1])
    bins = F.array(*[F.struct(F.lit(c).alias("feature"), quartile_label(c, unique_edges(q[c])).alias("bin")) for c in numeric])
    cells = (
        df.select(F.col(category).cast("string").alias("category"), F.col(target).alias("y"), F.explode(bins).alias("b"))
        .filter("category IS NOT NULL").select("category", "y", "b.*")
        .groupBy("feature", "category", "bin").agg(F.count("y").alias("n"), F.avg("y").alias("rate"))
    )
    best = F.min_by(F.struct("category", "bin", "n", "rate"), F.struct(-F.col("rate"), F.col("category"), F.col("bin")))
    overall = df.agg(F.avg(target).alias("__rate"))
    return (
        cells.groupBy("feature").agg(best.alias("b")).select("feature", "b.*").transform(with_row, overall)
        .withColumn("relative_risk", F.try_divide(F.col("rate"), F.col("__rate"))).drop("__rate")
    )


def encoding_advice(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Encoding per feature from cardinality, rare categories, diversity and risk."""
    from riskloom.operators.profile import categorical_statistics, category_imbalance, rare_categories

    stats = categorical_statistics(df, columns)
    diversity = category_imbalance(stats).select("feature", "diversity")
    rare = rare_categories(df, columns).select("feature", "n_rare")
    risk = rates_by_feature(df, columns, target).groupBy("feature").agg((F.max("relative_risk") > 3).alias("is_risky"))
    kind = classify("cardinality", "n_categories")
    low = kind == "Low"
    some = kind.isin("Low", "Medium")
    choice = (
        F.when(kind == "Binary", "Label Encoding (Binary)")
        .when(low & F.col("is_risky"), "Target Encoding")
        .when(some & (F.col("n_rare") == 0), "One-Hot Encoding")
        .when(some, "One-Hot Encoding with Rare Grouping")
        .when(kind == "High", "Frequency Encoding")
        .otherwise("Target Encoding / Hashing")
    )
    flat = F.when(F.col("diversity") < 0.1, " + Near-Constant Flag").otherwise("")
    return stats.join(diversity, "feature").join(rare, "feature").join(risk, "feature").select(
        "feature", kind.alias("cardinality"), "n_rare", "diversity", "is_risky", F.concat(choice, flat).alias("encoding")
    )
