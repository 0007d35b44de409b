"""Analysis runs: all reports of one analyzer as a dictionary of lazy frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.bands import classify
from riskloom.functions.binning import amount_bin
from riskloom.operators import correlation, drift, interact, joins, profile, quality, segments, sets, stats, temporal
from riskloom.session import cut_lineage
from riskloom.sources.sinks import write_report

Reports = dict[str, DataFrame]


def save(reports: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> Reports:
    """Write every report and return the written tables."""
    out = {}
    for name, df in reports.items():
        path = write_report(df, f"{folder}/{name}", fmt)
        reader = df.sparkSession.read.schema(df.schema)
        out[name] = reader.json(path) if fmt == "json" else reader.option("header", True).csv(path)
    return out


def row_counts(reports: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in reports.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("report"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def report_values(reports: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """All values of a run as ``(report, item, metric, number, text)``.

    ``item`` joins the report's key columns by ``|``; a null key is left out.
    Numbers and booleans go to ``number``, the rest to ``text``; a null value
    has no row.
    """
    out = None
    for name, df in reports.items():
        own = list(keys[name])
        cells = []
        for column in df.schema:
            if column.name in own:
                continue
            value, is_text = F.col(f"`{column.name}`"), column.dataType.typeName() == "string"
            cells.append(F.struct(
                F.lit(column.name).alias("metric"), (F.lit(None) if is_text else value).cast("double").alias("number"),
                (value if is_text else F.lit(None)).cast("string").alias("text"),
            ))
        item = F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in own]).alias("item")
        rows = df.select(F.lit(name).alias("report"), item, F.explode(F.array(*cells)).alias("c")).select("report", "item", "c.*")
        rows = rows.filter(F.col("number").isNotNull() | F.col("text").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out


def target_reports(df: DataFrame, target: str, dt: str, amount: str, identity: Sequence[str], numeric: Sequence[str]) -> Reports:
    return {
        "distribution": segments.class_distribution(df, target),
        "imbalance": segments.class_imbalance(df, target),
        "over_time": temporal.rates_over_time(df, dt, target),
        "by_identity": segments.identity_rates(df, identity, target),
        "by_amount": segments.rates_by_amount(df, amount, target),
        "class_statistics": segments.class_conditional_statistics(df, numeric, target),
    }


def numerical_reports(df: DataFrame, columns: Sequence[str]) -> Reports:
    statistics = profile.numeric_statistics(df, columns)
    return {
        "distributions": statistics,
        "outliers": quality.outlier_report(df, columns),
        "transformations": profile.transformation_advice(statistics),
        "shape": profile.distribution_shape(statistics),
    }


def categorical_reports(train: DataFrame, test: DataFrame, columns: Sequence[str], target: str) -> Reports:
    statistics = profile.categorical_statistics(train, columns)
    return {
        "inventory": statistics.withColumn("dominance", classify("dominance", "dominant_known_pct")),
        "cardinality": profile.cardinality_report(train, columns),
        "rare": profile.rare_categories(train, columns),
        "imbalance": profile.category_imbalance(statistics),
        "rates": segments.rates_by_feature(train, columns, target),
        "stability": drift.total_variation(train, test, columns),
        "encoding": segments.encoding_advice(train, columns, target),
    }


def transaction_reports(df: DataFrame, target: str, dt: str, amount: str, product: str, keys: Sequence[str], distances: Sequence[str]) -> Reports:
    banded = df.withColumn("amount_band", amount_bin(amount))
    pairs = {f"{a}_{b}": [a, b] for i, a in enumerate(keys) for b in list(keys)[i + 1 :]}
    out = {
        "amount": segments.segment_rates(banded, ["amount_band"], target, amount),
        "amount_statistics": profile.numeric_statistics(df, [amount]),
        "product": segments.segment_rates(df, [product], target, amount),
        "keys": segments.key_features(df, keys, target),
        "timing": segments.rates_by_hour(df, dt, target, amount),
        "profiles": segments.risk_profiles(banded, ["amount_band", product], target),
    }
    if distances:
        out["distance"] = segments.rates_by_quartile(df, distances, target)
    if pairs:
        out["pairs"] = segments.rates_by_sets(df, pairs, target, amount)
    return out


def id_columns(df: DataFrame, numeric: Sequence[str], texts: Sequence[str], target: str) -> DataFrame:
    """Mean, std, skew and outlier share of numeric ids; label rate where present and missing for all."""
    rates = segments.missing_vs_target(df, [*numeric, *texts], target).select(
        "feature", F.col("available_rate").alias("rate_present"), F.col("missing_rate").alias("rate_missing")
    )
    moments = profile.numeric_statistics(df, numeric).select("feature", "mean", "std", "skew")
    out = quality.outlier_report(df, numeric).select("feature", F.col("iqr_outliers_share").alias("outlier_pct"))
    kind = F.when(F.col("feature").isin(list(numeric)), "Numerical").otherwise("Categorical")
    return rates.join(moments, "feature", "left").join(out, "feature", "left").withColumn("family", kind)


def identity_reports(df: DataFrame, numeric: Sequence[str], texts: Sequence[str], target: str) -> Reports:
    return {
        "inventory": profile.schema_profile(df, [*numeric, *texts]),
        "ids": id_columns(df, numeric, texts, target),
        "availability": segments.availability_bands(df, [*numeric, *texts], target),
        "missing": segments.missing_vs_target(df, [*numeric, *texts], target),
        "values": segments.rates_by_feature(df, texts, target),
    }


def anonymous_series(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Describe, skew, kurtosis, outlier share, missing share and correlation with the label."""
    statistics = profile.numeric_statistics(df, columns).select(
        "feature", "n", "mean", "std", "low", "q1", "median", "q3", "high", "skew", "kurt"
    )
    out = quality.outlier_report(df, columns).select("feature", F.col("iqr_outliers_share").alias("outlier_pct"))
    corr = correlation.target_correlation(df, columns, target).select("feature", F.col("pearson").alias("target_correlation"))
    missing = quality.missing_report(df, columns).select("feature", "missing_pct")
    return statistics.join(out, "feature").join(corr, "feature").join(missing, "feature")


def anonymous_inventory(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Group, missing share, distinct values, cardinality and availability of anonymous columns."""
    columns = [c for cols in groups.values() for c in cols]
    report = quality.dominance_report(df, columns)
    pct = F.col("missing") * 100.0 / F.col("n_rows")
    return profile.with_family(report, {c: g for g, cols in groups.items() for c in cols}).select(
        "feature", F.col("family").alias("series"), pct.alias("missing_pct"), "n_unique",
        classify("anonymous_cardinality", "n_unique").alias("cardinality"), classify("availability", pct).alias("availability"),
    )


def flag_series(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Riskiest value of each match column; a null is a value of its own here."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns})
    rates = segments.rates_by_feature(filled, columns, target)
    worst = rates.groupBy("feature").agg(
        F.count(F.lit(1)).alias("cardinality"),
        F.min_by(F.struct("value", "rate_pct", "relative_risk"), F.struct(-F.col("rate_pct"), F.col("value"))).alias("w"),
    )
    missing = quality.missing_report(df, columns).select("feature", "missing_pct")
    return worst.join(missing, "feature").select("feature", "missing_pct", "cardinality", "w.*")


def anonymous_reports(df: DataFrame, groups: Mapping[str, Sequence[str]], flags: Sequence[str], target: str) -> Reports:
    numeric = [c for cols in groups.values() for c in cols if c not in flags]
    return {
        "inventory": anonymous_inventory(df, groups),
        "series": anonymous_series(df, numeric, target),
        "flags": flag_series(df, flags, target),
        "shape": profile.distribution_shape(profile.numeric_statistics(df, numeric)),
        "anova": stats.anova_by_target(df, numeric, target),
        "hotspots": segments.hotspots(df, flags[0], numeric, target),
    }


def time_reports(train: DataFrame, test: DataFrame, dt: str, target: str, amount: str) -> Reports:
    contributions = temporal.hour_drift(train, test, dt)
    out = {b: temporal.bucket_rates(train, b, dt, target, amount) for b in ("hour", "day")}
    for b in ("week", "month"):
        out[b] = temporal.with_growth(temporal.bucket_rates(train, b, dt, target, amount), b, "total")
    return out | {
        "span": temporal.span_summary(train, dt), "trends": temporal.trends(train, dt, target),
        "seasonality": temporal.seasonality(train, dt), "hour_drift": contributions,
        "hour_drift_summary": temporal.hour_drift_summary(contributions), "anomalies": temporal.temporal_anomalies(train, dt),
    }


def correlation_reports(df: DataFrame, columns: Sequence[str], target: str, limit: float = 0.85) -> Reports:
    pearson = cut_lineage(correlation.pearson_pairs(df, columns))  # a row for each pair, used by five reports
    edges = correlation.correlation_edges(pearson, limit)
    mi = stats.mutual_information(df, columns, target)
    return {
        "inventory": correlation.correlation_inventory(df, columns), "pearson": pearson,
        "spearman": correlation.spearman_pairs(df, columns), "target": correlation.target_correlation(df, columns, target),
        "hubs": correlation.edge_degrees(edges), "groups": correlation.connected_groups(edges),
        "pruning": correlation.correlation_pruning(df, pearson, mi, columns, limit),
    }


def interaction_reports(train: DataFrame, test: DataFrame, columns: Sequence[str], target: str) -> Reports:
    bins = stats.fit_bins(train, columns)
    cells = cut_lineage(interact.pair_cells(train, columns, target, bins))  # at most bins x bins rows for each pair
    strength = cut_lineage(interact.interaction_strength(train, columns, target, bins=bins, cells=cells))
    stable = cut_lineage(interact.interaction_stability(train, test, columns, bins=bins))
    return {
        "separation": interact.class_separation(train, columns, target), "hotspots": interact.pair_hotspots(train, columns, target, cells=cells),
        "odds": interact.cell_odds(train, columns, target, cells=cells), "strength": strength,
        "recommended": interact.recommended_interactions(strength), "triples": interact.triple_hotspots(train, columns, target, bins=bins),
        "stability": stable, "screen": interact.production_screen(train, stable, columns, target, cells=cells),
    }


def test_reports(df: DataFrame, numeric: Sequence[str], texts: Sequence[str], target: str, amount: str) -> Reports:
    running = drift.running_counts(df, numeric, target)
    # Results of a row for each column that several reports use.
    ks = cut_lineage(drift.ks_by_side(df, numeric, target, running=running))
    chi = cut_lineage(stats.chi_square_p(stats.chi_square(df, texts, target)))
    p = ks.select("feature", F.col("ks_p").alias("p_value")).unionByName(chi.select("feature", "p_value"))
    corrected = stats.corrected_p_values(p)
    mi = cut_lineage(stats.mutual_information(df, numeric, target))
    return {
        "ks": ks, "chi_square": chi, "mann_whitney": stats.mann_whitney_p(stats.rank_tests(df, numeric, target, running=running)),
        "anova": stats.anova_p(stats.anova_by_category(df, texts, amount)), "mutual_information": mi, "corrections": corrected,
        "effect_sizes": stats.effect_sizes(df, numeric, target, running=running), "ranking": stats.significance_ranking(corrected, mi, ks.select("feature", "ks")),
    }


def drift_reports(train: DataFrame, test: DataFrame, numeric: Sequence[str], texts: Sequence[str]) -> Reports:
    psi = drift.numeric_psi(train, test, numeric, drift.OPEN_LEFT)
    ks = drift.ks_two_sample(train, test, numeric)
    every = psi.unionByName(drift.categorical_psi(train, test, texts)) if texts else psi
    return {
        "moments": drift.moment_drift(train, test, numeric), "psi": every, "ks": ks,
        "stability": drift.stability_report(every, ks), "report": drift.drift_report(train, test, numeric, texts),
    }


def missing_reports(train: DataFrame, test: DataFrame, columns: Sequence[str], families: Mapping[str, str], target: str) -> Reports:
    train_report = quality.missing_report(train, columns)
    return {
        "train": train_report, "test": quality.missing_report(test, columns),
        "families": quality.family_missingness(train_report, families), "vs_target": segments.missing_vs_target(train, columns, target),
        "comparison": quality.missing_comparison(train, test, columns), "correlation": missing_correlation(train, columns),
    }


def missing_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r between the null flags of all column pairs."""
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns])
    return correlation.pearson_pairs(flags, columns)


def profile_reports(train: DataFrame, test: DataFrame, target: str, identity: Sequence[str], texts: Sequence[str]) -> Reports:
    cards, missing = profile.cardinality_report(train), quality.missing_report(train)
    advice = profile.profile_advice(cards, missing, texts)
    return {
        "inventory": profile.inventory(train, test, target, identity), "cardinality": cards, "completeness": profile.completeness_summary(train),
        "advice": advice, "dictionary": profile.feature_dictionary(cards, missing, advice),
    }


def quality_reports(train: DataFrame, test: DataFrame, id_col: str, target: str, numeric: Sequence[str]) -> Reports:
    dominance = quality.dominance_report(train)
    return {
        "missing": quality.missing_report(train), "duplicates": quality.duplicate_audit(train, id_col),
        "constant": quality.constant_columns(dominance), "near_constant": quality.near_constant_columns(dominance),
        "invalid": quality.invalid_values(train, numeric), "infinite": quality.infinite_report(train),
        "outliers": quality.outlier_report(train, numeric), "consistency": quality.consistency_report(train, test, id_col, target),
    }


def leakage_reports(train: DataFrame, test: DataFrame, columns: Sequence[str], text: str, target: str, dt: str, rows: Sequence[str]) -> Reports:
    """All leakage checks: columns too close to the label, telling names, time, shared categories of ``text``, equal ``rows``, and the risk of each."""
    corr = correlation.target_correlation(train, columns, target)
    leaks = correlation.target_leakage(corr)
    overlap = sets.category_overlap(train, test, text).select(F.lit(text).alias("feature"), "*")
    duplicates = joins.duplicate_overlap(train, test, rows)
    return {
        "inventory": profile.schema_profile(train, [*columns, text]).select("feature", F.when(F.col("is_numeric"), "numeric").otherwise("text").alias("kind"), F.col("cardinality").alias("n_unique")),
        "leaking": correlation.leaking_columns(train, columns, target), "target": leaks,
        "time": correlation.time_correlation(train, columns, dt), "overlap": overlap, "duplicates": duplicates,
        "risk": correlation.leakage_risk(corr, leaks, overlap, duplicates, [text]),
    }
