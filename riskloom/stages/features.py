"""Feature stages: basic features, families, encoding, aggregation, pairs, missing, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalars
from riskloom.operators import aggregates, correlation, drift, encode, model, profile, quality, temporal
from riskloom.operators.sets import stack
from riskloom.sources.sinks import write_features


@dataclass(frozen=True)
class Columns:
    """Which columns play which part in the stages."""

    id: str
    dt: str
    amount: str
    target: str
    keys: Sequence[str]
    categories: Sequence[str]
    order: Sequence[str] = field(default_factory=tuple)

    @property
    def event_order(self) -> list[str]:
        return list(self.order) or [self.id]


def basic_features(train: DataFrame, test: DataFrame, c: Columns, count: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Hour of day, log amount, amount per count and train frequency of each category."""
    for df in (train, test):
        if c.id not in df.columns:
            raise ValueError(f"missing key {c.id!r}")
    maps = {k: encode.fit_frequency(train, k) for k in c.categories}

    def apply(df: DataFrame) -> DataFrame:
        extra = {"hour_of_day": scalars.hour_of_day(c.dt), f"log_{c.amount}": F.log1p(c.amount)}
        if count:
            extra[f"{c.amount}_ratio_{count}"] = scalars.amount_per_count(c.amount, count)
        out = df.withColumns(extra)
        for k, m in maps.items():
            out = encode.transform_frequency(out, k, m)
        return out

    return apply(train), apply(test)


def family_features(df: DataFrame, c: Columns) -> DataFrame:
    """Time, amount and key families in one projection plus one lookup per key."""
    columns = {**scalars.time_family(c.dt), **scalars.amount_family(c.amount)}
    columns |= {f"{k}_is_missing": F.col(k).isNull().cast("int") for k in c.keys}
    out = df.select(c.id, *c.keys, *[e.alias(n) for n, e in columns.items()])
    for k in c.keys:
        out = aggregates.with_frequency(out, k, f"{k}_frequency")
    return out.drop(*c.keys)


def encoding_features(train: DataFrame, test: DataFrame, c: Columns) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Encode each category by its cardinality; train target codes are out of fold.

    Returns the two encoded frames and the chosen strategies.
    """
    chosen = {r["feature"]: r["strategy"] for r in profile.encoding_choice(train, c.categories).collect()}
    a, b = train.select(c.id, c.target, *c.categories), test.select(c.id, *c.categories)
    for name, strategy in chosen.items():
        if strategy == "Label":
            m = encode.fit_label(train, name)
            a, b = encode.transform_label(a, name, m), encode.transform_label(b, name, m)
        elif strategy == "OneHot":
            cats = encode.fit_one_hot(train, name)
            a, b = encode.transform_one_hot(a, name, cats), encode.transform_one_hot(b, name, cats)
        elif strategy == "Frequency":
            m = encode.fit_frequency(train, name)
            a, b = encode.transform_frequency(a, name, m), encode.transform_frequency(b, name, m)
        else:
            m, prior = encode.fit_target(train, name, c.target)
            a = encode.out_of_fold_target(a, name, c.target, encode.hash_fold(c.id, 5, 42)).withColumnRenamed(f"{name}_oof", f"{name}_target")
            b = encode.transform_target(b, name, m, prior)
    strategies = train.sparkSession.createDataFrame(sorted(chosen.items()), "feature string, strategy string")
    return a.drop(*c.categories), b.drop(*c.categories), strategies


def aggregation_features(train: DataFrame, test: DataFrame, c: Columns, width: int = 5) -> DataFrame:
    """Train statistics per key for every row, and prior windows over train and test together."""
    cols = [c.id, c.amount, *c.keys, *[o for o in c.event_order if o not in (c.id, c.amount, *c.keys)]]
    out = stack({"train": train.select(*cols), "test": test.select(*cols)}, "split")
    for k in c.keys:
        out = aggregates.attach_entity_stats(out, aggregates.entity_stats(train, k, c.amount), k)
        out = temporal.prior_windows(out, k, c.event_order, c.amount, width)
    return out


SUFFIXES = ["_mean", "_median", "_std", "_min", "_max"]


def pair_features(df: DataFrame, numerators: Sequence[str], suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Ratio, difference and product of each numerator with the statistics that carry its name."""
    pairs = scalars.discover_pairs(df.columns, numerators, suffixes)
    columns = {}
    for n, s in pairs:
        columns[f"{s}_ratio"] = scalars.safe_ratio(n, s)
        columns[f"{s}_diff"] = scalars.safe_difference(n, s)
        columns[f"{s}_product"] = scalars.interaction(n, s, "multiply")
    return df.withColumns(columns)


def missing_features(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    stats = scalars.row_missing_stats(df, columns)
    return df.select(
        id_col, *[e.alias(n) for n, e in scalars.missing_indicators(df, columns).items()],
        *[e.alias(n) for n, e in stats.items()], scalars.missing_pattern(df, columns).alias("missing_pattern"),
    )


def gated_sink(df: DataFrame, base: str, view: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Write a feature frame; returns its gate report and the written table."""
    path = write_features(df, base, view, version)
    written = df.sparkSession.read.parquet(path)
    return quality.feature_gate(written), written


def feature_validation(
    train: DataFrame, test: DataFrame, features: Sequence[str], target: str, expected: Mapping[str, bool],
    bounds: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Schema, missing, statistics, drift, leakage, redundancy and importance: one row per check.

    A schema error is FAIL, any other finding is WARN; the last row is the overall status.
    """
    spark = train.sparkSession
    errors = profile.validate_schema(test, expected)

    def count(name: str, found: DataFrame) -> DataFrame:
        one = found.agg(F.count(F.lit(1)).alias("findings"))
        return one.select(F.lit(name).alias("check"), "findings", F.when(F.col("findings") > 0, "WARN").otherwise("PASS").alias("status"))

    schema_row = spark.createDataFrame([("schema", len(errors), "FAIL" if errors else "PASS")], "check string, findings long, status string")
    stats = quality.sigma_gate(test, features, 4.0, bounds)
    rows = [
        count("missing", quality.missing_gate(test.select(*features)).filter("status = 'FAIL'")),
        count("statistics", stats.filter("n_sigma > 0 OR n_out_of_bounds > 0 OR is_constant")),
        count("drift", drift.feature_drift_gate(train, test, features).filter("is_drifted")),
        count("leakage", correlation.leaking_columns(train, features, target, 0.9, strict=True)),
        count("redundancy", correlation.redundancy(train, features, method="either")),
        count("importance", model.weak_features(train.withColumnRenamed(target, "y"), features).filter("is_weak")),
    ]
    out = schema_row
    for r in rows:
        out = out.unionByName(r)
    worst = F.when(F.max((F.col("status") == "FAIL").cast("int")) == 1, "FAIL").when(F.max((F.col("status") == "WARN").cast("int")) == 1, "WARN").otherwise("PASS")
    overall = out.agg(F.sum("findings").alias("findings"), worst.alias("status")).select(F.lit("overall").alias("check"), "findings", "status")
    return out.unionByName(overall)


def view_drift(train_view: DataFrame, test_view: DataFrame, features: Sequence[str]) -> DataFrame:
    """PSI of each feature of a view pair, over the full views."""
    return drift.numeric_psi(train_view, test_view, features)


def leakage_run(df: DataFrame, features: Sequence[str], target: str, limit: float = 0.95) -> DataFrame:
    """Every feature with its correlation and whether it leaks."""
    corr = correlation.target_correlation(df, features, target).select("feature", "pearson")
    return corr.withColumn("status", F.when(F.abs("pearson") >= limit, "LEAK").otherwise("OK"))
