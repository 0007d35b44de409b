"""Feature selection by data: nulls, variance, correlation, information, gates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import numeric_columns
from riskloom.operators.aggregates import wide_aggregate
from riskloom.operators.correlation import pearson_pairs, target_correlation
from riskloom.operators.quality import missing_report
from riskloom.operators.rows import with_row
from riskloom.operators.stats import mutual_information

Selector = Callable[[DataFrame, Sequence[str]], list[str]]


def null_selector(df: DataFrame, columns: Sequence[str], limit: float = 0.05) -> DataFrame:
    return missing_report(df, columns).select("feature", (F.col("missing_pct") / 100.0).alias("ratio")).withColumn("keep", F.col("ratio") <= limit)


def variance_selector(df: DataFrame, columns: Sequence[str], limit: float = 0.0, *, sample: bool = False) -> DataFrame:
    """Population variance above ``limit`` (sample variance at least ``limit`` when ``sample``)."""
    fn = F.var_samp if sample else F.var_pop
    out = wide_aggregate(df, columns, {"variance": lambda c: fn(F.col(c).cast("double"))})
    keep = F.col("variance") >= limit if sample else F.col("variance") > limit
    return out.withColumn("keep", F.coalesce(keep, F.lit(False)))


def correlation_selector(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> DataFrame:
    """Per correlated pair drop the smaller population variance, on a tie the later column."""
    pairs = pearson_pairs(df, columns).filter(F.abs("r") > limit)
    var = wide_aggregate(df, columns, {"variance": lambda c: F.var_pop(F.col(c).cast("double"))})
    left = var.select(F.col("feature").alias("left"), F.col("variance").alias("vl"))
    right = var.select(F.col("feature").alias("right"), F.col("variance").alias("vr"))
    losers = pairs.join(left, "left").join(right, "right").select(
        F.when(F.col("vl") >= F.col("vr"), F.col("right")).otherwise(F.col("left")).alias("feature")
    ).distinct().withColumn("__drop", F.lit(True))
    return var.join(losers, "feature", "left").select("feature", "variance", F.col("__drop").isNull().alias("keep"))


def information_selector(df: DataFrame, columns: Sequence[str], target: str, limit: float = 0.05) -> DataFrame:
    """Mutual information relative to the best column."""
    mi = mutual_information(df, columns, target)
    top = mi.agg(F.max("mi").alias("__top"))
    score = F.coalesce(F.try_divide(F.col("mi"), F.col("__top")), F.lit(0.0))
    return mi.transform(with_row, top).select("feature", "mi", score.alias("score"), (score >= limit).alias("keep"))


def dropped(report: DataFrame) -> list[str]:
    """Names not kept; one row per column."""
    return sorted(r["feature"] for r in report.filter(~F.col("keep")).select("feature").collect())


def run_chain(df: DataFrame, columns: Sequence[str], steps: Sequence[tuple[str, Selector]]) -> tuple[list[str], DataFrame]:
    """Apply selectors in order; the history has one row per dropped column."""
    kept, history = list(columns), []
    for order, (name, step) in enumerate(steps):
        gone = set(step(df, kept))
        history += [(order, name, c) for c in kept if c in gone]
        kept = [c for c in kept if c not in gone]
    return kept, df.sparkSession.createDataFrame(history, "step int, selector string, feature string")


def selection_gate(df: DataFrame, columns: Sequence[str], target: str) -> None:
    """Raise when the selected set is empty, repeated, flat, collinear or unrelated to the label."""
    columns = list(columns)
    if not columns:
        raise ValueError("no features selected")
    if len(set(columns)) != len(columns) or len(set(df.columns)) != len(df.columns):
        raise ValueError("duplicate column names")
    numeric = [c for c in columns if c in numeric_columns(df)]
    flat = [
        r["feature"]
        for r in wide_aggregate(df, numeric, {"v": lambda c: F.var_samp(F.col(c).cast("double"))}).collect()
        if r["v"] is None or r["v"] < 1e-6
    ]
    if flat:
        raise ValueError(f"near-zero variance: {sorted(flat)}")
    if len(numeric) > 1:
        same = pearson_pairs(df, numeric).filter(F.abs("r") >= 0.999).limit(1).collect()
        if same:
            raise ValueError(f"collinear features: {same[0]['left']}, {same[0]['right']}")
    mi = mutual_information(df, numeric, target)
    weak = target_correlation(df, numeric, target).join(mi, "feature").filter(F.greatest(F.abs("pearson"), F.col("mi")) < 1e-4)
    names = [r["feature"] for r in weak.select("feature").collect()]
    if names:
        raise ValueError(f"unrelated to the label: {sorted(names)}")
