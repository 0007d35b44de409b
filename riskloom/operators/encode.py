"""Encoders: ``fit`` returns a small mapping table, ``transform`` joins it.

A mapping has one row per category, ``(value, code...)``.  Null categories are
the category "nan" where the encoder counts them.  All encoders are fitted on
the train frame only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import col
from riskloom.operators.joins import lookup_join
from riskloom.operators.ordered import prefix_sums, with_ordinal
from riskloom.operators.rows import with_row

NULL_NAME = "nan"


def as_category(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(NULL_NAME))


def _apply(df: DataFrame, column: str, mapping: DataFrame, defaults: dict[str, Column], category: Column) -> DataFrame:
    staged = df.withColumn("value", category)
    out = lookup_join(staged, mapping, ["value"])
    filled = {c: F.coalesce(F.col(c), default) for c, default in defaults.items()}
    return out.withColumns(filled).drop("value")


def fit_label(df: DataFrame, column: str, *, rows_per_block: int | None = None) -> DataFrame:
    """Codes 0..k-1 in sorted order of the known values."""
    values = df.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    ranked = with_ordinal(values, ["value"], "code", rows_per_block=rows_per_block)
    return ranked.select("value", F.col("code").cast("int").alias(f"{column}_label"))


def transform_label(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    return _apply(df, column, mapping, {f"{column}_label": F.lit(-1)}, F.col(column).cast("string"))


def fit_frequency(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(as_category(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t"))
    return counts.transform(with_row, total).select("value", (F.col("n") / F.col("t")).alias(f"{column}_freq"))


def transform_frequency(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    return _apply(df, column, mapping, {f"{column}_freq": F.lit(0.0)}, as_category(column))


COUNT_MODES = ("count", "log", "percentile")


def fit_count(df: DataFrame, column: str, mode: str = "count") -> DataFrame:
    """Count, log1p of the count, or the percentile rank of the count (average ties)."""
    if mode not in COUNT_MODES:
        raise ValueError(f"unknown count mode {mode!r}")
    counts = df.groupBy(as_category(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    name = f"{column}_{mode}"
    if mode == "count":
        return counts.select("value", F.col("n").cast("double").alias(name))
    if mode == "log":
        return counts.select("value", F.log1p("n").alias(name))
    # Ranks run over the distinct counts, a short list.
    per_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("ties"))
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("ties").over(upto), F.lit(0))
    ranks = per_count.select("n", (below + (F.col("ties") + 1) / 2.0).alias("rank"))
    size = per_count.agg(F.sum("ties").alias("k"))
    return counts.join(ranks, "n").transform(with_row, size).select("value", (F.col("rank") / F.col("k")).alias(name))


def transform_count(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    name = next(c for c in mapping.columns if c != "value")
    return _apply(df, column, mapping, {name: F.lit(0.0)}, as_category(column))


def _smooth(n: Column, total: Column, prior: Column, leaf: float, smoothing: float) -> Column:
    weight = 1.0 / (1.0 + F.exp(-(n - leaf) / smoothing))
    return weight * (total / n) + (1.0 - weight) * prior


def fit_target(df: DataFrame, column: str, target: str, leaf: float = 20.0, smoothing: float = 10.0) -> tuple[DataFrame, float]:
    """Smoothed label mean per category, and the prior for unseen ones."""
    prior = float(df.agg(F.avg(target)).first()[0] or 0.0)
    stats = df.groupBy(as_category(column).alias("value")).agg(F.count(target).alias("n"), F.sum(target).alias("s"))
    code = _smooth(F.col("n"), F.col("s"), F.lit(prior), leaf, smoothing)
    return stats.select("value", code.alias(f"{column}_target")), prior


def transform_target(df: DataFrame, column: str, mapping: DataFrame, prior: float) -> DataFrame:
    return _apply(df, column, mapping, {f"{column}_target": F.lit(prior)}, as_category(column))


def hash_fold(id_col: str, folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(folds)).cast("int")


def out_of_fold_target(
    df: DataFrame, column: str, target: str, fold: Column, leaf: float = 20.0, smoothing: float = 10.0
) -> DataFrame:
    """Each row is encoded from the other folds: totals minus the fold's own sums, in one pass."""
    staged = df.withColumns({"__fold": fold, "__value": as_category(column)})
    cells = staged.groupBy("__value", "__fold").agg(F.count(target).alias("n"), F.sum(target).alias("s"))
    totals = cells.groupBy("__value").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    per_fold = cells.groupBy("__fold").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    everything = cells.agg(F.sum("n").alias("gn"), F.sum("s").alias("gs"))
    priors = per_fold.transform(with_row, everything).select(
        "__fold", ((F.col("gs") - F.col("fs")) / (F.col("gn") - F.col("fn"))).alias("prior")
    )
    n, s = F.col("all_n") - F.col("n"), F.col("all_s") - F.col("s")
    codes = (
        cells.join(totals, "__value").join(F.broadcast(priors), "__fold")
        .select(
            "__value", "__fold",
            F.when(n > 0, _smooth(n, s, F.col("prior"), leaf, smoothing)).otherwise(F.col("prior")).alias(f"{column}_oof"),
        )
    )
    return lookup_join(staged, codes, ["__value", "__fold"]).drop("__value", "__fold")


def fit_one_hot(df: DataFrame, column: str, threshold: float = 0.05) -> list[str]:
    """Sorted categories with at least ``threshold`` of the rows: at most 1/threshold names."""
    name = f"{column}_freq"
    kept = fit_frequency(df, column).filter(F.col(name) >= threshold)
    return sorted(r["value"] for r in kept.select("value").collect())


def transform_one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    value = as_category(column)
    columns = {f"{column}_{c}": (value == c).cast("int") for c in categories}
    columns[f"{column}_unknown"] = (~value.isin(list(categories))).cast("int") if categories else F.lit(1)
    return df.withColumns(columns)


def encoder_bundle(mappings: dict[str, DataFrame]) -> DataFrame:
    """All mappings of a fit as one table ``(feature, value, code)``, ready for Parquet."""
    out = None
    for name, mapping in mappings.items():
        code = next(c for c in mapping.columns if c != "value")
        part = mapping.select(F.lit(name).alias("feature"), "value", F.col(code).cast("double").alias("code"))
        out = part if out is None else out.unionByName(part)
    return out


def time_folds(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Expanding-window folds along time: one row per (row, fold, role)."""
    n = df.count()
    size = n // (k + 1)
    lead = n - size * k
    numbered = with_ordinal(df, order)
    start = [lead + size * i for i in range(k)]
    roles = F.array(
        *[
            F.struct(
                F.lit(i).alias("fold"),
                F.when(F.col("ordinal") < s, "train").when(F.col("ordinal") < s + size, "test").alias("role"),
            )
            for i, s in enumerate(start)
        ]
    )
    return numbered.select("*", F.explode(roles).alias("__f")).select(*numbered.columns, "__f.fold", "__f.role").filter("role IS NOT NULL")


def time_holdout(df: DataFrame, order: Sequence[str], share: float = 0.8) -> DataFrame:
    """Mark the first ``share`` of the rows along time as train, the rest as test."""
    cut = int(df.count() * share)
    role = F.when(F.col("ordinal") < cut, "train").otherwise("test")
    return with_ordinal(df, order).withColumn("role", role)


def stratified_folds(df: DataFrame, target: str, shuffle: Column, k: int, *, order: str = "id", rows_per_block: int | None = None) -> DataFrame:
    """Balanced folds per class: shuffled position within the class, modulo ``k``."""
    staged = df.withColumn("__h", shuffle)
    out = prefix_sums(staged, [target], ["__h", order], {"__pos": F.lit(1)}, inclusive=False, rows_per_block=rows_per_block)
    return out.withColumn("fold", F.pmod(F.col("__pos").cast("long"), F.lit(k)).cast("int")).drop("__h", "__pos")
