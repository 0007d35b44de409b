"""Grouped aggregates shared by the profilers, encoders and audits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import col
from riskloom.operators.joins import lookup_join
from riskloom.operators.quantiles import grouped_quantiles
from riskloom.operators.rows import with_row

ENTITY_STATS = ["mean", "median", "std", "min", "max", "count"]
COLUMNS_PER_PASS = 200


def with_total(counts: DataFrame, value: str, out: str = "total") -> DataFrame:
    """Add the sum of ``value`` over all rows: a one-row side, not a global window."""
    return counts.transform(with_row, counts.agg(F.sum(value).alias(out)))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    share = F.round(F.lit(100.0) * F.col("n") / F.col("total"), 6)
    return with_total(counts, "n").select(column, "n", share.alias("pct"))


def wide_aggregate(
    df: DataFrame, columns: Sequence[str], stats: Mapping[str, Callable[[str], Column]]
) -> DataFrame:
    """All statistics of all columns in one aggregate, returned one row per column.

    Very wide frames are cut into passes of ``COLUMNS_PER_PASS`` columns.
    """
    passes = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        part = columns[start : start + COLUMNS_PER_PASS]
        one = df.agg(*[make(c).alias(f"{i}|{s}") for i, c in enumerate(part) for s, make in stats.items()])
        rows = F.array(
            *[
                F.struct(F.lit(c).alias("feature"), *[F.col(f"{i}|{s}").alias(s) for s in stats])
                for i, c in enumerate(part)
            ]
        )
        passes.append(one.select(F.explode(rows).alias("r")).select("r.*"))
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def long_values(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str | Column] = (), kind: str = "string"
) -> DataFrame:
    """Unpivot to ``(keep..., feature, value)`` with every value cast to ``kind``."""
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in columns]
    )
    return df.select(*keep, F.explode(rows).alias("__r")).select("*", "__r.feature", "__r.value").drop("__r")


def few_valued(df: DataFrame, columns: Sequence[str], limit: int) -> set[str]:
    """Columns with at most ``limit`` distinct values.

    A sketch rules out the columns that clearly have more; only the others are
    counted exactly.
    """
    rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    close = [c for c in columns if rough[c] <= 2 * limit + 50]
    if not close:
        return set()
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in close]).first()
    return {c for c in close if exact[c] <= limit}


def value_counts(df: DataFrame, columns: Sequence[str], kind: str = "string") -> DataFrame:
    """``(feature, value, n)`` of all non-null values."""
    return (
        long_values(df, columns, kind=kind)
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- entity statistics --------------------------------------------------------


def entity_stats(
    df: DataFrame, key: str, value: str, stats: Sequence[str] = ENTITY_STATS, prefix: str | None = None
) -> DataFrame:
    """Fit: one row per non-null key. A single row has a standard deviation of 0."""
    prefix = prefix or f"{key}_{value}"
    known = df.filter(F.col(key).isNotNull())
    v = F.col(value)
    simple = {
        "mean": F.avg(v),
        "std": F.coalesce(F.stddev_samp(v), F.lit(0.0)),
        "min": F.min(v),
        "max": F.max(v),
        "count": F.count(v),
    }
    wanted = {s: simple[s] for s in stats if s != "median"}
    out = known.groupBy(key).agg(*[c.alias(f"{prefix}_{s}") for s, c in wanted.items()])
    if "median" in stats:
        out = out.join(grouped_quantiles(known, [key], value, {f"{prefix}_median": 0.5}), key, "left")
    return out.select(key, *[f"{prefix}_{s}" for s in stats])


def attach_entity_stats(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Transform: unseen keys get count 0, std 0, else the plain mean over the groups."""
    names = [c for c in stats.columns if c != key]
    averaged = [c for c in names if not c.endswith(("_count", "_std"))]
    out = lookup_join(df, stats, [key])
    if averaged:
        defaults = stats.agg(*[F.avg(c).alias(f"__d_{c}") for c in averaged])
        out = out.transform(with_row, defaults)
    filled = {}
    for c in names:
        fallback = F.col(f"__d_{c}") if c in averaged else F.lit(0)
        filled[c] = F.coalesce(F.col(c), fallback)
    return out.withColumns(filled).drop(*[f"__d_{c}" for c in averaged])


def with_frequency(df: DataFrame, key: str, out: str, null_label: str | None = None) -> DataFrame:
    """Group size of each row's key; a null key gives 0, or its own group when labelled."""
    keyed = F.col(key) if null_label is None else F.coalesce(F.col(key).cast("string"), F.lit(null_label))
    staged = df.withColumn("__k", keyed)
    counts = staged.filter(F.col("__k").isNotNull()).groupBy("__k").agg(F.count(F.lit(1)).alias(out))
    joined = lookup_join(staged, counts, ["__k"])
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(0))).select(*df.columns, out)


# --- scaling and two-valued columns -------------------------------------------

Scaler = dict[str, tuple[float, float]]


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standard_scale(df: DataFrame, scaler: Scaler, suffix: str = "_z") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c) - m) / s for c, (m, s) in scaler.items()})


def two_values(df: DataFrame, column: str) -> list[str]:
    """The sorted distinct values of a column that has at most two."""
    values = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(3).collect()]
    if len(values) > 2:
        raise ValueError(f"{column} has more than two values")
    return sorted(values)


def as_binary(column: Column | str, values: Sequence[str]) -> Column:
    """Position of the value in the sorted pair; unseen values become null."""
    chain = F.when(col(column) == values[0], 0)
    return chain.when(col(column) == values[1], 1) if len(values) > 1 else chain
