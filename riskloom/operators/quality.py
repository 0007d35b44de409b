"""Data quality: clean-up, audits, gates and the overall score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.bands import classify
from riskloom.functions.scalars import finite, numeric_columns, string_columns
from riskloom.operators.aggregates import value_counts, wide_aggregate
from riskloom.operators.quantiles import exact_quantiles
from riskloom.operators.rows import with_row

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
FLOAT32_MAX = 3.4028234663852886e38
# Texts that only look like a value.
FAKE_NULLS = ["nan", "null", "none", "undefined", ""]


def _of_type(df: DataFrame, kinds: tuple) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


# --- clean-up -----------------------------------------------------------------


def drop_infinities(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column, in one projection."""
    floating = set(_of_type(df, FLOATING))
    return df.select(*[(finite(c).cast(df.schema[c].dataType).alias(c) if c in floating else F.col(c)) for c in df.columns])


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("-", "_") for c in df.columns])


def narrow_types(df: DataFrame) -> DataFrame:
    """Smallest integer type per column and float for doubles in range, after one min/max pass."""
    whole, real = _of_type(df, INTEGRAL), _of_type(df, FLOATING)
    if not whole and not real:
        return df
    span = df.agg(*[f(c).alias(f"{n}|{c}") for c in [*whole, *real] for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def target(c: str) -> str | None:
        low, high = span[f"lo|{c}"], span[f"hi|{c}"]
        if low is None:
            return None
        if c in real:
            return "float" if -FLOAT32_MAX <= low and high <= FLOAT32_MAX else "double"
        for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
            if -(1 << bits) <= low and high < (1 << bits):
                return name
        return "bigint"

    kinds = {c: target(c) for c in [*whole, *real]}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if kinds.get(c) else F.col(c) for c in df.columns])


def impute(df: DataFrame, strategy: str = "none", columns: Sequence[str] | None = None) -> DataFrame:
    if strategy == "none":
        return df
    columns = list(columns or numeric_columns(df))
    if strategy == "median":
        fill = {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}
    elif strategy == "mean":
        fill = df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    else:
        raise ValueError(f"unknown imputation strategy {strategy!r}")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items() if v is not None})


# --- missing and infinite -----------------------------------------------------


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing and available counts and shares per column, in one pass."""
    columns = list(columns or df.columns)
    out = wide_aggregate(
        df, columns, {"n_rows": lambda c: F.count(F.lit(1)), "available": lambda c: F.count(F.col(c))}
    )
    missing = F.col("n_rows") - F.col("available")
    pct = F.coalesce(F.try_divide(missing * 100.0, F.col("n_rows")), F.lit(0.0))
    return out.select(
        "feature", "n_rows", "available", missing.alias("missing"), pct.alias("missing_pct")
    ).withColumns(
        {"level": classify("missing_level", "missing_pct"), "action": classify("missing_action", "missing_pct")}
    )


def missing_comparison(train: DataFrame, test: DataFrame, columns: Sequence[str], limit: float = 5.0) -> DataFrame:
    left = missing_report(train, columns).select("feature", F.col("missing_pct").alias("train_pct"))
    right = missing_report(test, columns).select("feature", F.col("missing_pct").alias("test_pct"))
    gap = F.abs(F.col("train_pct") - F.col("test_pct"))
    return left.join(right, "feature").withColumns({"abs_diff": gap, "is_drifted": gap > limit})


def family_missingness(report: DataFrame, families: Mapping[str, str]) -> DataFrame:
    """Mean, max and min missing share and missing cells per column family."""
    lookup = F.create_map(*[x for c, fam in families.items() for x in (F.lit(c), F.lit(fam))])
    return report.withColumn("family", lookup[F.col("feature")]).groupBy("family").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.avg("missing_pct").alias("avg_pct"),
        F.max("missing_pct").alias("max_pct"),
        F.min("missing_pct").alias("min_pct"),
        F.sum("missing").alias("missing_cells"),
    )


def discover_indicators(df: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    share = F.col("missing_pct") / 100.0
    return missing_report(df).filter((share >= low) & (share <= high)).select("feature", share.alias("ratio"))


def infinite_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or _of_type(df, FLOATING))
    return wide_aggregate(
        df,
        columns,
        {"n_infinite": lambda c: F.sum(F.when(F.abs(F.col(c)) == float("inf"), 1).otherwise(0))},
    )


def missing_gate(df: DataFrame, max_ratio: float = 0.95) -> DataFrame:
    """Columns with too many nulls or any infinity."""
    infinite = infinite_report(df) if _of_type(df, FLOATING) else None
    out = missing_report(df).select("feature", (F.col("missing_pct") / 100.0).alias("ratio"))
    if infinite is not None:
        out = out.join(infinite, "feature", "left")
    else:
        out = out.withColumn("n_infinite", F.lit(0))
    bad_null = F.col("ratio") > max_ratio
    bad_inf = F.coalesce(F.col("n_infinite"), F.lit(0)) > 0
    return out.select(
        "feature",
        "ratio",
        F.coalesce("n_infinite", F.lit(0)).cast("long").alias("n_infinite"),
        F.when(bad_null | bad_inf, "FAIL").otherwise("PASS").alias("status"),
    )


def feature_gate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls, infinities and constants per feature; constants do not change the status."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("duplicate column names")
    columns = list(columns or df.columns)
    numeric = set(_of_type(df, FLOATING))
    none = F.lit(0).cast("long")
    out = wide_aggregate(
        df,
        columns,
        {
            "n_null": lambda c: F.sum(F.col(c).isNull().cast("long")),
            "n_infinite": lambda c: F.sum((F.abs(F.col(c)) == float("inf")).cast("long")) if c in numeric else F.max(none),
            "is_constant": lambda c: F.min(F.col(c)).eqNullSafe(F.max(F.col(c))),
        },
    )
    bad = (F.col("n_null") > 0) | (F.coalesce("n_infinite", none) > 0)
    return out.select(
        "feature",
        "n_null",
        F.coalesce("n_infinite", none).alias("n_infinite"),
        "is_constant",
        F.when(bad, "WARN").otherwise("PASS").alias("status"),
    )


# --- duplicates, constants, invalid values --------------------------------------


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> Column | DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
    )


def duplicate_audit(df: DataFrame, id_col: str) -> DataFrame:
    """Repeated rows by full content, by id, and by content without the id."""
    checks = {"full_row": df.columns, "id": [id_col], "payload": [c for c in df.columns if c != id_col]}
    parts = [duplicate_rows(df, cols).withColumn("kind", F.lit(kind)) for kind, cols in checks.items()]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    pct = F.coalesce(F.try_divide(F.col("duplicates") * 100.0, F.col("n_rows")), F.lit(0.0))
    return out.select("kind", "duplicates", "n_rows", pct.alias("pct"))


def identical_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairs of columns that hold the same value in every row, null equal to null.

    One pass takes an order-insensitive fingerprint per column; equal
    fingerprints are then confirmed by counting rows that differ.
    """
    columns = list(columns or df.columns)
    prints = df.agg(
        *[F.sum(F.xxhash64(F.col(c).cast("string")).cast("decimal(38,0)")).alias(str(i)) for i, c in enumerate(columns)]
    ).first()
    pairs = [
        (i, j)
        for i in range(len(columns))
        for j in range(i + 1, len(columns))
        if prints[str(i)] == prints[str(j)]
    ]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "left_column string, right_column string")
    differ = [
        F.sum((~F.col(columns[i]).cast("string").eqNullSafe(F.col(columns[j]).cast("string"))).cast("long")).alias(f"{i}|{j}")
        for i, j in pairs
    ]
    checks = F.array(
        *[
            F.struct(
                F.lit(columns[i]).alias("left_column"),
                F.lit(columns[j]).alias("right_column"),
                F.col(f"{i}|{j}").alias("n_differ"),
            )
            for i, j in pairs
        ]
    )
    return (
        df.agg(*differ).select(F.explode(checks).alias("p")).select("p.*")
        .filter(F.coalesce("n_differ", F.lit(0)) == 0)
        .select("left_column", "right_column")
    )


def dominance_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values and the share of the most frequent one (of all rows) per column."""
    columns = list(columns or df.columns)
    seen = value_counts(df, columns).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.max("n").alias("dominant_count"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("dominant_value"),
    )
    sizes = missing_report(df, columns).select("feature", "n_rows", "missing")
    return sizes.join(seen, "feature", "left").select(
        "feature",
        "n_rows",
        "missing",
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        "dominant_value",
        F.coalesce(F.try_divide(F.col("dominant_count"), F.col("n_rows")), F.lit(0.0)).alias("dominant_ratio"),
    )


def constant_columns(report: DataFrame) -> DataFrame:
    return report.filter(F.col("n_unique") <= 1)


def near_constant_columns(report: DataFrame, limit: float = 0.99) -> DataFrame:
    return report.filter((F.col("dominant_ratio") >= limit) & (F.col("n_unique") > 1))


def invalid_values(df: DataFrame, non_negative: Sequence[str], texts: Sequence[str] | None = None) -> DataFrame:
    """Negative numbers where none are allowed, and texts that fake a null."""
    texts = list(string_columns(df) if texts is None else texts)
    checks = {c: F.col(c) < 0 for c in non_negative}
    checks |= {c: F.lower(F.trim(F.col(c))).isin(FAKE_NULLS) for c in texts}
    return wide_aggregate(
        df, list(checks), {"n_invalid": lambda c: F.sum(F.coalesce(checks[c].cast("long"), F.lit(0)))}
    )


# --- outliers -------------------------------------------------------------------


def outlier_report(
    df: DataFrame, columns: Sequence[str], iqr_factor: float = 1.5, z_limit: float = 3.0
) -> DataFrame:
    """Outliers by quartile range, z-score and the 1st/99th percentiles; all limits strict."""
    q = exact_quantiles(df, columns, [0.25, 0.75, 0.01, 0.99])
    m = df.agg(*[F.avg(c).alias(f"m|{c}") for c in columns], *[F.stddev_samp(c).alias(f"s|{c}") for c in columns]).first()

    def outside(c: str, low: float | None, high: float | None) -> Column:
        if low is None:
            return F.lit(0).cast("long")
        return ((F.col(c) < low) | (F.col(c) > high)).cast("long")

    def by_iqr(c: str) -> Column:
        a, b = q[c][:2]
        if a is None:
            return F.lit(0).cast("long")
        return outside(c, a - iqr_factor * (b - a), b + iqr_factor * (b - a))

    def by_z(c: str) -> Column:
        sd = m[f"s|{c}"]
        if not sd:
            return F.lit(0).cast("long")
        return (F.abs((F.col(c) - m[f"m|{c}"]) / sd) > z_limit).cast("long")

    total = lambda flag: F.coalesce(F.sum(flag), F.lit(0))
    out = wide_aggregate(
        df,
        columns,
        {
            "n": lambda c: F.count(F.col(c)),
            "iqr_outliers": lambda c: total(by_iqr(c)),
            "z_outliers": lambda c: total(by_z(c)),
            "pct_outliers": lambda c: total(outside(c, *q[c][2:])),
        },
    )
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("n")), F.lit(0.0))
    return out.withColumns({f"{k}_share": share(k) for k in ("iqr_outliers", "z_outliers", "pct_outliers")})


def sigma_gate(
    df: DataFrame, columns: Sequence[str], sigma: float = 4.0, bounds: Mapping[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Rows beyond ``sigma`` deviations or outside given bounds, and constants."""
    bounds = bounds or {}
    m = df.agg(*[F.avg(c).alias(f"m|{c}") for c in columns], *[F.stddev_samp(c).alias(f"s|{c}") for c in columns]).first()
    zero = F.lit(0).cast("long")

    def beyond(c: str) -> Column:
        mean, sd = m[f"m|{c}"], m[f"s|{c}"]
        return (F.abs(F.col(c) - mean) > sigma * sd).cast("long") if sd else zero

    def out_of_bounds(c: str) -> Column:
        return (~F.col(c).between(*bounds[c])).cast("long") if c in bounds else zero

    out = wide_aggregate(
        df,
        columns,
        {
            "n_sigma": lambda c: F.coalesce(F.sum(beyond(c)), zero),
            "n_out_of_bounds": lambda c: F.coalesce(F.sum(out_of_bounds(c)), zero),
            "is_constant": lambda c: F.min(F.col(c)).eqNullSafe(F.max(F.col(c))),
        },
    )
    return out


# --- schema consistency -----------------------------------------------------------


def _family(kind: T.DataType) -> str:
    return "numeric" if isinstance(kind, (*INTEGRAL, *FLOATING, T.DecimalType)) else "other"


def schema_differences(
    train: DataFrame, test: DataFrame, ignore: Sequence[str] = (), *, by_family: bool = False
) -> list[tuple[str, str]]:
    """(column, problem) pairs; only the schemas are read.

    Types are compared exactly, or only as numeric against other ``by_family``.
    """
    kind = _family if by_family else (lambda t: t.simpleString())
    left = {f.name: f.dataType for f in train.schema if f.name not in ignore}
    right = {f.name: f.dataType for f in test.schema if f.name not in ignore}
    out = [(c, "only in train") for c in left if c not in right]
    out += [(c, "only in test") for c in right if c not in left]
    out += [(c, "type mismatch") for c in left if c in right and kind(left[c]) != kind(right[c])]
    names = [*train.columns, *test.columns]
    out += [(c, "duplicate name") for c in sorted(set(names)) if train.columns.count(c) > 1 or test.columns.count(c) > 1]
    return out


def consistency_report(train: DataFrame, test: DataFrame, id_col: str, target: str) -> DataFrame:
    """Schema differences and id uniqueness of a train/test pair, one row."""
    problems = schema_differences(train, test, ignore=[target])
    count = lambda kind: sum(p == kind for _, p in problems)
    left = duplicate_rows(train, [id_col]).select(F.col("duplicates").alias("train_duplicate_ids"), F.col("n_rows").alias("train_rows"))
    right = duplicate_rows(test, [id_col]).select(F.col("duplicates").alias("test_duplicate_ids"), F.col("n_rows").alias("test_rows"))
    return left.transform(with_row, right).select(
        "*",
        F.lit(count("only in train")).alias("only_in_train"),
        F.lit(count("only in test")).alias("only_in_test"),
        F.lit(count("type mismatch")).alias("type_mismatches"),
    )


# Fixed values: (metric, penalty per unit, weight) of the quality score.
SCORE_PARTS = [
    ("missing_pct", 2.0, 0.25),
    ("duplicate_pct", 5.0, 0.15),
    ("invalid_count", 10.0, 0.20),
    ("constant_pct", 5.0, 0.10),
    ("near_constant_pct", 3.0, 0.10),
    ("outlier_pct", 1.0, 0.10),
    ("schema_problems", 10.0, 0.10),
]


def quality_score(metrics: DataFrame) -> DataFrame:
    """Weighted score of 0..100 from a one-row metrics frame."""
    parts = {m: F.greatest(F.lit(0.0), F.lit(100.0) - F.col(m) * penalty) for m, penalty, _ in SCORE_PARTS}
    total = sum((parts[m] * weight for m, _, weight in SCORE_PARTS), F.lit(0.0))
    return metrics.select(
        *[c.alias(f"{m}_score") for m, c in parts.items()], total.alias("score")
    ).withColumn("rating", classify("quality_rating", "score"))


def quality_run(df: DataFrame, id_col: str, near_constant: float = 0.999) -> tuple[DataFrame, dict[str, list[str]]]:
    """Duplicate rows, infinities, constant, near-constant and repeated columns, in that order."""
    clean = drop_infinities(df)
    report = dominance_report(clean)
    constant = [r.feature for r in constant_columns(report).select("feature").collect()]
    flat = [r.feature for r in near_constant_columns(report, near_constant).select("feature").collect()]
    kept = [c for c in clean.columns if c not in {*constant, *flat} or c == id_col]
    same = [r.right_column for r in identical_columns(clean, kept).collect()]
    dropped = {"constant": sorted(constant), "near_constant": sorted(flat), "identical": sorted(set(same))}
    return clean.select(*[c for c in kept if c not in same or c == id_col]), dropped


def contract_check(df: DataFrame, required: Sequence[str], max_null: float = 0.5) -> DataFrame:
    """Required columns exist and are not mostly null."""
    present = [c for c in required if c in df.columns]
    absent = [c for c in required if c not in df.columns]
    out = missing_report(df, present).select(
        "feature",
        (F.col("missing_pct") / 100.0).alias("null_ratio"),
        F.when(F.col("missing_pct") / 100.0 > max_null, "TOO MANY NULLS").otherwise("OK").alias("status"),
    )
    if absent:
        names = F.explode(F.array(*[F.lit(c) for c in absent])).alias("feature")
        lost = df.limit(1).select(names).distinct()
        out = out.unionByName(lost.select("feature", F.lit(1.0).alias("null_ratio"), F.lit("ABSENT").alias("status")))
    return out


def feature_health(df: DataFrame, columns: Sequence[str], limit: float) -> DataFrame:
    """Null rate per feature, whether it breaks the limit, and the worst rate."""
    rates = missing_report(df, columns).select("feature", (F.col("missing_pct") / 100.0).alias("null_rate"))
    worst = rates.agg(F.max("null_rate").alias("max_null_rate"))
    return rates.transform(with_row, worst).withColumn("is_unhealthy", F.col("null_rate") > limit)
