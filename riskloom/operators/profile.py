"""Profiles: one row per column, computed in one pass over all columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.bands import classify
from riskloom.functions.scalars import numeric_columns, string_columns
from riskloom.operators.aggregates import long_values, value_counts, wide_aggregate
from riskloom.operators.ordered import prefix_sums
from riskloom.operators.quality import dominance_report, missing_report
from riskloom.operators.quantiles import exact_quantiles
from riskloom.operators.rows import largest, with_row


def corrected_skewness(g1, n):
    """Bias-corrected skewness from the population form."""
    return F.when(n > 2, F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2))


def corrected_kurtosis(g2, n):
    """Bias-corrected excess kurtosis from the population form."""
    return F.when(n > 3, F.try_divide((n - 1.0) * ((n + 1.0) * g2 + 6.0), (n - 2.0) * (n - 3.0)))


def driver_rows(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of schema facts (one row per column at most)."""
    return df.sparkSession.createDataFrame(list(rows), schema)


def schema_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type, nullability, cardinality, missing share and range per column."""
    columns = list(columns or df.columns)
    numeric = set(numeric_columns(df))
    kinds = driver_rows(
        df,
        [(f.name, f.dataType.simpleString(), f.name in numeric) for f in df.schema if f.name in columns],
        "feature string, dtype string, is_numeric boolean",
    )
    spans = wide_aggregate(
        df,
        columns,
        {
            "low": lambda c: F.min(F.col(c).cast("double")) if c in numeric else F.max(F.lit(None).cast("double")),
            "high": lambda c: F.max(F.col(c).cast("double")) if c in numeric else F.max(F.lit(None).cast("double")),
        },
    )
    seen = dominance_report(df, columns).select("feature", "n_rows", "missing", F.col("n_unique").alias("cardinality"))
    return (
        kinds.join(seen, "feature")
        .join(spans, "feature")
        .select(
            "feature", "dtype", "is_numeric", (F.col("missing") > 0).alias("nullable"), "cardinality",
            (F.col("missing") * 100.0 / F.col("n_rows")).alias("missing_pct"), "low", "high",
        )
    )


def validate_schema(df: DataFrame, expected: Mapping[str, bool]) -> list[str]:
    """Errors against ``{column: is_numeric}``; extra columns are ignored."""
    numeric = set(numeric_columns(df))
    errors = [f"missing column {c}" for c in expected if c not in df.columns]
    errors += [
        f"{c} should be {'numeric' if want else 'categorical'}"
        for c, want in expected.items()
        if c in df.columns and (c in numeric) != want
    ]
    return errors


def inventory(train: DataFrame, test: DataFrame, target: str, identity: Sequence[str]) -> DataFrame:
    """Rows, column kinds, label balance and identity coverage of a pair, one row."""

    def side(df: DataFrame, name: str, with_label: bool) -> DataFrame:
        texts, bools = string_columns(df), [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
        any_id = F.lit(False)
        for c in identity:
            any_id = any_id | F.col(c).isNotNull()
        aggs = [F.count(F.lit(1)).alias(f"{name}_rows"), F.coalesce(F.sum(any_id.cast("long")), F.lit(0)).alias(f"{name}_identity_rows")]
        if with_label:
            aggs += [F.sum((F.col(target) == v).cast("long")).alias(n) for n, v in (("positives", 1), ("negatives", 0))]
        return df.agg(*aggs).withColumns(
            {
                f"{name}_numeric": F.lit(len(df.columns) - len(texts) - len(bools)),
                f"{name}_categorical": F.lit(len(texts)),
                f"{name}_boolean": F.lit(len(bools)),
            }
        )

    both = side(train, "train", True).transform(with_row, side(test, "test", False))
    pct = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b)), F.lit(0.0))
    return both.withColumns(
        {
            "positive_pct": pct("positives", "train_rows"),
            "train_identity_pct": pct("train_identity_rows", "train_rows"),
            "test_identity_pct": pct("test_identity_rows", "test_rows"),
        }
    )


def numeric_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments, quartiles, mode (smallest on ties) and both skew/kurtosis forms."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    q = driver_rows(
        df, [(c, *quartiles[c]) for c in columns], "feature string, q1 double, median double, q3 double"
    )
    v = F.col("value")
    moments = long_values(df, columns, kind="double").groupBy("feature").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("std"), F.skewness(v).alias("skew_pop"), F.kurtosis(v).alias("kurt_pop"),
    )
    modes = (
        value_counts(df, columns, kind="double")
        .groupBy("feature")
        .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"), F.count(F.lit(1)).alias("n_unique"))
    )
    n = F.col("n").cast("double")
    return (
        moments.join(q, "feature")
        .join(modes, "feature", "left")
        .withColumns(
            {
                "range": F.col("high") - F.col("low"),
                "iqr": F.col("q3") - F.col("q1"),
                "cv": F.when(F.col("mean") > 0, F.col("std") / F.col("mean")),
                "skew": corrected_skewness(F.col("skew_pop"), n),
                "kurt": corrected_kurtosis(F.col("kurt_pop"), n),
            }
        )
    )


def categorical_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Categories, most and least frequent value, dominance and entropy in nats and bits."""
    counts = value_counts(df, columns)
    known = counts.groupBy("feature").agg(F.sum("n").alias("n_known"))
    sizes = missing_report(df, columns).select("feature", "n_rows")
    p = F.col("n") / F.col("n_known")
    return (
        counts.join(F.broadcast(known), "feature")
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("n_categories"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most_frequent"),
            F.min_by("value", F.struct(F.col("n"), F.col("value"))).alias("least_frequent"),
            F.max("n").alias("dominant_count"),
            F.min("n").alias("smallest_count"),
            F.max("n_known").alias("n_known"),
            (-F.sum(p * F.log(p))).alias("entropy_nats"),
        )
        .join(sizes, "feature")
        .withColumns(
            {
                "dominant_pct": F.col("dominant_count") * 100.0 / F.col("n_rows"),
                "dominant_known_pct": F.col("dominant_count") * 100.0 / F.col("n_known"),
                "entropy_bits": F.col("entropy_nats") / F.log(F.lit(2.0)),
            }
        )
    )


def cardinality_report(df: DataFrame, columns: Sequence[str] | None = None, *, approximate: bool = False) -> DataFrame:
    """Distinct values, their share of rows and the class; exact unless asked otherwise."""
    columns = list(columns or df.columns)
    if approximate:
        out = wide_aggregate(
            df, columns, {"n_rows": lambda c: F.count(F.lit(1)), "n_unique": lambda c: F.approx_count_distinct(F.col(c))}
        )
    else:
        counts = value_counts(df, columns).groupBy("feature").agg(
            F.count(F.lit(1)).alias("n_unique"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most_common"),
            F.min_by("value", F.struct(F.col("n"), F.col("value"))).alias("least_common"),
        )
        sizes = missing_report(df, columns).select("feature", "n_rows")
        out = sizes.join(counts, "feature", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    return out.withColumns(
        {
            "unique_pct": F.coalesce(F.try_divide(F.col("n_unique") * 100.0, F.col("n_rows")), F.lit(0.0)),
            "class": classify("profile_cardinality", "n_unique"),
        }
    )


def with_family(report: DataFrame, families: Mapping[str, str]) -> DataFrame:
    lookup = F.create_map(*[x for c, fam in families.items() for x in (F.lit(c), F.lit(fam))])
    return report.withColumn("family", lookup[F.col("feature")])


def completeness_summary(df: DataFrame) -> DataFrame:
    """Overall, mean per-row and worst-row completeness in percent, one row."""
    k = float(len(df.columns))
    present = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.sum(present) * 100.0 / (F.count(F.lit(1)) * k)).alias("overall_pct"),
        F.avg(present * 100.0 / k).alias("mean_row_pct"),
        F.min(present * 100.0 / k).alias("worst_row_pct"),
    )


def profile_advice(cardinality: DataFrame, missing: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Advice rows for empty, mostly missing, constant and string columns."""
    share = missing.select("feature", (F.lit(100.0) - F.col("missing_pct")).alias("complete_pct"))
    both = cardinality.join(share, "feature")
    is_text = F.col("feature").isin(list(texts))
    rules = [
        ("Potential Removal", F.col("complete_pct") == 0),
        ("High Missingness Warning", (F.col("complete_pct") > 0) & (F.col("complete_pct") < 10)),
        ("Constant Feature", F.col("class") == "Constant"),
        ("Target Encoding", is_text & (F.col("class") == "High Cardinality")),
        ("One-Hot Encoding", is_text & F.col("class").isin("Binary", "Low Cardinality")),
    ]
    advice = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    return both.select("feature", F.explode(advice).alias("advice"))


def feature_dictionary(cardinality: DataFrame, missing: DataFrame, advice: DataFrame) -> DataFrame:
    """Cardinality and completeness joined, with one line of processing advice."""
    first = advice.groupBy("feature").agg(F.min("advice").alias("advice"))
    text = F.coalesce(
        "advice",
        F.when(F.col("class") == "High Cardinality", "Numerical scaling or robust target encoding.").otherwise(
            "Pass through as baseline feature."
        ),
    )
    return (
        cardinality.join(missing.select("feature", "missing_pct"), "feature")
        .join(first, "feature", "left")
        .select("feature", "n_unique", "class", (F.lit(100.0) - F.col("missing_pct")).alias("complete_pct"), text.alias("processing"))
    )


# --- categorical views ------------------------------------------------------------


def category_frequencies(df: DataFrame, columns: Sequence[str], *, rows_per_block: int | None = None) -> DataFrame:
    """Every known category with its count, percent, cumulative percent and rank from the most frequent.

    Categories of equal count follow each other in their own order.
    """
    counts = value_counts(df, columns).withColumn("__down", -F.col("n"))
    ranked = prefix_sums(
        counts, ["feature"], ["__down", "value"], {"upto": F.col("n"), "rank": F.lit(1)}, rows_per_block=rows_per_block
    )
    # One row per column.
    totals = F.broadcast(counts.groupBy("feature").agg(F.sum("n").alias("total")))
    return ranked.join(totals, "feature").select(
        "feature", F.col("value").alias("category"), "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"),
        (F.col("upto") * 100.0 / F.col("total")).alias("cumulative_pct"), F.col("rank").cast("long").alias("rank"),
    )


def categorical_inventory(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Categories, missing count and percent, and the dominant category with its percent of the known rows."""
    counts = long_values(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    n_known, gone = F.sum(F.when(known, F.col("n")).otherwise(0)), F.sum(F.when(known, 0).otherwise(F.col("n")))
    top = F.struct(-F.col("n"), F.col("value"))
    return counts.groupBy("feature").agg(
        F.count_if(known).alias("n_categories"), gone.alias("missing_count"), (gone * 100.0 / F.sum("n")).alias("missing_pct"),
        F.min_by("value", F.when(known, top)).alias("dominant_category"),
        (F.max(F.when(known, F.col("n"))) * 100.0 / n_known).alias("dominant_pct"),
    )


def rare_categories(df: DataFrame, columns: Sequence[str], limit: float = 0.01, examples: int = 10) -> DataFrame:
    """Categories below ``limit`` of the known rows: how many, their rows, and names of the largest as ``examples``."""
    counts = value_counts(df, columns)
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    rare = counts.join(F.broadcast(totals), "feature").filter(F.col("n") < F.col("total") * limit)
    # A row_number limit is applied before the shuffle too, so at most that many
    # names per feature and task are ever kept.
    first = Window.partitionBy("feature").orderBy(F.col("n").desc(), "value")
    names = (
        rare.withColumn("__r", F.row_number().over(first))
        .filter(F.col("__r") <= examples)
        .groupBy("feature")
        .agg(F.array_sort(F.collect_list(F.struct("__r", "value"))).alias("names"))
    )
    out = rare.groupBy("feature").agg(F.count(F.lit(1)).alias("n_rare"), F.sum("n").alias("rare_rows"))
    zero = F.lit(0).cast("long")
    rows = F.coalesce(F.col("rare_rows"), zero)
    return totals.join(out, "feature", "left").join(names, "feature", "left").select(
        "feature",
        F.coalesce("n_rare", zero).alias("n_rare"),
        rows.alias("rare_rows"),
        (rows * 100.0 / F.col("total")).alias("rare_pct"),
        F.coalesce(F.array_join(F.transform("names", lambda x: x["value"]), ", "), F.lit("")).alias("examples"),
    )


def category_imbalance(stats: DataFrame) -> DataFrame:
    """Dominant and smallest share, ratio, entropy and diversity from categorical statistics."""
    k = F.col("n_categories")
    return stats.select(
        "feature",
        F.col("dominant_known_pct").alias("dominant_pct"),
        (F.col("smallest_count") * 100.0 / F.col("n_known")).alias("smallest_pct"),
        (F.col("dominant_count") / F.col("smallest_count")).alias("imbalance_ratio"),
        F.col("entropy_bits"),
        F.when(k > 1, F.col("entropy_bits") / (F.log(k.cast("double")) / F.log(F.lit(2.0)))).otherwise(0.0).alias("diversity"),
    )


def transformation_advice(stats: DataFrame) -> DataFrame:
    """Suggested transformation from skew, kurtosis and the minimum."""
    skew, kurt = F.col("skew"), F.col("kurt")
    advice = (
        F.when((skew > 1) & (F.col("low") >= 0), "Log Transformation (log1p)")
        .when(skew > 1, "Yeo-Johnson")
        .when(skew < -1, "Quantile Transformation")
        .when(classify("kurtosis", kurt) == "Heavy-Tailed", "Robust Scaler (IQR-based)")
        .otherwise("No Transformation")
    )
    return stats.select(
        "feature", "skew", "kurt", classify("skewness", skew, "N/A").alias("skew_type"),
        classify("kurtosis", kurt, "N/A").alias("kurt_type"), advice.alias("advice"),
    )


def distribution_shape(stats: DataFrame) -> DataFrame:
    a = F.abs("skew")
    shape = (
        F.when(F.col("n_unique") <= 1, "Near-Constant")
        .when(a > 2, "Highly Skewed")
        .when(a > 0.5, "Moderately Skewed")
        .otherwise("Symmetric")
    )
    return stats.select("feature", "skew", "n_unique", shape.alias("shape"))


def encoding_choice(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = value_counts(df, columns).groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"))
    return counts.withColumn("strategy", classify("encoding_strategy", "n_unique"))


def candidate_columns(stats: DataFrame, k: int | None = None) -> DataFrame:
    """Numeric columns with more than one value: all, or the ``k`` with the largest variance."""
    varied = stats.filter((F.col("n_unique") > 1) & F.col("variance").isNotNull())
    return largest(varied, [F.col("variance").desc(), "feature"], k).select("feature", "variance", "n_unique")


def candidate_categoricals(
    cardinality: DataFrame, texts: Sequence[str], k: int | None = None, values: tuple[int, int] = (2, 29)
) -> DataFrame:
    """Text columns whose number of distinct values lies in ``values``: all, or the ``k`` with the fewest."""
    chosen = cardinality.filter(F.col("feature").isin(list(texts)) & F.col("n_unique").between(*values))
    return largest(chosen, ["n_unique", "feature"], k).select("feature", "n_unique")


