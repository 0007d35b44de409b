"""Correlation matrices, target correlation, redundancy and leakage scores."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.bands import classify
from riskloom.functions.scalars import numeric_columns
from riskloom.operators.aggregates import long_values, wide_aggregate
from riskloom.operators.joins import BROADCAST_ROWS, lookup_join
from riskloom.operators.ordered import prefix_sums
from riskloom.operators.quality import missing_report
from riskloom.operators.rows import with_row
from riskloom.operators.stats import rank_tests, value_ranks
from riskloom.session import cut_lineage

def _r(x: str, y: str) -> Column:
    """Pearson r of two complete columns; 0 when either does not vary."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def _gram(rows: DataFrame, names: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """``(left, right, r)`` of pairs of positions of the arrays ``v``, over rows where both are known.

    Each task sums n, x, y, xx, yy and xy of its rows as products of the value
    matrix and the matrix of known entries, so the plan does not grow with the
    number of columns; the sums of the tasks are added per pair.
    """
    width, left, right = len(names), np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(left)))
        for batch in batches:
            values = batch.column(0).flatten()
            known = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
            x = values.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
            counts, products, one, two = known.T @ known, x.T @ x, x.T @ known, (x * x).T @ known
            total += np.stack((counts[left, right], one[left, right], one[right, left],
                               two[left, right], two[right, left], products[left, right]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *[pa.array(t) for t in total]],
            names=["l", "r", "n", "x", "y", "xx", "yy", "xy"])

    added = rows.select("v").mapInArrow(sums, "l int, r int, " + ", ".join(f"{c} double" for c in ("n", "x", "y", "xx", "yy", "xy")))
    added = added.groupBy("l", "r").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    mean = lambda c: F.try_divide(F.col(c), F.col("n"))
    # What rounding leaves of a column that does not vary is no variance.
    spread = lambda c: F.when(mean(c + c) - mean(c) * mean(c) > 1e-13 * mean(c + c), mean(c + c) - mean(c) * mean(c))
    value = F.try_divide(mean("xy") - mean("x") * mean("y"), F.sqrt(spread("x")) * F.sqrt(spread("y")))
    named = F.array(*[F.lit(c) for c in names])
    return added.select(F.get(named, F.col("l")).alias("left"), F.get(named, F.col("r")).alias("right"), F.coalesce(value, F.lit(0.0)).alias("r"))


def pearson_pairs(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Pearson r of all column pairs (or of ``pairs``) over rows where both are known; 0 when either does not vary."""
    pairs = _pairs(columns) if pairs is None else list(pairs)
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, r double")
    used = list(dict.fromkeys(c for pair in pairs for c in pair))
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in used]).first()
    centred = [F.col(c).cast("double") - F.lit(means[c] if means[c] is not None and math.isfinite(means[c]) else 0.0) for c in used]
    at = {c: i for i, c in enumerate(used)}
    return _gram(df.select(F.array(*centred).alias("v")), used, [(at[a], at[b]) for a, b in pairs])


def _mask_classes(df: DataFrame, columns: Sequence[str]) -> list[list[str]]:
    """Columns that are null in the same rows, class by class; two hashed sums over the nulls tell classes apart."""
    row = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")
    marks = df.agg(*[F.struct(F.count_if(F.col(c).isNull()), F.sum(F.when(F.col(c).isNull(), row))).alias(c) for c in columns]).first()
    classes: dict[tuple, list[str]] = {}
    for c in columns:
        classes.setdefault(tuple(marks[c]), []).append(c)
    return list(classes.values())


def spearman_pairs(df: DataFrame, columns: Sequence[str], *, rows_per_block: int | None = None) -> DataFrame:
    """Pearson r of average ranks, each pair ranked and summed over the rows where both columns are known.

    A rank depends on which rows count, so a column is ranked once for every
    class of columns that are null in the same rows. All ranks come from one
    table of value counts and are looked up column by column.
    """
    pairs = _pairs(columns)
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, r double")
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    classes = _mask_classes(rows, columns)
    of = {c: k for k, group in enumerate(classes) for c in group}
    # (column, class): the column ranked among the rows where the class is known, too.
    ranked = list(dict.fromkeys(x for a, b in pairs for x in ((a, of[b]), (b, of[a]))))
    known = [F.when(F.col(classes[k][0]).isNotNull(), F.col(c)) for c, k in ranked]
    entries = F.array(*[F.struct(F.lit(i).alias("feature"), value.alias("value")) for i, value in enumerate(known)])
    long = rows.select(F.explode(entries).alias("e")).select("e.*").filter(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = value_ranks(counts, F.col("n"), rows_per_block=rows_per_block).select("feature", "value", "rank")
    # Ranks around their middle keep the sums small.
    sizes = ranks.groupBy("feature").agg(F.avg("rank").alias("middle"), F.count(F.lit(1)).alias("n")).collect()  # a row for each column
    of_feature = {r["feature"]: r for r in sizes}
    wide = rows
    for i, value in enumerate(known):
        middle, n = (of_feature[i]["middle"], of_feature[i]["n"]) if i in of_feature else (0.0, 0)
        side = ranks.filter(F.col("feature") == i).select(F.col("value").alias("__value"), (F.col("rank") - F.lit(middle)).alias(f"__r{i}"))
        side = F.broadcast(side) if n <= BROADCAST_ROWS else side
        wide = wide.join(side, value == F.col("__value"), "left").drop("__value")
    wide = wide.select(F.array(*[f"__r{i}" for i in range(len(ranked))]).alias("v"))
    at = {x: i for i, x in enumerate(ranked)}
    return _gram(wide, [c for c, _ in ranked], [(at[a, of[b]], at[b, of[a]]) for a, b in pairs])


def kendall_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], *, rows_per_block: int | None = None) -> DataFrame:
    """Kendall tau-b of column pairs on the full data, all in one job and without forming pairs of rows.

    Counts of distinct (pair, x, y) are split by the bits of the rank of x: two
    values of x differ first at exactly one bit, and at that bit one falls into
    the lower and one into the upper half of the same prefix.  Per (pair, bit,
    prefix) a running sum along y counts the concordant and discordant pairs, so
    the cost is rows x log(distinct x) and every running sum is cut into blocks.
    A pair counts the rows where both are known and not NaN; without any, and
    where either column does not vary, tau is 0.
    """
    pairs = list(pairs)
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, tau double")
    at = {c: i for i, c in enumerate(dict.fromkeys(c for pair in pairs for c in pair))}
    known = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in at])
    entries = F.array(*[
        F.struct(F.lit(i).alias("pair"), F.lit(at[a]).alias("feature"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)
    ])
    cells = known.select(F.explode(entries).alias("e")).select("e.*").filter("x IS NOT NULL AND y IS NOT NULL")
    cells = cut_lineage(cells.groupBy("pair", "feature", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    sums = _concordance(cells, rows_per_block)
    tied = lambda key: cells.groupBy("pair", key).agg(F.sum("n").cast("double").alias("k")).groupBy("pair").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias(f"t{key}"))
    total = cells.groupBy("pair").agg(F.sum("n").cast("double").alias("m")).select("pair", (F.col("m") * (F.col("m") - 1) / 2).alias("all"))
    names = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(a).alias("left"), F.lit(b).alias("right")) for i, (a, b) in enumerate(pairs)])
    out = df.sparkSession.range(1).select(F.explode(names).alias("e")).select("e.*")
    for part in (sums, tied("x"), tied("y"), total):  # a row for each pair
        out = out.join(part, "pair", "left")
    tau = F.try_divide(F.col("c") - F.col("dc"), F.sqrt((F.col("all") - F.col("tx")) * (F.col("all") - F.col("ty"))))
    return out.select("left", "right", F.coalesce(tau, F.lit(0.0)).alias("tau"))


def _concordance(cells: DataFrame, rows_per_block: int | None) -> DataFrame:
    """``(pair, c, dc)``: concordant and discordant pairs of rows of ``cells(pair, feature, x, y, n)``."""
    values = cells.select("feature", "x").distinct()
    codes = prefix_sums(values, ["feature"], ["x"], {"code": F.lit(1)}, inclusive=False, rows_per_block=rows_per_block)
    codes = cut_lineage(codes.withColumn("code", F.col("code").cast("long")))
    tops = codes.groupBy("feature").agg(F.max("code").alias("top"))  # a row for each column
    levels = tops.select("feature", F.greatest(F.lit(1), F.length(F.bin("top"))).alias("levels"))
    coded = lookup_join(cells, codes, ["feature", "x"]).join(F.broadcast(levels), "feature")
    bits = F.expr("transform(sequence(0, levels - 1), b -> struct(b AS bit, shiftright(code, b + 1) AS prefix, pmod(shiftright(code, b), 2) AS upper))")
    split = coded.select("pair", "y", "n", F.explode(bits).alias("b")).select("pair", "y", "n", "b.*")
    sides = split.groupBy("pair", "bit", "prefix", "y").agg(
        F.sum(F.when(F.col("upper") == 0, F.col("n")).otherwise(0)).alias("lo"),
        F.sum(F.when(F.col("upper") == 1, F.col("n")).otherwise(0)).alias("hi"),
    )
    running = prefix_sums(
        sides, ["pair", "bit", "prefix"], ["y"], {"lo_before": F.col("lo"), "hi_before": F.col("hi")},
        inclusive=False, rows_per_block=rows_per_block,
    )
    d = lambda c: F.col(c).cast("double")
    # A pair with the lower half at smaller y is concordant, at larger y discordant.
    return running.groupBy("pair").agg(F.sum(d("hi") * d("lo_before")).alias("c"), F.sum(d("lo") * d("hi_before")).alias("dc"))


def target_correlation(df: DataFrame, columns: Sequence[str], target: str, *, rows_per_block: int | None = None) -> DataFrame:
    """Pearson (the same as point-biserial), Spearman and class separation per column."""
    one = lambda k: F.when(F.col("__y") == k, F.col("value"))
    long = long_values(df, columns, keep=[F.col(target).cast("double").alias("__y")], kind="double")
    base = long.filter("value IS NOT NULL AND __y IS NOT NULL").groupBy("feature").agg(
        _r("value", "__y").alias("pearson"), F.avg(one(0)).alias("m0"), F.avg(one(1)).alias("m1"),
        F.stddev_pop(one(0)).alias("s0"), F.stddev_pop(one(1)).alias("s1"),
    )
    ranks = rank_tests(df, columns, target, rows_per_block=rows_per_block).select("feature", "spearman")
    zero = F.lit(0.0)
    return base.join(ranks, "feature").select(
        "feature", "pearson", "spearman",
        F.coalesce(F.try_divide(F.abs(F.col("m0") - F.col("m1")), F.col("s0") + F.col("s1")), zero).alias("separation"),
    )


# --- graph of correlated columns --------------------------------------------------------


def correlation_edges(pairs: DataFrame, limit: float = 0.85) -> DataFrame:
    return pairs.filter(F.abs("r") >= limit)


def edge_degrees(edges: DataFrame, hub: int = 3) -> DataFrame:
    ends = edges.select(F.explode(F.array("left", "right")).alias("feature"), F.abs("r").alias("w"))
    return ends.groupBy("feature").agg(F.count(F.lit(1)).alias("degree"), F.avg("w").alias("mean_weight")).withColumn("is_hub", F.col("degree") >= hub)


def connected_groups(edges: DataFrame) -> DataFrame:
    """Components by smallest label: ``(feature, component)`` for every node with an edge.

    Each round takes the smallest label among a node and its neighbours and then
    jumps to that label's own label, so the rounds grow with the log of the
    longest chain.  Lineage is cut after each round.
    """
    both = edges.select("left", "right").unionByName(edges.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy("left").agg(F.min("right").alias("m")).select(F.col("left").alias("feature"), F.least("left", "m").alias("component")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("feature", "right"), "right").groupBy("left").agg(F.min("component").alias("m"))
            .select(F.col("left").alias("feature"), "m")
        )
        stepped = labels.join(near, "feature").select("feature", F.least("component", "m").alias("next"), F.col("component").alias("old"))
        jump = labels.select(F.col("feature").alias("next"), F.col("component").alias("far"))
        fresh = cut_lineage(stepped.join(jump, "next", "left").select("feature", F.least("next", F.coalesce("far", "next")).alias("component"), "old"))
        changed = fresh.filter("component <> old").limit(1).count()
        labels = fresh.select("feature", "component")
        if not changed:
            return labels


def correlation_pruning(df: DataFrame, pairs: DataFrame, mi: DataFrame, columns: Sequence[str], limit: float = 0.85) -> DataFrame:
    """Per correlated pair: keep more information, else fewer nulls, else more variance."""
    var = wide_aggregate(df, columns, {"variance": lambda c: F.var_samp(F.col(c).cast("double"))})
    facts = missing_report(df, columns).select("feature", F.col("missing_pct").alias("missing")).join(var, "feature").join(mi, "feature", "left").fillna(0.0, ["mi"])
    facts = cut_lineage(facts)  # a row for each column, used for both sides
    left = facts.select(*[F.col(c).alias({"feature": "left"}.get(c, f"{c}_l")) for c in facts.columns])
    right = facts.select(*[F.col(c).alias({"feature": "right"}.get(c, f"{c}_r")) for c in facts.columns])
    staged = correlation_edges(pairs, limit).join(left, "left").join(right, "right")
    by_mi = F.abs(F.col("mi_l") - F.col("mi_r")) > 1e-4
    by_null = F.abs(F.col("missing_l") - F.col("missing_r")) / 100.0 > 1e-4
    keep_left = F.when(by_mi, F.col("mi_l") > F.col("mi_r")).when(by_null, F.col("missing_l") < F.col("missing_r")).otherwise(F.col("variance_l") >= F.col("variance_r"))
    return staged.select(
        "left", "right", "r", F.when(keep_left, F.col("left")).otherwise(F.col("right")).alias("keep"),
        F.when(keep_left, F.col("right")).otherwise(F.col("left")).alias("remove"),
        F.when(by_mi, "mutual information").when(by_null, "missing values").otherwise("variance").alias("reason"),
    )


def redundancy(df: DataFrame, columns: Sequence[str], limit: float = 0.85, method: str = "pearson") -> DataFrame:
    """Redundant pairs on complete rows, by Pearson, Spearman or either of them."""
    if method not in ("pearson", "spearman", "either"):
        raise ValueError(f"unknown method {method!r}")
    complete = df.select(*columns).dropna()
    found = [f(complete, columns) for name, f in (("pearson", pearson_pairs), ("spearman", spearman_pairs)) if method in (name, "either")]
    if len(found) == 1:
        return found[0].filter(F.abs("r") > limit)
    # The stronger of the two decides, and is reported.
    both = found[0].unionByName(found[1]).groupBy("left", "right").agg(F.max_by("r", F.abs("r")).alias("r"))
    return both.filter(F.abs("r") > limit)


def correlation_inventory(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    numeric = set(numeric_columns(df))
    report = missing_report(df, columns).select("feature", "missing_pct")
    return report.withColumns(
        {
            "kind": F.when(F.col("feature").isin([c for c in columns if c in numeric]), "numeric").otherwise("text"),
            "availability": classify("availability", "missing_pct"),
        }
    )


# --- leakage -----------------------------------------------------------------------------

# Words in a column name that point to facts known only later.
LEAKAGE_WORDS = ["chargeback", "settlement", "post_trans", "refund", "manual_review", "investigation"]


def leaking_columns(df: DataFrame, columns: Sequence[str], target: str, limit: float = 0.95, *, strict: bool = False) -> DataFrame:
    """Columns whose correlation with the label reaches (or exceeds) the limit."""
    corr = target_correlation(df, columns, target).select("feature", "pearson")
    a = F.abs("pearson")
    return corr.filter(a > limit if strict else a >= limit)


def target_leakage(corr: DataFrame) -> DataFrame:
    """Leakage probability from the column name and its correlation."""
    named = F.lower("feature").rlike("|".join(LEAKAGE_WORDS))
    high = (F.abs("pearson") > 0.9) | (F.abs("spearman") > 0.9)
    p = F.when(named & high, 1.0).when(high, 0.85).when(named, 0.5).otherwise(0.0)
    level = F.when(named & high, "CRITICAL").when(high, "HIGH").when(named, "MODERATE").otherwise("LOW")
    return corr.select("feature", p.alias("leakage_probability"), level.alias("severity"))


def time_correlation(df: DataFrame, columns: Sequence[str], dt: str) -> DataFrame:
    """Correlation of each column with time: a sign of information from the future."""
    long = long_values(df, columns, keep=[F.col(dt).cast("double").alias("__t")], kind="double")
    return long.filter("value IS NOT NULL AND __t IS NOT NULL").groupBy("feature").agg(_r("value", "__t").alias("time_correlation"))


def leakage_risk(
    corr: DataFrame, leaks: DataFrame, overlap: DataFrame, duplicates: DataFrame, texts: Sequence[str]
) -> DataFrame:
    """60 x probability + 30 x |r| + 10 x overlap (category overlap for text, row overlap else)."""
    numeric = corr.select("feature", F.abs("pearson").alias("r"))
    named = corr.sparkSession.createDataFrame([(t,) for t in texts], "feature string") if texts else None
    every = numeric if named is None else numeric.unionByName(named.withColumn("r", F.lit(0.0)))
    dup = duplicates.select("overlap_fraction")
    staged = (
        every.join(leaks.select("feature", "leakage_probability"), "feature", "left")
        .join(overlap.select("feature", (F.col("overlap_pct") / 100.0).alias("overlap")), "feature", "left")
        .transform(with_row, dup).fillna(0.0, ["leakage_probability", "overlap"])
    )
    is_text = F.col("feature").isin(list(texts))
    last: Column = F.when(is_text, F.col("overlap")).otherwise(F.col("overlap_fraction"))
    score = F.least(F.lit(100.0), F.col("leakage_probability") * 60.0 + F.col("r") * 30.0 + last * 10.0)
    return staged.select("feature", F.col("r").alias("correlation"), "leakage_probability", score.alias("score"), classify("leakage_category", score).alias("category"))
