"""Sorting, top-k, sampling, set operations and degree features."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.joins import lookup_join
from riskloom.operators.rows import with_row


def sort_by_magnitude(df: DataFrame, column: str, tie: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(column)).desc(), tie)


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; the limit is also applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("position", rank).filter(F.col("position") <= k)


def id_hash(ids: Sequence[str], seed: int) -> Column:
    """52 bits of the MD5 of the ids and a seed: the same for a row in every engine, plan and retry."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def poisson_steps(mean: float = 1.0) -> list[float]:
    """Cumulative Poisson probabilities, as far as a double tells them from 1."""
    steps, term, total, k = [], math.exp(-mean), 0.0, 0
    while total + term > total:
        total += term
        steps.append(total)
        k += 1
        term *= mean / k
    return steps


def seeded_sample(df: DataFrame, ids: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement; the same rows on every read."""
    return df.orderBy(id_hash(ids, seed), *ids).limit(n)


def seeded_fraction(df: DataFrame, ids: Sequence[str], share: float, seed: int) -> DataFrame:
    """About ``share`` of the rows, decided per row by a hash of its id."""
    return df.filter(id_hash(ids, seed) % 1_000_000 < int(share * 1_000_000))


def bootstrap(df: DataFrame, ids: Sequence[str], seed: int) -> DataFrame:
    """Each row as many times as a Poisson(1) draw from the hash of its id says."""
    # The draw sits in an array, so that the MD5 is taken once and not at every step.
    u = F.array((id_hash(ids, seed) + 0.5) / float(1 << 52))
    times = F.transform(u, lambda x: sum(((x >= step).cast("int") for step in poisson_steps()), F.lit(0)))[0]
    return df.withColumn("__again", F.explode(F.array_repeat(F.lit(1), times))).drop("__again")


def stack(frames: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Union by name with the source in ``label``; absent columns become null."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def category_changes(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Values only in test ("new") and only in train ("vanished"), in one grouped pass."""
    side = stack({"train": train.select(column).distinct(), "test": test.select(column).distinct()}, "side")
    seen = side.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.max((F.col("side") == "train").cast("int")).alias("a"), F.max((F.col("side") == "test").cast("int")).alias("b")
    )
    return seen.filter("a <> b").select(column, F.when(F.col("b") == 1, "new").otherwise("vanished").alias("kind"))


def category_overlap(train: DataFrame, test: DataFrame, column: str, limit: float = 90.0) -> DataFrame:
    """Shared categories as a share of the train categories."""
    side = stack({"train": train.select(column).distinct(), "test": test.select(column).distinct()}, "side")
    seen = side.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.max((F.col("side") == "train").cast("long")).alias("a"), F.max((F.col("side") == "test").cast("long")).alias("b")
    )
    one = seen.agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"), F.sum(F.col("a") * F.col("b")).alias("n_shared"))
    share = F.coalesce(F.try_divide(F.col("n_shared") * 100.0, F.col("n_train")), F.lit(0.0))
    return one.select("*", share.alias("overlap_pct"), F.when(share > limit, "SUSPICIOUS").otherwise("SAFE").alias("level"))


def degree_features(df: DataFrame, key: str) -> DataFrame:
    """Transactions per card, the degree over the largest degree, and a risk level."""
    degree = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("degree"))
    top = degree.agg(F.max("degree").alias("__top"))
    out = lookup_join(df, degree, [key]).transform(with_row, top).withColumn("degree", F.coalesce("degree", F.lit(1)))
    scaled = F.greatest(F.lit(0.001), F.least(F.lit(1.0), F.col("degree") / F.greatest(F.lit(1), F.col("__top"))))
    return out.withColumns(
        {"normalised_degree": scaled, "community_risk": F.when(F.col("degree") > 10, 0.8).otherwise(0.1)}
    ).drop("__top")
