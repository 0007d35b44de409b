"""Joins: identity merge, checked lookups, history, null-safe duplicate counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.rows import with_row

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: What one value takes in a broadcast row, besides the characters of a text.
VALUE_BYTES = 16
HOT_ROWS = 2_000_000
MAX_HOT_KEYS = 100_000
SALTS = 64


def row_bytes(df: DataFrame) -> Column:
    """Estimated bytes of a row of ``df``; nested values count as their JSON text."""
    size = F.lit(VALUE_BYTES * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        elif kind == "binary" or kind.startswith("string"):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
    return size


def lookup_join(
    left: DataFrame,
    mapping: DataFrame,
    on: Sequence[str],
    *,
    rows: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Left join to a table with one row per key.

    The mapping is broadcast only after its rows and bytes were measured;
    ``rows`` is the count (or an upper bound) where the caller knows it, which
    settles a mapping without texts and arrays.  A larger mapping is joined by
    shuffle.  Keys with more than ``hot_rows`` rows on the left are salted:
    their rows are spread over ``salts`` tasks and only their mapping rows are
    repeated.
    """
    on = list(on)
    fixed = not any(kind == "binary" or kind.startswith(("string", "array", "map", "struct")) for _, kind in mapping.dtypes)
    if rows is not None and rows <= broadcast_rows and fixed:
        size = rows * VALUE_BYTES * len(mapping.columns)
    else:
        one = mapping.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(mapping)).alias("bytes")).first()
        rows, size = one["rows"], one["bytes"] or 0
    if rows <= broadcast_rows and size <= broadcast_bytes:
        return left.join(F.broadcast(mapping), on, "left")
    n = left.count()
    if n <= hot_rows:
        return left.join(mapping, on, "left")
    # At most n / limit <= MAX_HOT_KEYS keys can be hot.
    limit = max(hot_rows, n // MAX_HOT_KEYS)
    hot = left.groupBy(*on).count().filter(F.col("count") > limit).select(*on, F.lit(True).alias("__hot"))
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    marked = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(0)).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = mapping.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return marked.join(spread, [*on, "__salt"], "left").drop("__salt")


def merge_identity(
    txn: DataFrame, identity: DataFrame, on: str, flag: str = "has_identity"
) -> DataFrame:
    """Left join of the optional side table, with a 0/1 match flag."""
    for frame in (txn, identity):
        if on not in frame.columns:
            raise ValueError(f"missing join key {on!r}")
    side = identity.withColumn("__hit", F.lit(1))
    return (
        txn.join(side, on, "left")
        .withColumn(flag, F.coalesce(F.col("__hit"), F.lit(0)))
        .drop("__hit")
    )


def merge_families(families: Sequence[DataFrame], on: str) -> DataFrame:
    """Chained left joins; a column already present is not added twice."""

    def step(left: DataFrame, right: DataFrame) -> DataFrame:
        fresh = [c for c in right.columns if c == on or c not in left.columns]
        return left.join(right.select(*fresh), on, "left")

    return reduce(step, families)


def flag_membership(df: DataFrame, ids: DataFrame, on: str, out: str) -> DataFrame:
    """0/1 flag: does the key occur in ``ids``?"""
    known = ids.select(on).distinct().withColumn("__hit", F.lit(1))
    return df.join(known, on, "left").withColumn(out, F.coalesce("__hit", F.lit(0))).drop("__hit")


def duplicate_overlap(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs of equal rows across two frames; two nulls count as equal.

    Both sides are counted per distinct row first, so the pair count is a sum
    of products and no pair is ever materialised.
    """
    left = train.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_left"))
    right = test.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_right"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    pairs = left.alias("l").join(right.alias("r"), same, "inner")
    matched = pairs.agg(
        F.coalesce(F.sum(F.col("n_left").cast("decimal(38,0)") * F.col("n_right")), F.lit(0))
        .cast("long")
        .alias("duplicate_matches")
    )
    sizes = train.agg(F.count(F.lit(1)).alias("train_rows")).transform(with_row, 
        test.agg(F.count(F.lit(1)).alias("test_rows"))
    )
    share = F.coalesce(F.try_divide(F.col("duplicate_matches"), F.col("train_rows")), F.lit(0.0))
    return matched.transform(with_row, sizes).select(
        "train_rows",
        "test_rows",
        "duplicate_matches",
        share.alias("overlap_fraction"),
        F.when(share > 0.05, "CRITICAL").otherwise("SAFE").alias("risk"),
    )


def align_counts(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_name: str, right_name: str
) -> DataFrame:
    """Full outer join of two count tables, missing categories filled with 0."""
    zero = F.lit(0)
    return (
        left.join(right, list(on), "full_outer")
        .withColumn(left_name, F.coalesce(F.col(left_name), zero))
        .withColumn(right_name, F.coalesce(F.col(right_name), zero))
    )
