"""Exact quantiles with linear interpolation, without a per-group value map.

Spark's ``percentile`` is exact but keeps every distinct value of a group in
one buffer. Here values are counted, ranked by running sums over ranges of the
order, and only the values at the wanted ranks are picked.

Whole columns are narrowed first: a sketch brackets every wanted rank, values
between brackets are only counted, and the ranking sees the values in brackets.
The counts show whether a rank lies in its bracket, so the sketch never decides
a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordered import prefix_sums

#: Rows that the sketch sees, and the part of them up to which it knows a rank. Both only set the width of brackets.
SKETCH_ROWS = 2_000_000
SKETCH_ACCURACY = 10_000

Quantiles = dict[str, list[float | None]]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    rows_per_block: int | None = None,
) -> Quantiles:
    """Quantiles of several numeric columns: one list per column, nulls ignored; nulls where all values are."""
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    values = df.select(*[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    named = {f"q{i}": p for i, p in enumerate(probs)}
    counts = _narrowed(values, _brackets(values, probs))
    alone = F.col("place") % 2 == 1
    picked = _picked(counts, ["feature"], ["place", "__v"], named, rows_per_block=rows_per_block, alone=alone).collect()
    found = {columns[r["feature"]]: [r[name] for name in named] for r in picked if r["__alone"]}
    # A rank outside its bracket; a sketch that keeps its promise leaves none.
    for i in [r["feature"] for r in picked if not r["__alone"]]:
        whole = grouped_quantiles(values.select(F.lit(i).alias("feature"), f"__v{i}"), ["feature"], f"__v{i}", named, rows_per_block=rows_per_block)
        found[columns[i]] = [r[name] for r in whole.collect() for name in named]
    return {c: found.get(c, [None] * len(named)) for c in columns}


def _brackets(values: DataFrame, probs: Sequence[float]) -> list[np.ndarray]:
    """Per column ``__v<i>``, ascending ends of apart closed intervals that should hold the values at the wanted ranks.

    Ranks of a sample of m rows are off by half a root of m at most (one standard deviation); brackets allow for six.
    """
    number = lambda i: F.when(~F.isnan(f"__v{i}"), F.col(f"__v{i}"))
    width = len(values.columns)
    if not probs:
        return [np.empty(0)] * width
    rows = values.agg(F.count(F.lit(1)).alias("rows"), *[
        x.alias(f"{t}{i}") for i in range(width) for t, x in (("n", F.count(f"__v{i}")), ("m", F.count(number(i))))]).first()
    share = SKETCH_ROWS / max(1, rows["rows"])
    some = values if share >= 1 else values.sample(share, 1)
    near = {}
    for i in range(width):
        n, m = rows[f"n{i}"], rows[f"m{i}"]
        wide = 2 / SKETCH_ACCURACY + (3 / math.sqrt(share * m) if share < 1 and m else 0)
        reach = [(math.floor(p * (n - 1)) / m - wide, (math.ceil(p * (n - 1)) + 1) / m + wide) for p in probs] if m else []
        near[i] = [(low, high) for low, high in reach if low <= 1]  # NaN comes after all numbers
    asked = [
        F.percentile_approx(number(i), [min(1.0, max(0.0, x)) for pair in near[i] for x in pair], SKETCH_ACCURACY).alias(f"b{i}")
        for i in near if near[i]
    ]
    sketch = some.agg(*asked).first().asDict() if asked else {}
    out = []
    for i in range(width):
        found = sketch.get(f"b{i}") or [0.0] * 2 * len(near[i])
        unseen = sketch.get(f"b{i}") is None
        ends: list[float] = []
        for (p, q), low, high in sorted(zip(near[i], found[::2], found[1::2])):
            low, high = -math.inf if p <= 0 or unseen else low, math.inf if q >= 1 or unseen else high
            if ends and low <= ends[-1]:
                ends[-1] = max(ends[-1], high)
            else:
                ends += [low, high]
        out.append(np.array(ends))
    return out


def _narrowed(values: DataFrame, brackets: Sequence[np.ndarray]) -> DataFrame:
    """``(feature, place, __v, __c)``: counts of values, those between two brackets together.

    Places follow each other in the order; odd ones are brackets, and NaN, and hold their values, others hold none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = [np.zeros(len(ends) + 1, dtype=np.int64) for ends in brackets]

        def table(feature: int, place: np.ndarray, found: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), feature, dtype=np.int32)), pa.array(place.astype(np.int32)), found, pa.array(n.astype(np.int64))],
                names=["feature", "place", "__v", "n"])

        for batch in batches:
            for i, ends in enumerate(brackets):
                found = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                place = np.searchsorted(ends[::2], found, "right") + np.searchsorted(ends[1::2], found, "left")
                place[np.isnan(found)] = len(ends) + 1
                inside = place % 2 == 1
                gaps[i] += np.bincount(place[~inside], minlength=len(gaps[i]))
                if inside.any():
                    found, first, n = np.unique(found[inside], return_index=True, return_counts=True)
                    yield table(i, place[inside][first], pa.array(found), n)
        for i, n in enumerate(gaps):
            at = np.flatnonzero(n)
            yield table(i, at, pa.nulls(len(at), pa.float64()), n[at])

    parts = values.mapInArrow(run, "feature int, place int, __v double, n long")
    return parts.groupBy("feature", "place", "__v").agg(F.sum("n").alias("__c"))


def _between(low: Column, high: Column, share: Column) -> Column:
    """Linear interpolation that stays exact at its ends, also where they are infinite."""
    return F.when((share == 0) | (low == high), low).otherwise(low + (high - low) * share)


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    named_probs: dict[str, float],
    *,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Exact quantiles of ``value`` per key, one row per key with a known value."""
    keys = list(keys)
    known = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    counts = known.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    return _picked(counts, keys, ["__v"], named_probs, rows_per_block=rows_per_block).drop("__alone")


def _picked(
    counts: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    named_probs: Mapping[str, float],
    *,
    rows_per_block: int | None,
    alone: Column | None = None,
) -> DataFrame:
    """Quantiles per key from ``(keys, order, __v, __c)``, and ``__alone``: whether all rows they rest on are ``alone``."""
    ranked = prefix_sums(counts, keys, order, {"__start": F.col("__c")}, inclusive=False, rows_per_block=rows_per_block)
    end = F.col("__start") + F.col("__c")
    totals = ranked.groupBy(*keys).agg(F.max(end).alias("__n")).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    ranked = ranked.join(totals, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    aggs, sure = [], F.lit(True)
    for i, p in enumerate(named_probs.values()):
        position = F.lit(float(p)) * (F.col("__n") - 1)
        for tag, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (F.col("__start") <= rank) & (rank < end)
            aggs.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{tag}{i}"))
            sure = sure if alone is None else sure & (alone | ~inside)
        aggs.append(F.max(position - F.floor(position)).alias(f"__w{i}"))
    picked = ranked.groupBy(*keys).agg(*aggs, F.bool_and(sure).alias("__alone"))
    return picked.select(
        *keys, "__alone",
        *[_between(F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.col(f"__w{i}")).alias(name) for i, name in enumerate(named_probs)],
    )
