"""Bin numbers of many columns by binary search, whatever the number of edges.

A chain of comparisons per column makes generated methods that the JIT refuses
once a few columns with ten edges meet; ``Bucketizer`` keeps each column to one
call.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edges:
    """Ascending edges; infinite ends take everything, finite ends drop what lies outside."""

    values: Sequence[float]
    #: "left" is [a, b) with the last bin closed, "right" is (a, b] with the first closed.
    closed: str = "right"


def _index(c: Column, raw: Column, edges: Edges, m: int) -> Column:
    """Zero-based bin from the bucket number; null for null and for values outside."""
    low, high = edges.values[0], edges.values[-1]
    passed = raw if edges.closed == "left" else F.lit(m) - raw
    index = passed - (0 if math.isinf(low) else 1)
    last = len(edges.values) - 2
    out = F.when((index >= 0) & (index <= last), index)
    if edges.closed == "right" and not math.isinf(low):
        out = F.when(c == low, 0).otherwise(out)
    if edges.closed == "left" and not math.isinf(high):
        out = F.when(c == high, last).otherwise(out)
    return F.when(c.isNotNull(), out)


def add_bins(df: DataFrame, specs: Mapping[str, Edges], prefix: str = "__bin_") -> DataFrame:
    """Add ``<prefix><column>`` with the bin number of each column."""
    finite = {c: [v for v in e.values if not math.isinf(v)] for c, e in specs.items()}
    cut = [c for c in specs if finite[c]]
    staged = df
    if cut:
        # (a, b] on x is [-b, -a) on -x.
        sign = {c: 1.0 if specs[c].closed == "left" else -1.0 for c in cut}
        staged = staged.withColumns({f"__s_{c}": F.col(c).cast("double") * sign[c] for c in cut})
        staged = Bucketizer(
            inputCols=[f"__s_{c}" for c in cut],
            outputCols=[f"__r_{c}" for c in cut],
            splitsArray=[[-math.inf, *sorted(v * sign[c] for v in finite[c]), math.inf] for c in cut],
            handleInvalid="keep",
        ).transform(staged)
    columns = {}
    for c, e in specs.items():
        value = F.col(c).cast("double")
        if c in cut:
            columns[f"{prefix}{c}"] = _index(value, F.col(f"__r_{c}").cast("int"), e, len(finite[c]))
        else:
            columns[f"{prefix}{c}"] = F.when(value.isNotNull(), 0)
    return staged.withColumns(columns).drop(*[f"__s_{c}" for c in cut], *[f"__r_{c}" for c in cut])
