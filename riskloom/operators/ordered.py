"""Ordered computations that never put an unbounded group into one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one
task, and a window without a key sends the whole table there. Here the rows are
range-partitioned by keys and order columns together, so a hot key, or a table
without a key, is cut into as many ranges as its rows need. What a range needs
from the ranges before it is a total (for running sums) or the last ``k`` rows
(for trailing frames). Ranges follow each other in the order, so each range has
at most one key that began in an earlier one, and both tables hold a few rows
per range.

The ranges only balance the work and never change a result. Spark's own order
decides, so nulls, NaN, infinities, texts and ties need no special case; rows
that are equal in all order columns follow each other in any order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

_RANGE = "__range"


def _ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_block: int | None) -> DataFrame:
    """``df`` dealt to ranges and written to the checkpoint folder, with the number of each row's range.

    Spark chooses the number of ranges; ``rows_per_block`` asks for ranges of
    about so many rows.
    """
    columns = [F.col(c).asc() for c in (*keys, *order)]
    if rows_per_block:
        ranged = df.repartitionByRange(max(1, math.ceil(df.count() / rows_per_block)), *columns)
    else:
        ranged = df.repartitionByRange(*columns)
    return cut_lineage(ranged.withColumn(_RANGE, F.spark_partition_id()))


def _order(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc() for c in order]


def _beside(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join a table of a few rows per range on keys that may be null."""
    renamed = F.broadcast(side.withColumnsRenamed({k: f"__k_{k}" for k in keys}))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return rows.join(renamed, on, how).drop(*[f"__k_{k}" for k in keys])


def _offsets(ranged: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """What each range adds to the running sums of ``__x_<name>``: the totals of the key's earlier ranges."""
    groups = [*keys, _RANGE]
    totals = ranged.groupBy(*groups).agg(*[F.sum(f"__x_{name}").alias(f"__t_{name}") for name in names], F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return (
        totals.withColumns({f"__o_{name}": F.sum(f"__t_{name}").over(before) for name in names} | {"__rows": F.sum("__rows").over(before)})
        .filter(F.col("__rows").isNotNull()).select(*groups, *[f"__o_{name}" for name in names])
    )


def _context(ranged: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, columns: Sequence[str]) -> DataFrame:
    """The last ``k`` rows before each range of a key that has earlier ones, under that range."""
    groups = [*keys, _RANGE]
    # Keys of more than one range: at most one for each end of a range.
    wide = ranged.groupBy(*keys).agg(F.min(_RANGE).alias("__first"), F.max(_RANGE).alias("__last"))
    wide = wide.filter("__first < __last").drop("__first", "__last") if keys else None
    spread = _beside(ranged, wide, keys, "left_semi") if keys else ranged
    newest = Window.partitionBy(*groups).orderBy(*[F.col(c).desc() for c in order])
    tails = spread.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= k).drop("__r")
    # At most k rows per range are left, so this window per key is bounded.
    along = Window.partitionBy(*keys).orderBy(_RANGE, *_order(order))
    first = Window.partitionBy(*groups).orderBy(*_order(order))
    others = [c for c in columns if c not in keys]
    return (
        tails.withColumns(
            {
                "__ctx": F.collect_list(F.struct(*others)).over(along.rowsBetween(-k, -1)),
                "__r": F.row_number().over(first),
            }
        )
        .filter(F.col("__r") == 1)
        .select(*groups, F.explode("__ctx").alias("__c"))
        .select(*groups, *[F.col("__c")[c].alias(c) for c in others])
    )


def frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    k: int = 0,
    *,
    inclusive: bool = True,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Add running ``sums`` and trailing ``columns`` along ``order`` within ``keys``, all from one layout.

    The rows are dealt to ranges once and sorted within them once, whatever the
    number of columns. Running sums are ``sums`` of all rows up to the row
    (before it, unless ``inclusive``); each entry of ``columns`` maps the
    ordered window (without a frame) to a column whose frame reaches at most
    ``k`` rows back.
    """
    ranged = _ranges(df, keys, order, rows_per_block).withColumns({f"__x_{name}": e for name, e in sums.items()})
    groups, both = [*keys, _RANGE], ranged
    spec = Window.partitionBy(*groups).orderBy(*_order(order))
    if columns:
        context = _context(ranged, keys, order, k, df.columns)
        both = ranged.withColumn("__is_ctx", F.lit(False)).unionByName(context.withColumn("__is_ctx", F.lit(True)), allowMissingColumns=True)
        # Context rows come first, also where they tie with the range's own rows; they hold no sums.
        spec = Window.partitionBy(*groups).orderBy(F.col("__is_ctx").desc(), *_order(order))
    local = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    out = both.withColumns(
        {name: make(spec) for name, make in columns.items()} | {f"__l_{name}": F.sum(f"__x_{name}").over(local) for name in sums}
    )
    if columns:
        out = out.filter(~F.col("__is_ctx"))
    if sums:
        out = _beside(out, _offsets(ranged, keys, list(sums)), groups, "left")
    zero = F.lit(0)
    out = out.withColumns(
        {name: F.coalesce(F.col(f"__l_{name}"), zero) + F.coalesce(F.col(f"__o_{name}"), zero) for name in sums}
    )
    return out.select(*df.columns, *sums, *columns)


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    *,
    inclusive: bool = True,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Add running sums along ``order`` within ``keys`` (all rows when empty)."""
    return frames(df, keys, order, sums, {}, inclusive=inclusive, rows_per_block=rows_per_block)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    k: int,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    *,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Add columns whose frame reaches at most ``k`` rows back.

    Each entry of ``columns`` maps the ordered window (without a frame) to a
    column, for instance ``lambda w: F.avg("x").over(w.rowsBetween(-5, -1))``.
    """
    return frames(df, keys, order, {}, columns, k, rows_per_block=rows_per_block)


def with_ordinal(
    df: DataFrame, order: Sequence[str], out: str = "ordinal", *, rows_per_block: int | None = None
) -> DataFrame:
    """Add the zero-based position of each row along ``order``."""
    return prefix_sums(
        df, [], order, {out: F.lit(1)}, inclusive=False, rows_per_block=rows_per_block
    ).withColumn(out, F.col(out).cast("long"))
