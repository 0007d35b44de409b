"""One-row tables and first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def largest(df: DataFrame, order: Sequence[Column | str], k: int | None) -> DataFrame:
    """The first ``k`` rows along ``order``; all rows, in any order, without ``k``."""
    return df if k is None else df.orderBy(*order).limit(k)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of ``row`` as a scalar subquery.

    ``row`` is an aggregate without keys.  It is computed once and enters the
    plan as a constant, so no join runs; more than one row is an error.
    """
    packed = row.select(F.struct(*row.columns)).scalar()
    return df.withColumn("__row", packed).select(*df.columns, *[F.col("__row")[c].alias(c) for c in row.columns])
