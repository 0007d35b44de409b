"""Helpers shared by the text operators."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import work_path

#: The six characters that separate words.
WORD_SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{WORD_SPACES}]+"
#: A side is broadcast only if its measured values take no more than this.
BROADCAST_BYTES = 32 << 20
#: Null ids travel as this number inside Python tasks; it sorts before every real id.
NO_ID = -(1 << 63)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and continue from the files.

    The copy cuts the lineage, survives lost executors and gives the planner
    true sizes.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def measured_bytes(df: DataFrame) -> int:
    """Rows times 16 bytes a column plus the bytes of text and binary values."""
    widths = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            widths = widths + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            widths = widths + F.coalesce(F.size(name), F.lit(0)) * 16
    return df.agg(F.sum(widths).alias("b")).first()["b"] or 0


def attach(
    rows: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``side`` (a staged table) to ``rows`` on keys that may be null.

    ``side`` is broadcast after its bytes were measured and found small; a
    larger one is joined by shuffle, where adaptive execution splits hot keys.
    """
    if measured_bytes(side) <= max_bytes:
        side = F.broadcast(side)
    renamed = side.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    out = rows.join(renamed, on, how)
    return out.drop(*[f"__k_{k}" for k in keys])


def slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of a text column, a row at least."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column)], dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    for first, last in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right"))):
        yield batch.slice(int(first), int(last - first))


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids of an Arrow column with nulls as ``NO_ID``."""
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def id_array(values: np.ndarray) -> pa.Array:
    """The reverse of ``ids_of``."""
    values = np.asarray(values, dtype=np.int64)
    return pa.array(values, type=pa.int64(), mask=values == NO_ID)


def lower_ascii(column):
    """``column`` with A-Z lower-cased and every other character unchanged."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())
