"""Vector averages and audit chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average_vectors(df: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """Elementwise mean: positions are averaged, then put back in order."""
    long = df.select(*keys, F.posexplode(vector).alias("pos", "v"))
    means = long.groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p")
    return means.groupBy(*keys).agg(packed).select(*keys, F.transform("p", lambda x: x["v"]).alias("mean_vector"))


GENESIS = "0" * 64
CHAIN_FIELDS = ["ts", "user", "action", "resource", "status"]


def event_hash(previous, fields: Sequence[str] = CHAIN_FIELDS):
    return F.sha2(F.concat_ws("|", *[F.col(f).cast("string") for f in fields], previous), 256)


def hash_chain(log: DataFrame, order: str, *, chain: str = "chain") -> DataFrame:
    """``log`` with ``position``, ``previous_hash`` and ``event_hash`` of whole chains, by ``order`` (no ties, chain not null).

    A link needs the hash before it, so a chain is walked in order; a task holds
    one Arrow batch of it at a time.
    """
    made = ["position", "previous_hash", "event_hash"]
    content = F.concat_ws("|", *[F.col(f).cast("string") for f in CHAIN_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, last = None, 0, GENESIS
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(chain).to_pylist(), batch.column("__content").to_pylist()):
                if key != now:
                    now, position, last = key, 0, GENESIS
                own = hashlib.sha256(f"{text}|{last}".encode()).hexdigest()
                rows.append((position, last, own))
                position, last = position + 1, own
            arrays = [pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            kept = [n for n in batch.schema.names if n != "__content"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + arrays, names=[*kept, *made])

    ordered = log.withColumn("__content", content).repartition(chain).sortWithinPartitions(chain, order)
    schema = ", ".join(f"`{n}` {kind}" for n, kind in log.dtypes)
    return ordered.mapInArrow(run, f"{schema}, position long, previous_hash string, event_hash string")


def verify_chain(log: DataFrame, order: str, *, chain: str = "chain") -> DataFrame:
    """Broken links of hash-chained audit logs.

    A row is intact when its stored previous hash is the hash of the row before
    and its own hash matches its content.  Every row is checked on its own, so
    the links of one long log are compared by joining position to position + 1.
    """
    previous = log.select(chain, (F.col(order) + 1).alias(order), F.col("event_hash").alias("__prev"))
    joined = log.join(previous, [chain, order], "left")
    expected_prev = F.coalesce(F.col("__prev"), F.lit(GENESIS))
    link_ok = F.col("previous_hash").eqNullSafe(expected_prev)
    content_ok = F.col("event_hash").eqNullSafe(event_hash(F.col("previous_hash")))
    problem = F.when(~link_ok, "broken link").when(~content_ok, "changed content")
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(chain, order, "problem")


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and an order-insensitive content hash, one row.

    Row hashes are summed in a decimal, so repeated rows do not cancel out.
    """
    row = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    gone = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(gone).alias("missing_cells"), F.sum(row).alias("__h"))
    text = F.concat_ws("|", F.col("n_rows").cast("string"), F.coalesce(F.col("__h").cast("string"), F.lit("")))
    return one.select("n_rows", F.lit(len(df.columns)).alias("n_columns"), "missing_cells", F.sha2(text, 256).alias("fingerprint"))


def report_table(reports: dict[str, DataFrame]) -> DataFrame:
    """One-row metric frames as a long ``(module, metric, value)`` table."""
    parts = []
    for module, one in reports.items():
        rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])
        parts.append(one.select(F.lit(module).alias("module"), F.explode(rows).alias("r")).select("module", "r.*"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


