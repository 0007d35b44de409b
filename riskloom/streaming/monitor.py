"""Windowed service metrics and drift per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.drift import data_drift_monitor


def windowed_metrics(events: DataFrame, ts: str, latency: str, is_error: Column, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests, error share and latency percentiles per tumbling window, late rows dropped."""
    percentiles = F.percentile_approx(latency, [0.5, 0.95, 0.99], 10_000)
    out = (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, width))
        .agg(F.count(F.lit(1)).alias("requests"), F.avg(is_error.cast("double")).alias("error_rate"), percentiles.alias("q"))
    )
    return out.select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests", "error_rate",
        F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"),
    )


def drift_writer(reference: DataFrame, columns: Sequence[str], folder: str, limit: float = 0.2) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler: PSI of the batch against a fixed reference.

    Each batch writes its own folder, so a repeated batch replaces itself.
    """

    def handle(batch: DataFrame, number: int) -> None:
        found = data_drift_monitor(reference, batch, columns, limit)
        found.withColumn("batch", F.lit(number)).repartition(1).write.mode("overwrite").parquet(f"{folder}/batch-{number}")

    return handle
