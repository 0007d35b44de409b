"""Run a stream over a folder to its end, one micro-batch per call."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from riskloom.session import work_path


def file_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything that has arrived, then stop; the checkpoint keeps the state."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def replay(slices: Sequence[DataFrame], start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Append each slice to a folder and drain the stream after it.

    The stream restarts from its checkpoint each time, as after a lost driver.
    """
    spark = slices[0].sparkSession
    folder, checkpoint = work_path(spark, "stream"), work_path(spark, "stream-checkpoint")
    for part in slices:
        part.write.mode("append").parquet(folder)
        drain(start(file_stream(spark, folder, slices[0].schema)), checkpoint)
