"""Sinks: stage outputs, versioned features, family files and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from riskloom.operators.joins import merge_families


def write_stage(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def feature_path(base: str, view: str, version: str) -> str:
    return f"{base}/{view}/{version}"


def write_features(df: DataFrame, base: str, view: str, version: str) -> str:
    """One Parquet folder per view and version, snappy compressed."""
    path = feature_path(base, view, version)
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def write_families(families: Mapping[str, DataFrame], base: str, version: str, on: str) -> DataFrame:
    """Write each family, then the merged matrix read back from the written files."""
    spark = next(iter(families.values())).sparkSession
    written = [spark.read.parquet(write_features(df, base, name, version)) for name, df in families.items()]
    path = write_features(merge_families(written, on), base, "matrix", version)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """A report as a folder of CSV or JSON files, read back as one table.

    The frame keeps its partitions: each task writes its own file, and Spark's
    commit marks the folder complete with ``_SUCCESS``. A report of a few rows
    comes out of an aggregate whose partitions adaptive execution has already
    merged, so it is one file without another shuffle.
    """
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")
    return path
