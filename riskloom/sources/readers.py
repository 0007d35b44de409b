"""Scans: CSV with a contract, Parquet with only the wanted columns, limited ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class ContractError(ValueError):
    """The file does not look like what was promised."""


def check_csv(spark: SparkSession, path: str, expected_columns: int | None = None) -> list[str]:
    """Header check: readable, UTF-8, comma separated, right number of columns."""
    try:
        head = spark.read.text(path).limit(1).collect()
    except Exception as e:  # noqa: BLE001
        raise ContractError(f"cannot read {path}") from e
    line = head[0][0] if head else ""
    if "�" in line:
        raise ContractError(f"{path} is not UTF-8")
    if "," not in line:
        raise ContractError(f"{path} is not comma separated")
    names = spark.read.csv(path, header=True).columns
    if expected_columns and len(names) != expected_columns:
        raise ContractError(f"{path} has {len(names)} columns, expected {expected_columns}")
    return names


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, expected_columns: int | None = None
) -> DataFrame:
    """CSV scan; give a schema at scale, since inference reads the file twice."""
    check_csv(spark, path, expected_columns)
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).option("mode", "FAILFAST").csv(path)


def read_columns(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """Parquet scan of the wanted columns that exist; only the footer is read to decide."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in wanted if c in df.columns])


def limited_ingest(parent: DataFrame, child: DataFrame, parent_id: str, child_id: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` parents by id, and only their child rows."""
    head = parent.orderBy(parent_id).limit(n)
    ids = head.select(parent[parent_id].alias(child_id))
    return head, child.join(ids, child_id, "left_semi")
