"""Versioned feature store: registry, keyed upsert, key lookup, history, documents.

The registry is a table of view records.  Parquet has no MERGE, so an upsert
writes a new version folder and then points the registry at it; a folder being
read is never overwritten.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.sources.sinks import feature_path, write_features

VIEW_SCHEMA = """name string, entity string, features array<string>, version string, description string,
    lineage struct<source: string, stage: string>, tags array<string>"""


@dataclass(frozen=True)
class FeatureView:
    name: str
    entity: str
    features: tuple[str, ...]
    version: str = "v1"
    description: str = ""
    source: str = ""
    stage: str = ""
    tags: tuple[str, ...] = field(default_factory=tuple)

    def record(self) -> tuple:
        return (
            self.name, self.entity, list(self.features), self.version, self.description,
            (self.source, self.stage), list(self.tags),
        )


def registry_table(spark: SparkSession, views: Sequence[FeatureView]) -> DataFrame:
    return spark.createDataFrame([v.record() for v in views], VIEW_SCHEMA)


def save_registry(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").json(path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIEW_SCHEMA).json(path)


def search_views(registry: DataFrame, pattern: str) -> DataFrame:
    """Views whose name or any feature name matches, ignoring case."""
    rx = F.lit(f"(?i){pattern}")
    return registry.filter(F.col("name").rlike(f"(?i){pattern}") | F.exists("features", lambda x: F.regexp_like(x, rx)))


def ingest(df: DataFrame, view: FeatureView, base: str) -> DataFrame:
    """Check the view's columns, keep only them, and write the version."""
    absent = [c for c in (view.entity, *view.features) if c not in df.columns]
    if absent:
        raise ValueError(f"view {view.name}: missing columns {absent}")
    path = write_features(df.select(view.entity, *view.features), base, view.name, view.version)
    return df.sparkSession.read.parquet(path)


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last row per key; an aggregate with map-side combine, so a hot key does not pile up."""
    others = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("__r")
    return df.groupBy(key).agg(best).select(key, *[F.col("__r")[c].alias(c) for c in others])


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """New rows replace old rows of the same key; a null key matches a null key."""
    old, new = current.alias("o"), changes.select(key).distinct().alias("n")
    kept = old.join(new, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "left_anti")
    return kept.unionByName(changes)


def upsert_version(spark: SparkSession, base: str, view: str, old: str, new: str, changes: DataFrame, key: str) -> DataFrame:
    """Upsert into a new version folder; the old one stays readable."""
    current = spark.read.parquet(feature_path(base, view, old))
    write_features(upsert(current, changes, key), base, view, new)
    return spark.read.parquet(feature_path(base, view, new))


def lookup(view: DataFrame, keys: DataFrame, key: str, ordinal: str, features: Sequence[str]) -> DataFrame:
    """Features for requested keys in request order; unknown keys give nulls.

    The request list is the small side and filters the view before the join.
    """
    wanted = view.join(keys.select(key).distinct(), key, "left_semi").select(key, *features)
    return keys.join(wanted, key, "left").orderBy(ordinal)


def historical_features(entities: DataFrame, views: Mapping[str, DataFrame | None], key: str) -> DataFrame:
    """Left join of every available view; an absent view is skipped.

    There is no event time here: the join does not travel back in time.
    """
    out = entities
    for view in views.values():
        if view is None:
            continue
        fresh = [c for c in view.columns if c == key or c not in out.columns]
        out = out.join(view.select(*fresh), key, "left")
    return out


def view_documents(registry: DataFrame) -> DataFrame:
    """One Markdown section and one JSON text per view."""
    bullets = F.array_join(F.transform("features", lambda f: F.concat(F.lit("- "), f)), "\n")
    md = F.concat(F.lit("## "), F.col("name"), F.lit(" ("), F.col("version"), F.lit(")\n"), bullets)
    return registry.select("name", md.alias("markdown"), F.to_json(F.struct(*registry.columns)).alias("json"))


def feature_catalog(registry: DataFrame) -> DataFrame:
    """One row per feature with its view, entity, version and stage."""
    return registry.select(
        "name", "entity", "version", F.col("lineage.stage").alias("stage"), F.posexplode("features").alias("position", "feature")
    )


def newest_versions(registry: DataFrame) -> DataFrame:
    """The highest version of each view; the registry is a small table."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.col("version").desc()))
    return registry.withColumn("__r", rank).filter("__r = 1").drop("__r")
