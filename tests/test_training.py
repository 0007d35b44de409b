"""Trainers on cells, their layout, and draws that are made once per row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import model, sets

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.range(0, 6000, 1, 4).select(
        "id", (F.col("id") * 37 % 50).cast("double").alias("a"), (F.xxhash64("id") % 9).cast("double").alias("b")
    )
    return df.withColumn("y", (F.col("a") + F.col("b") > 25).cast("int"))


def test_bootstrap_takes_one_hash_per_row(spark, labelled):
    plan = sets.bootstrap(labelled, ["id"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 2  # one for the copies, one for the filter that drops rows without any


def test_thresholds_are_midpoints():
    assert model._thresholds(np.array([1.0, 1.0, 2.0, 4.0])) == [1.5, 3.0]
    found = model._thresholds(np.arange(6400.0))
    assert len(found) == 31 and np.allclose(np.diff(found), 200.0)
    assert model._thresholds(np.ones(5)) == []


def test_boosting_on_cells_equals_boosting_on_rows(labelled, monkeypatch):
    few = labelled.withColumn("a", F.floor(F.col("a") / 2))
    rows = model.score(model.fit_boosted(few, FEATURES, rounds=3), few, FEATURES)
    monkeypatch.setattr(model, "WHOLE_ROWS", 1000)
    fitted = model.fit_boosted(few, FEATURES, rounds=3)
    assert len(fitted.stages) == 4
    cells = model.score(fitted, few, FEATURES, "q")
    assert cells.columns == [*few.columns, "q"]
    gap = rows.join(cells.select("id", "q"), "id").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert gap < 1e-9


def test_forest_on_cells_weighs_every_row(labelled, monkeypatch):
    monkeypatch.setattr(model, "WHOLE_ROWS", 1000)
    fitted = model.fit_forest(labelled, FEATURES, trees=10, depth=5)
    assert len(fitted.stages) == 4
    assert model.auc(model.score(fitted, labelled, FEATURES)) > 0.98


def test_large_partitions_are_spread(spark, labelled):
    assert model._spread(labelled.coalesce(1), 1000).rdd.getNumPartitions() == 6
    assert model._spread(labelled, 2000).rdd.getNumPartitions() == 4


def test_shuffled_copies_permute_whole_rows(labelled):
    seen = []
    for both in model.shuffled_copies(labelled, FEATURES, ["id"], [1, 2]):
        own, other = (sorted(map(tuple, both.select(*cs).collect())) for cs in (FEATURES, [f"shadow_{f}" for f in FEATURES]))
        assert own == other and len(own) == 6000
        assert both.columns == ["y", "a", "b", "shadow_a", "shadow_b"]
        seen.append(both.filter("a = shadow_a AND b = shadow_b").count())
    assert max(seen) < 600
    assert len(seen) == 2
