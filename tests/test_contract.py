"""The driver contract, sample queries against SQL, and plan rules."""

import io
import contextlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_check import compare, connect
from riskloom.operators import encode, joins, temporal
from riskloom.plans import views

SAMPLE = [
    "flagship_entity_risk", "safe_arithmetic", "numeric_statistics", "duplicate_audit", "two_way_segment_rates", "label_trends",
    "velocity_features", "target_encoder", "keyed_upsert", "psi_monitoring", "mann_whitney", "redundant_feature_groups",
    "pair_hotspots", "threshold_sweep", "audit_chain", "stream_scoring", "stream_adaptive_threshold", "aggregation_feature_stage",
    "stream_thresholds_from_events", "governed_verdicts", "leakage_analysis_values", "time_analysis_values",
]


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 100


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 0.8 * len(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_query_equals_sql(spark, small_dir, name):
    con = connect(small_dir)
    assert compare(spark, con, small_dir, entry.queries()[name], entry.oracle_sql()[name]) is None


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scan_reads_only_needed_columns(spark, small_dir):
    text = plan(views.txn(spark, small_dir, "train").select("id", "amt"))
    assert "o_custkey" not in text.split("ReadSchema")[1].splitlines()[0]
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in text


def test_no_python_and_no_cross_product_in_hot_paths(spark, small_dir):
    df = views.txn(spark, small_dir)
    for out in (
        temporal.prior_windows(df, "key", ["id"], "amt"),
        encode.out_of_fold_target(df, "key", "y", F.pmod("id", F.lit(5)).cast("int")),
    ):
        text = plan(out)
        for word in ("Python", "BroadcastNestedLoop", "CartesianProduct"):
            assert word not in text


def test_large_mapping_is_not_broadcast(spark, small_dir):
    df = views.txn(spark, small_dir)
    mapping = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(joins.lookup_join(df, mapping, ["key"]))
        assert "BroadcastHashJoin" not in plan(joins.lookup_join(df, mapping, ["key"], broadcast_rows=10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
