"""The verdict registry under two writers, thresholds of streams whose events arrive out of order, runs by value."""

import pytest
from pyspark.sql import functions as F

from riskloom.session import work_path
from riskloom.sources.governance import Conflict, VerdictRegistry
from riskloom.stages.analysis import report_values
from riskloom.streaming import replay, scoring

VERDICT = "view string, version string, feature string, null_ratio double, variance double, psi double, status string, tag string"


def verdict(spark, view, version, feature, status):
    return spark.createDataFrame([(view, version, feature, 0.0, 1.0, None, status, "OK")], VERDICT)


def test_of_two_writers_one_wins(spark):
    base = work_path(spark, "verdicts")
    one, two = VerdictRegistry(spark, base), VerdictRegistry(spark, base)
    assert one.version() == 0 and one.current().collect() == [] and one.rejected().collect() == []
    assert one.commit(verdict(spark, "a", "v1", "x", "FAIL"), 0) == 1
    with pytest.raises(Conflict):
        two.commit(verdict(spark, "b", "v1", "y", "PASS"), 0)
    assert [r["view"] for r in two.current().collect()] == ["a"]  # the loser's rows stay unseen
    assert two.publish(verdict(spark, "b", "v1", "y", "PASS")) == 2
    assert [(r["view"], r["features"]) for r in one.rejected().collect()] == [("a", ["x"])]
    assert one.publish(verdict(spark, "a", "v2", "x", "PASS")) == 3
    assert sorted((r["view"], r["version"], r["commit"]) for r in two.current().collect()) == [("a", "v2", 3), ("b", "v1", 2)]
    assert one.history().count() == 3 and one.rejected().collect() == []


def test_thresholds_of_late_and_unordered_events(spark):
    day = 86_400
    rows = [(1, d * day + i, i == 0) for d in (1, 0, 3, 2) for i in range(4)]  # a quarter of hits: down each day
    rows += [(2, d * day, None) for d in (2, 0)] + [(None, day, True), (1, None, True), (1, 9 * day, False)]
    late = [(1, 5, True), (2, 6, True)]  # days behind the newest event
    frames = [spark.createDataFrame(r, "policy long, s long, hit boolean").withColumn("ts", F.timestamp_seconds("s")) for r in (rows, late)]
    out = work_path(spark, "thresholds")

    def start(stream):
        return scoring.thresholds_from_events(stream, "policy", "ts", F.col("hit")).writeStream.outputMode("append").format("parquet").option("path", out)

    with scoring.rocks_state(spark):
        replay.replay(frames, start)
    found = sorted((r["policy"], r["start"] // day, round(r["threshold"], 6)) for r in spark.read.parquet(out).collect())
    assert found == [(1, 0, 0.45), (1, 1, 0.4), (1, 2, 0.35), (1, 3, 0.3), (2, 0, 0.55), (2, 2, 0.6)]


def test_values_of_reports(spark):
    one = spark.createDataFrame([("a", None, 2, True, "x"), (None, 3, None, None, None)], "k string, j int, n long, flag boolean, word string")
    none = one.limit(0).select("n")
    found = report_values({"one": one, "none": none}, {"one": ["k", "j"], "none": []}).collect()
    assert sorted((r["report"], r["item"], r["metric"], r["number"], r["text"]) for r in found) == [
        ("one", "a", "flag", 1.0, None), ("one", "a", "n", 2.0, None), ("one", "a", "word", None, "x"),
    ]
