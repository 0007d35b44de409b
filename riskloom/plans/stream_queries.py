"""Streams over the events table; each is compared with its batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.plans.profile_queries import _round
from riskloom.plans.registry import query
from riskloom.plans.views import EV_SQL, ev, rounded
from riskloom.session import work_path
from riskloom.streaming import monitor, replay, scoring

_CUT = 15 * 86_400


def _slices(df):
    """The events in two arrivals, in time order."""
    return [df.filter(F.col("dt") < _CUT), df.filter(F.col("dt") >= _CUT)]


def _logistic():
    return F.round(1.0 / (1.0 + F.exp(-(F.col("amt") - 100.0) / 50.0)), 6)


_P = "round(1 / (1 + exp(-(amt - 100) / 50)), 6)"


@query("stream_scoring", f"SELECT id, {_P} AS p, CASE WHEN {_P} >= 0.5 THEN 'BLOCK' ELSE 'ALLOW' END AS action FROM {EV_SQL}")
def stream_scoring(spark, d):
    out = work_path(spark, "scored")

    def start(stream):
        scored = scoring.score_events(stream, ["amt", "absent"], _logistic(), ["id"])
        return scored.writeStream.outputMode("append").format("parquet").option("path", out)

    replay.replay(_slices(ev(spark, d)), start)
    return spark.read.parquet(out)


@query("stream_review_status", f"SELECT id, {_P} AS p, CASE WHEN {_P} >= 0.5 THEN 'FLAGGED_FOR_REVIEW' ELSE 'APPROVED' END AS status FROM {EV_SQL}")
def stream_review_status(spark, d):
    out = work_path(spark, "reviewed")

    def start(stream):
        return scoring.review_status(stream, _logistic(), ["id"]).writeStream.outputMode("append").format("parquet").option("path", out)

    replay.replay(_slices(ev(spark, d)), start)
    return spark.read.parquet(out)


_EPOCH = "TIMESTAMP '2024-01-01'"


@query(
    "stream_windowed_metrics",
    f"""SELECT (dt // 3600) * 3600 AS window_start, count(*) AS requests, round(avg(y), 6) AS error_rate FROM {EV_SQL}
        GROUP BY 1 HAVING (dt // 3600) * 3600 + 3600 <= (SELECT max(dt) - 600 FROM {EV_SQL})""",
)
def stream_windowed_metrics(spark, d):
    out = work_path(spark, "windows")
    events = ev(spark, d).withColumn("ts", F.timestamp_seconds("dt"))

    def start(stream):
        windows = monitor.windowed_metrics(stream, "ts", "amt", F.col("y") == 1)
        return windows.writeStream.outputMode("append").format("parquet").option("path", out)

    replay.replay(_slices(events), start)
    return spark.read.parquet(out).select(
        F.unix_seconds("start").alias("window_start"), "requests", rounded("error_rate").alias("error_rate")
    )


@query(
    "stream_latency_percentiles",
    f"""SELECT (dt // 86400) * 86400 AS window_start, quantile_disc(amt, 0.5) AS p50, quantile_disc(amt, 0.95) AS p95, quantile_disc(amt, 0.99) AS p99 FROM {EV_SQL}
        GROUP BY 1 HAVING (dt // 86400) * 86400 + 86400 <= (SELECT max(dt) - 600 FROM {EV_SQL})""",
)
def stream_latency_percentiles(spark, d):
    out = work_path(spark, "latency")
    events = ev(spark, d).withColumn("ts", F.timestamp_seconds("dt"))

    def start(stream):
        windows = monitor.windowed_metrics(stream, "ts", "amt", F.col("y") == 1, "1 day")
        return windows.writeStream.outputMode("append").format("parquet").option("path", out)

    replay.replay(_slices(events), start)
    return spark.read.parquet(out).select(F.unix_seconds("start").alias("window_start"), "p50", "p95", "p99")


@query(
    "stream_online_logistic",
    f"""WITH w0 AS (SELECT 0.5 * avg(y - 0.5) AS b, 0.5 * avg((y - 0.5) * (amt / 100.0)) AS a FROM {EV_SQL} WHERE dt < {_CUT}),
        e AS (SELECT y - 1 / (1 + exp(-(a * (amt / 100.0) + b))) AS err, amt / 100.0 AS x FROM {EV_SQL}, w0 WHERE dt >= {_CUT}),
        w1 AS (SELECT (SELECT b FROM w0) + 0.5 * avg(err) AS b, (SELECT a FROM w0) + 0.5 * avg(err * x) AS a FROM e)
        SELECT 'amount' AS feature, round(a, 8) AS weight FROM w1 UNION ALL SELECT 'bias', round(b, 8) FROM w1""",
)
def stream_online_logistic(spark, d):
    frame = ev(spark, d).select("dt", "y", (F.col("amt") / 100.0).alias("amount"), F.lit(1.0).alias("bias"))
    learner = scoring.OnlineLogistic(spark, ["amount", "bias"], rate=0.5)
    replay.replay(_slices(frame), lambda s: s.writeStream.foreachBatch(learner.update))
    return _round(learner.weights(spark, 1), 8)


_RATES = f"(SELECT key % 7 AS policy, dt // 86400 AS bucket, avg((y = 1 AND amt > 100)::INT) AS rate FROM {EV_SQL} GROUP BY 1, 2)"
_FOLD = f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY bucket) AS i FROM {_RATES}),
    f AS (SELECT policy, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS bucket, CAST(0.5 AS DOUBLE) AS t FROM (SELECT DISTINCT policy FROM r)
    UNION ALL SELECT r.policy, r.i, r.bucket, CASE WHEN r.rate > 0.05 THEN greatest(0.2::DOUBLE, t - 0.05::DOUBLE) WHEN r.rate < 0.01 THEN least(0.8::DOUBLE, t + 0.05::DOUBLE) ELSE t END
    FROM f JOIN r ON f.policy = r.policy AND r.i = f.i + 1)
    SELECT policy, bucket, round(t, 6) AS threshold FROM f WHERE i > 0"""


def _rates(spark, d):
    hit = ((F.col("y") == 1) & (F.col("amt") > 100)).cast("int")
    return ev(spark, d).groupBy((F.col("key") % 7).alias("policy"), F.floor(F.col("dt") / 86400).alias("bucket")).agg(F.avg(hit).alias("rate"))


@query("adaptive_threshold", _FOLD)
def adaptive_threshold(spark, d):
    return _round(scoring.thresholds_over_time(_rates(spark, d), "policy", "bucket", "rate"))


@query("stream_adaptive_threshold", _FOLD)
def stream_adaptive_threshold(spark, d):
    out = work_path(spark, "thresholds")
    rates = _rates(spark, d)
    slices = [rates.filter("bucket < 15"), rates.filter("bucket >= 15")]

    def start(stream):
        return scoring.threshold_stream(stream, "policy", "bucket", "rate").writeStream.outputMode("append").format("parquet").option("path", out)

    replay.replay(slices, start)
    return _round(spark.read.parquet(out))


_CLOSED = f"(SELECT * FROM {_RATES} WHERE (bucket + 1) * 86400 <= (SELECT max(dt) - 2 * 86400 FROM {EV_SQL}))"


@query("stream_thresholds_from_events", _FOLD.replace(_RATES, _CLOSED))
def stream_thresholds_from_events(spark, d):
    """Raw events in, half of one day arriving after newer events; thresholds of closed days out."""
    out = work_path(spark, "event-thresholds")
    events = ev(spark, d).select("id", "dt", (F.col("key") % 7).alias("policy"), ((F.col("y") == 1) & (F.col("amt") > 100)).alias("hit"), F.timestamp_seconds("dt").alias("ts"))
    early = (F.col("dt") < _CUT - 86_400) | ((F.col("dt") < _CUT) & (F.col("id") % 2 == 1))

    def start(stream):
        found = scoring.thresholds_from_events(stream, "policy", "ts", F.col("hit"))
        return found.writeStream.outputMode("append").format("parquet").option("path", out)

    with scoring.rocks_state(spark):
        replay.replay([events.filter(early), events.filter(~early)], start)
    return _round(spark.read.parquet(out).select("policy", F.floor(F.col("start") / 86_400).alias("bucket"), "threshold"))


@query("stream_drift_monitor")
def stream_drift_monitor(spark, d):
    out = work_path(spark, "drift")
    events = ev(spark, d).select("dt", "amt", "key")
    handler = monitor.drift_writer(events, ["amt", "key"], out)
    replay.replay(_slices(events), lambda s: s.writeStream.foreachBatch(handler))
    return spark.read.parquet(f"{out}/batch-0", f"{out}/batch-1")
