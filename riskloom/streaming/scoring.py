"""Stream scoring, online learning and the adaptive threshold."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from riskloom.functions.scalars import project_features
from riskloom.session import work_path


def score_events(events: DataFrame, features: Sequence[str], p: Column, keep: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Fixed feature schema, score and action; works on streams and on tables alike."""
    staged = project_features(events, features, keep).withColumn("p", p)
    return staged.select(*keep, "p", F.when(F.col("p") >= threshold, "BLOCK").otherwise("ALLOW").alias("action"))


def review_status(events: DataFrame, p: Column, keep: Sequence[str], threshold: float = 0.5) -> DataFrame:
    scored = events.withColumn("p", p)
    return scored.select(*keep, "p", F.when(F.col("p") >= threshold, "FLAGGED_FOR_REVIEW").otherwise("APPROVED").alias("status"))


class OnlineLogistic:
    """Logistic weights updated once per micro-batch from gradient sums.

    The weights of batch ``b`` are a table ``<folder>/b``.  A batch that runs
    again starts from batch ``b - 1`` and writes the same folder, so a restart
    does not apply it twice.
    """

    def __init__(self, spark: SparkSession, features: Sequence[str], rate: float = 0.01):
        self.features, self.rate = list(features), rate
        self.folder = work_path(spark, "online-weights")

    def _read(self, spark: SparkSession, batch: int) -> dict[str, float]:
        if batch < 0:
            return {f: 0.0 for f in self.features}
        rows = spark.read.parquet(f"{self.folder}/{batch}").collect()
        return {r["feature"]: r["weight"] for r in rows}

    def update(self, df: DataFrame, batch: int) -> None:
        """``foreachBatch`` handler."""
        spark = df.sparkSession
        weights = self._read(spark, batch - 1)
        x = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features}
        z = sum((x[f] * weights[f] for f in self.features), F.lit(0.0))
        error = F.col("y") - 1.0 / (1.0 + F.exp(-z))
        sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(error * x[f]).alias(f) for f in self.features]).first()
        n = max(1, sums["n"])
        fresh = [(f, weights[f] + self.rate * (sums[f] or 0.0) / n) for f in self.features]
        spark.createDataFrame(fresh, "feature string, weight double").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{batch}")

    def weights(self, spark: SparkSession, batch: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{batch}")


# --- adaptive threshold ---------------------------------------------------------------------

# Start, step, limits and rate bands of the policy.
START, STEP, LOWEST, HIGHEST, MANY, FEW = 0.5, 0.05, 0.2, 0.8, 0.05, 0.01


def next_threshold(t: Column, rate: Column) -> Column:
    """Lower the threshold when many positives slip through, raise it when few do."""
    return (
        F.when(rate > MANY, F.greatest(F.lit(LOWEST), t - STEP)).when(rate < FEW, F.least(F.lit(HIGHEST), t + STEP)).otherwise(t)
    )


def thresholds_over_time(rates: DataFrame, policy: str, bucket: str, rate: str) -> DataFrame:
    """Threshold after each time bucket of each policy.

    ``rates`` has one row per policy and bucket (hours or days), so the ordered
    list that is folded grows with time, not with transactions.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(bucket).alias("b"), F.col(rate).alias("r"))))
    empty = F.array().cast("array<struct<b:bigint,t:double>>")
    start = F.struct(F.lit(START).alias("t"), empty.alias("path"))

    def fold(acc: Column, x: Column) -> Column:
        t = next_threshold(acc["t"], x["r"])
        return F.struct(t.alias("t"), F.concat(acc["path"], F.array(F.struct(x["b"].cast("bigint").alias("b"), t.alias("t")))).alias("path"))

    folded = rates.groupBy(policy).agg(steps.alias("__s")).select(policy, F.aggregate("__s", start, fold)["path"].alias("__p"))
    return folded.select(policy, F.explode("__p").alias("x")).select(policy, F.col("x.b").alias(bucket), F.col("x.t").alias("threshold"))


def threshold_stream(rates: DataFrame, policy: str, bucket: str, rate: str) -> DataFrame:
    """The same policy as a stateful stream: the threshold is the state of each policy."""
    start, step, low, high, many, few = START, STEP, LOWEST, HIGHEST, MANY, FEW

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = state.get[0] if state.exists else start
        rows = pd.concat(list(batches)).sort_values("bucket")
        path = []
        for r in rows["rate"]:
            if r > many:
                t = max(low, t - step)
            elif r < few:
                t = min(high, t + step)
            path.append(t)
        state.update((t,))
        yield pd.DataFrame({"policy": key[0], "bucket": rows["bucket"].to_numpy(), "threshold": path})

    staged = rates.select(F.col(policy).cast("long").alias("policy"), F.col(bucket).cast("long").alias("bucket"), F.col(rate).alias("rate"))
    return staged.groupBy("policy").applyInPandasWithState(
        advance, "policy long, bucket long, threshold double", "t double", "append", "NoTimeout"
    )


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which named states and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class ThresholdPolicy(StatefulProcessor):
    """The threshold of one policy.

    Closed buckets wait under their end until event time has passed it; a
    timer then applies all that wait up to there, in order of time, however
    the rows arrived.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.threshold = handle.getValueState("threshold", "t double")
        self.waiting = handle.getMapState("waiting", "ends long", "start long, rate double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            self.waiting.updateValue((row["ends"],), (row["start"], row["rate"]))
            self.handle.registerTimer(row["ends"])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = sorted((k[0], *v) for k, v in self.waiting.iterator() if k[0] <= expiredTimerInfo.getExpiryTimeInMs())
        t = self.threshold.get()[0] if self.threshold.exists() else START
        out = []
        for ends, start, rate in due:
            t = max(LOWEST, t - STEP) if rate > MANY else min(HIGHEST, t + STEP) if rate < FEW else t
            self.waiting.removeKey((ends,))
            out.append(Row(policy=key[0], start=start, threshold=t))
        if due:
            self.threshold.update((t,))
        return iter(out)

    def close(self) -> None:
        pass


def thresholds_from_events(events: DataFrame, policy: str, ts: str, hit: Column, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """``(policy, start, threshold)`` per closed bucket of an event stream; ``start`` in epoch seconds.

    Events are counted per policy and bucket first, with partial sums before
    the shuffle, so a hot policy sends one row a bucket to its state. An event
    later than ``delay`` behind the newest one is dropped; a bucket is
    published once, when event time has passed its end by ``delay``. A null
    policy or time is dropped, a null ``hit`` counts as no hit. Start the
    stream inside ``rocks_state``.
    """
    marked = events.select(F.col(policy).cast("long").alias("policy"), F.col(ts).alias("at"), F.coalesce(hit.cast("int"), F.lit(0)).alias("hit"))
    marked = marked.filter(F.col("policy").isNotNull() & F.col("at").isNotNull()).withWatermark("at", delay)
    rates = marked.groupBy("policy", F.window("at", width)).agg(F.avg("hit").alias("rate"))
    staged = rates.select(
        "policy", F.window_time("window").alias("at"), F.unix_seconds("window.start").alias("start"),
        (F.unix_seconds("window.end") * 1000).alias("ends"), "rate",
    )
    return staged.groupBy("policy").transformWithState(
        ThresholdPolicy(), "policy long, start long, threshold double", "append", "eventTime"
    )
