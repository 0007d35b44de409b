"""Time buckets, trends, prior windows and velocity features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.bands import classify
from riskloom.functions.scalars import calendar_buckets
from riskloom.operators.ordered import frames, trailing
from riskloom.operators.rows import with_row
from riskloom.operators.segments import rates_by_sets, with_risk

DAY = 86_400
HOUR = 3_600


def bucket_rates(df: DataFrame, bucket: str, dt: str, target: str, amount: str) -> DataFrame:
    """Count, amount, share, average, rate and risk per hour, day, dow, week or month."""
    rates = df.groupBy(calendar_buckets(dt)[bucket].alias(bucket)).agg(
        F.count(target).alias("total"), F.sum(target).alias("positives"),
        F.sum(amount).alias("amount"), F.avg(amount).alias("mean_amount"),
    )
    return with_risk(rates, df, target)


def rates_over_time(df: DataFrame, dt: str, target: str) -> DataFrame:
    """Hour, day and week rates in one long table, from one scan."""
    staged = df.select(target, *[c.alias(f"__{n}") for n, c in calendar_buckets(dt).items() if n in ("hour", "day", "week")])
    out = rates_by_sets(staged, {"hour": ["__hour"], "day": ["__day"], "week": ["__week"]}, target)
    return out.select(
        F.col("grouping").alias("kind"), F.coalesce("__hour", "__day", "__week").alias("bucket"), "total", "positives", "rate_pct"
    )


# The windows below run over bucket tables: one row per day, week or month.


def _previous(c: str, order: str) -> Column:
    return F.lag(c).over(Window.orderBy(order))


def growth(c: str, order: str) -> Column:
    """Change against the previous bucket."""
    return F.try_divide(F.col(c).cast("double"), _previous(c, order)) - 1.0


def with_growth(buckets: DataFrame, order: str, column: str) -> DataFrame:
    return buckets.withColumn(f"{column}_growth", growth(column, order))


def trends(df: DataFrame, dt: str, target: str, width: int = 7) -> DataFrame:
    """Daily positives with rolling mean and std, day-over-day growth and spikes."""
    daily = df.groupBy(calendar_buckets(dt)["day"].alias("day")).agg(F.count(target).alias("total"), F.sum(target).alias("positives"))
    daily = daily.withColumn("rate_pct", F.col("positives") * 100.0 / F.col("total"))
    w = Window.orderBy("day").rowsBetween(-(width - 1), 0)
    out = daily.withColumns(
        {
            "rolling_positives": F.avg("positives").over(w),
            "rolling_rate": F.avg("rate_pct").over(w),
            "rolling_std": F.coalesce(F.stddev_samp("positives").over(w), F.lit(0.0)),
            "growth": growth("positives", "day"),
        }
    )
    spike = (F.col("positives") - F.col("rolling_positives")) > 2.0 * F.col("rolling_std")
    return out.withColumn("is_spike", spike.cast("int"))


def temporal_anomalies(df: DataFrame, dt: str, width: int = 7, limit: float = 2.5) -> DataFrame:
    """Days whose count is far from the rolling mean; the window contains the day itself."""
    daily = df.groupBy(calendar_buckets(dt)["day"].alias("day")).agg(F.count(F.lit(1)).alias("total"))
    w = Window.orderBy("day").rowsBetween(-(width - 1), 0)
    out = daily.withColumns(
        {"rolling_mean": F.avg("total").over(w), "rolling_std": F.coalesce(F.stddev_samp("total").over(w), F.lit(0.0))}
    )
    z = F.when(F.col("rolling_std") > 0, (F.col("total") - F.col("rolling_mean")) / F.col("rolling_std")).otherwise(0.0)
    return out.withColumn("z", z).withColumn("is_anomaly", (F.abs("z") > limit).cast("int"))


def seasonality(df: DataFrame, dt: str) -> DataFrame:
    """Count over the even share per hour of day and day of week, empty buckets included."""
    buckets = calendar_buckets(dt)
    staged = df.select(buckets["hour"].alias("hour"), buckets["dow"].alias("dow"))
    counts = staged.groupingSets([[F.col("hour")], [F.col("dow")]], F.col("hour"), F.col("dow")).agg(
        F.count(F.lit(1)).alias("n"), F.grouping("hour").alias("g")
    )
    counts = counts.select(
        F.when(F.col("g") == 0, "hour").otherwise("dow").alias("dimension"), F.coalesce("hour", "dow").alias("bucket"), "n"
    )
    spark = df.sparkSession
    grid = spark.range(24).select(F.lit("hour").alias("dimension"), F.col("id").alias("bucket"), F.lit(24.0).alias("k"), F.lit(0.15).alias("strong"))
    grid = grid.unionByName(
        spark.range(7).select(F.lit("dow").alias("dimension"), F.col("id").alias("bucket"), F.lit(7.0).alias("k"), F.lit(0.05).alias("strong"))
    )
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    n = F.coalesce("n", F.lit(0))
    index = n * F.col("k") / F.col("rows")
    return (
        grid.join(F.broadcast(counts), ["dimension", "bucket"], "left").transform(with_row, total)
        .select("dimension", "bucket", n.alias("n"), index.alias("seasonal_index"),
                F.when(F.abs(index - 1.0) > F.col("strong"), "Strong").otherwise("Weak").alias("strength"))
    )


def span_summary(df: DataFrame, dt: str) -> DataFrame:
    one = df.agg(F.min(dt).alias("first"), F.max(dt).alias("last"), F.count(F.lit(1)).alias("n"))
    days = (F.col("last") - F.col("first")) / F.lit(float(DAY))
    per_day = F.coalesce(F.try_divide(F.col("n").cast("double"), days), F.lit(0.0))
    return one.select("first", "last", "n", (F.col("last") - F.col("first")).alias("span_seconds"), days.alias("span_days"),
                      per_day.alias("per_day"), (per_day / 24.0).alias("per_hour"))


def hour_drift(train: DataFrame, test: DataFrame, dt: str, floor: float = 1e-5) -> DataFrame:
    """PSI and Jensen-Shannon contributions of each hour of the day."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(calendar_buckets(dt)["hour"].alias("hour")).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n").alias("t"))
        return counts.transform(with_row, total).select("hour", (F.col("n") / F.col("t")).alias(name))

    hours = train.sparkSession.range(24).select(F.col("id").alias("hour"))
    out = hours.join(F.broadcast(shares(train, "q")), "hour", "left").join(F.broadcast(shares(test, "p")), "hour", "left").fillna(0.0, ["p", "q"])
    safe = lambda c: F.greatest(c, F.lit(floor))
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2.0
    return out.select(
        "hour", (q * 100.0).alias("train_pct"), (p * 100.0).alias("test_pct"),
        ((p - q) * F.log(safe(p) / safe(q))).alias("psi"),
        (0.5 * (p * F.log(safe(p) / safe(m)) + q * F.log(safe(q) / safe(m)))).alias("jsd"),
    )


def hour_drift_summary(contributions: DataFrame) -> DataFrame:
    return contributions.agg(F.sum("psi").alias("psi_total"), F.sum("jsd").alias("jsd_total")).withColumn(
        "status", classify("temporal_drift", "psi_total")
    )


# --- row-level windows, skew-safe ----------------------------------------------------


def prior_windows(
    df: DataFrame, key: str, order: Sequence[str], value: str, width: int = 5, *, rows_per_block: int | None = None
) -> DataFrame:
    """Mean and count of all earlier rows and mean of the ``width`` rows before, per key.

    The current row never enters its own features.  Rows without a key get 0.
    """
    names = {"mean": f"{key}_{value}_prior_mean", "count": f"{key}_{value}_prior_count", "roll": f"{key}_{value}_roll_mean"}
    known, unknown = df.filter(F.col(key).isNotNull()), df.filter(F.col(key).isNull())
    v = F.col(value).cast("double")
    out = frames(
        known, [key], order, {"__s": F.coalesce(v, F.lit(0.0)), "__c": v.isNotNull().cast("long")},
        {"__r": lambda w: F.avg(v).over(w.rowsBetween(-width, -1))}, width, inclusive=False, rows_per_block=rows_per_block,
    )
    zero = F.lit(0.0)
    out = out.withColumns(
        {
            names["mean"]: F.coalesce(F.try_divide(F.col("__s"), F.col("__c")), zero),
            names["count"]: F.col("__c").cast("long"),
            names["roll"]: F.coalesce(F.col("__r"), zero),
        }
    ).drop("__s", "__c", "__r")
    blank = unknown.withColumns({names["mean"]: zero, names["count"]: F.lit(0).cast("long"), names["roll"]: zero})
    return out.unionByName(blank)


def inter_arrival(df: DataFrame, order: Sequence[str], out: str, first: float = 60.0, *, rows_per_block: int | None = None) -> DataFrame:
    """Seconds since the previous transaction of the whole table."""
    dt = order[0]
    gapped = trailing(df, [], order, 1, {out: lambda w: F.col(dt) - F.lag(dt).over(w)}, rows_per_block=rows_per_block)
    return gapped.withColumn(out, F.coalesce(F.col(out).cast("double"), F.lit(first)))


def time_since_last(df: DataFrame, key: str, order: Sequence[str], out: str, *, rows_per_block: int | None = None) -> DataFrame:
    dt = order[0]
    return trailing(df, [key], order, 1, {out: lambda w: F.col(dt) - F.lag(dt).over(w)}, rows_per_block=rows_per_block)


def recent_count(df: DataFrame, key: str, dt: str, seconds: int, out: str) -> DataFrame:
    """Earlier transactions of the same key within the last ``seconds`` (same instant excluded).

    Rows are reduced to counts per (key, second) and cut into time slices of
    ``seconds``; each slice also sees the slice before it.  A group is one key
    in two slices of distinct seconds, so its size is at most ``2 * seconds``.
    """
    per_second = df.filter(F.col(key).isNotNull()).groupBy(key, dt).agg(F.count(F.lit(1)).alias("__n"))
    slice_no = F.floor(F.col(dt) / seconds)
    copies = per_second.withColumn("__slice", F.explode(F.array(slice_no, slice_no + 1)))
    w = Window.partitionBy(key, "__slice").orderBy(dt).rangeBetween(-seconds, -1)
    counted = (
        copies.withColumn(out, F.coalesce(F.sum("__n").over(w), F.lit(0)))
        .filter(F.col("__slice") == slice_no).select(key, dt, out)
    )
    return df.join(counted, [key, dt], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))
