"""Scalar feature expressions: time, amounts, e-mail, device, ratios, clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400
HOUR = 3_600

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time -------------------------------------------------------------------


def seconds_since(ts: Column | str, epoch_date: str) -> Column:
    """Whole seconds since midnight of ``epoch_date``; independent of time zones."""
    c = col(ts)
    days = F.datediff(F.to_date(c), F.to_date(F.lit(epoch_date))).cast("long")
    return days * DAY + F.hour(c) * HOUR + F.minute(c) * 60 + F.second(c)


def hour_of_day(dt: Column | str) -> Column:
    return F.pmod(col(dt), F.lit(DAY)) / F.lit(float(HOUR))


def time_family(dt: Column | str) -> dict[str, Column]:
    hour = hour_of_day(dt)
    return {
        "hour_of_day": hour,
        "day_of_week": F.pmod(F.floor(col(dt) / DAY), F.lit(7)).cast("int"),
        "is_business_hour": hour.between(9.0, 17.0).cast("int"),
    }


def calendar_buckets(dt: Column | str) -> dict[str, Column]:
    """Hour, day, weekday, week and 30-day month, by floor division."""
    c = col(dt)
    day = F.floor(c / DAY)
    return {
        "hour": F.pmod(F.floor(c / HOUR), F.lit(24)),
        "day": day,
        "dow": F.pmod(day, F.lit(7)),
        "week": F.floor(c / (7 * DAY)),
        "month": F.floor(c / (30 * DAY)),
    }


def cyclic_hour(dt: Column | str) -> dict[str, Column]:
    angle = hour_of_day(dt) * F.lit(2.0) * F.pi() / F.lit(24.0)
    return {"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)}


# --- amounts and ratios -----------------------------------------------------


def amount_family(amt: Column | str, high_value: float = 150.0) -> dict[str, Column]:
    filled = F.coalesce(col(amt), F.lit(0.0))
    return {
        "log_amount": F.log1p(filled),
        "is_high_value": (filled > high_value).cast("int"),
        "cents": filled % F.lit(1.0),
    }


def amount_per_count(amt: Column | str, count: Column | str) -> Column:
    c = col(count)
    return col(amt) / F.when(c == 0, F.lit(1)).otherwise(c)


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    v = col(c).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def safe_ratio(num: Column | str, den: Column | str, default: float = 1.0) -> Column:
    """Zero numerator gives 0, zero denominator or overflow gives the default."""
    n = F.coalesce(col(num).cast("double"), F.lit(0.0))
    d = F.coalesce(col(den).cast("double"), F.lit(0.0))
    quotient = finite(F.try_divide(n, d))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.coalesce(quotient, F.lit(default)))


def safe_difference(a: Column | str, b: Column | str) -> Column:
    zero = F.lit(0.0)
    gap = F.coalesce(col(a).cast("double"), zero) - F.coalesce(col(b).cast("double"), zero)
    return F.coalesce(finite(gap), zero)


def interaction(a: Column | str, b: Column | str, op: str) -> Column:
    zero = F.lit(0.0)
    x = F.coalesce(col(a).cast("double"), zero)
    y = F.coalesce(col(b).cast("double"), zero)
    results = {
        "multiply": x * y,
        "divide": F.coalesce(finite(F.try_divide(x, y)), zero),
        "add": x + y,
        "subtract": x - y,
    }
    if op not in results:
        raise ValueError(f"unknown interaction {op!r}")
    return results[op]


def safe_divide(n: Column | str, d: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(col(n).cast("double"), col(d).cast("double")), F.lit(default))


def discover_pairs(
    columns: Sequence[str], numerators: Sequence[str], suffixes: Sequence[str]
) -> list[tuple[str, str]]:
    """(numerator, statistic) pairs by name: the statistic names the numerator and ends in a suffix."""
    return [
        (n, c)
        for n in numerators
        if n in columns
        for c in columns
        if c != n and n in c and any(c.endswith(s) for s in suffixes)
    ]


# --- e-mail, address, card, identity ----------------------------------------

# Domains that hand out free mailboxes.
FREE_MAIL_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com"]


def email_family(purchaser: Column | str, recipient: Column | str) -> dict[str, Column]:
    p, r = F.lower(col(purchaser)), F.lower(col(recipient))
    no = F.lit(False)
    return {
        "email_match": p.eqNullSafe(r).cast("int"),
        "p_is_free": F.coalesce(p.isin(FREE_MAIL_DOMAINS), no).cast("int"),
        "r_is_free": F.coalesce(r.isin(FREE_MAIL_DOMAINS), no).cast("int"),
    }


def missing_flags(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_is_missing": F.col(c).isNull().cast("int") for c in columns}


def contains_flag(c: Column | str, *words: str) -> Column:
    text = F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words]).cast("int")


def card_family(network: Column | str) -> dict[str, Column]:
    return {
        "is_visa": contains_flag(network, "visa"),
        "is_mastercard": contains_flag(network, "mastercard"),
    }


def device_family(device: Column | str) -> dict[str, Column]:
    return {
        "is_windows": contains_flag(device, "windows"),
        "is_apple": contains_flag(device, "ios", "mac", "iphone"),
        "is_android": contains_flag(device, "android", "samsung", "huawei"),
    }


def present_count(columns: Sequence[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def completeness(columns: Sequence[str]) -> Column:
    return present_count(columns) / F.lit(float(len(columns)))


# --- missing values ---------------------------------------------------------


def _null_flag(df_columns: Sequence[str], c: str) -> Column:
    return F.col(c).isNull().cast("int") if c in df_columns else F.lit(1)


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """0/1 per requested column; an absent column counts as missing."""
    return {f"{c}_missing": _null_flag(df.columns, c).cast("double") for c in columns}


def row_missing_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    count = sum((_null_flag(df.columns, c) for c in columns), F.lit(0))
    ratio = count / F.lit(float(max(1, len(columns))))
    return {"missing_count": count, "missing_ratio": ratio, "completeness": F.lit(1.0) - ratio}


def missing_pattern(df: DataFrame, columns: Sequence[str]) -> Column:
    """Code of the null pattern: column ``i`` adds 2**i when missing.

    Up to 62 columns give a number, more columns the same code as binary digits.
    """
    flags = [_null_flag(df.columns, c) for c in columns]
    if len(columns) > 62:
        return F.concat(*[flag.cast("int").cast("string") for flag in reversed(flags)])
    return sum((flag.cast("long") * F.lit(1 << i) for i, flag in enumerate(flags)), F.lit(0))


def family_signature(families: Mapping[str, Sequence[str]]) -> Column:
    """Names of the families with any null, joined by ``|``; "No Missing Families" when none."""
    parts = [
        F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]), F.lit(name))
        for name, cols in families.items()
    ]
    text = F.concat_ws("|", *parts)
    return F.when(text == "", F.lit("No Missing Families")).otherwise(text)


# --- model matrix -----------------------------------------------------------


def model_matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric features as doubles with null, NaN and infinities set to 0."""
    if not features:
        raise ValueError("no features")
    return df.select(*keep, *[F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in features])


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Same columns in the same order as at fit time; a missing column is an error."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("duplicate column names")
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"missing features {absent}")
    return df.select(*keep, *features)


def project_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Fixed serving schema: absent features and nulls become 0.0."""
    return df.select(
        *keep,
        *[
            (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
            for c in features
        ],
    )


def clean_score(p: Column | str) -> Column:
    """NaN and -inf become 0, +inf becomes 1."""
    c = col(p).cast("double")
    return (
        F.when(F.isnan(c) | (c == float("-inf")), 0.0).when(c == float("inf"), 1.0).otherwise(c)
    )


def clip_probability(p: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(p).cast("double")))
