"""Tail probabilities of test statistics as Column expressions.

Each is a short series or continued fraction, evaluated from its last term
inwards.  Test results have one row per feature, so the fixed number of terms
costs nothing, and no Python runs in the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.scalars import col


def _upwards(terms: int) -> Column:
    return F.sequence(F.lit(1), F.lit(terms))


def _downwards(terms: int) -> Column:
    return F.sequence(F.lit(terms), F.lit(1), F.lit(-1))


def ks_sf(stat: Column | str, n: Column | str, m: Column | str, terms: int = 100) -> Column:
    """Asymptotic two-sided Kolmogorov-Smirnov p-value."""
    lam = col(stat) * F.sqrt(col(n) * col(m) / (col(n) + col(m)))
    series = F.aggregate(
        _upwards(terms),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def log_gamma(z: Column) -> Column:
    """log of the gamma function for z > 0: Stirling after a shift by ten."""
    s = z + 10.0
    stirling = (s - 0.5) * F.log(s) - s + 0.5 * math.log(2 * math.pi) + 1 / (12.0 * s) - 1 / (360.0 * s * s * s) + 1 / (1260.0 * s * s * s * s * s) - 1 / (1680.0 * s * s * s * s * s * s * s)
    product = z
    for i in range(1, 10):
        product = product * (z + float(i))
    return stirling - F.log(product)


def _gamma_q(a: Column, x: Column, terms: int = 400) -> Column:
    """Upper regularised incomplete gamma function."""
    front = F.exp(-x + a * F.log(x) - log_gamma(a))
    # Series for the lower function, as a Horner scheme from the last term.
    lower = F.aggregate(_downwards(terms), F.lit(1.0), lambda acc, k: F.lit(1.0) + acc * x / (a + k))
    by_series = F.lit(1.0) - front * lower / a
    # Continued fraction for the upper function.
    tail = F.aggregate(
        _downwards(terms), F.lit(0.0), lambda acc, k: (k * (k - a)) / (x + 1.0 + 2.0 * k - a - acc)
    )
    by_fraction = front / (x + 1.0 - a - tail)
    return F.when(x <= 0, 1.0).when(x < a + 1.0, by_series).otherwise(by_fraction)


def chi2_sf(x: Column | str, dof: Column | str) -> Column:
    """P(chi-square > x)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _gamma_q(col(dof).cast("double") / 2.0, col(x).cast("double") / 2.0)))


def normal_sf(z: Column | str) -> Column:
    """P(Z > z)."""
    v = col(z).cast("double")
    upper = _gamma_q(F.lit(0.5), v * v / 2.0) / 2.0
    return F.when(v >= 0, upper).otherwise(F.lit(1.0) - upper)


def _beta_fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a

    def step(acc: Column, m: Column) -> Column:
        half = F.floor(m / 2).cast("double")
        even = half * (b - half) * x / ((a + 2.0 * half - 1.0) * (a + 2.0 * half))
        odd = -(a + half) * (a + b + half) * x / ((a + 2.0 * half) * (a + 2.0 * half + 1.0))
        return F.lit(1.0) + F.when(m % 2 == 0, even).otherwise(odd) / acc

    return front / F.aggregate(_downwards(terms), F.lit(1.0), step)


def beta_i(a: Column, b: Column, x: Column, terms: int = 400) -> Column:
    """Regularised incomplete beta function."""
    inner = F.least(F.greatest(x, F.lit(1e-300)), F.lit(1.0 - 1e-16))
    direct = _beta_fraction(a, b, inner, terms)
    mirrored = F.lit(1.0) - _beta_fraction(b, a, F.lit(1.0) - inner, terms)
    value = F.when(inner <= (a + 1.0) / (a + b + 2.0), direct).otherwise(mirrored)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(value)


def f_sf(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    """P(F > f)."""
    v, a, b = col(f).cast("double"), col(d1).cast("double"), col(d2).cast("double")
    p = beta_i(b / 2.0, a / 2.0, b / (b + a * v))
    return F.when(v <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
