"""Sample-adjusted moments and the K-squared normality statistic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def adjust_skewness(n: Column, g: Column) -> Column:
    """Sample skewness from the population value: NULL below 3 values, 0 for a constant column."""
    return F.when(n >= 3, F.coalesce(g, F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def adjust_kurtosis(n: Column, g: Column) -> Column:
    """Sample excess kurtosis: NULL below 4 values, 0 for a constant column."""
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)
    return F.when(n >= 4, F.coalesce(value, F.lit(0.0)))


def adjusted_skewness(x: Column) -> Column:
    """Aggregate: sample skewness of ``x``."""
    return adjust_skewness(F.count(x).cast("double"), F.skewness(x))


def adjusted_kurtosis(x: Column) -> Column:
    """Aggregate: sample excess kurtosis of ``x``."""
    return adjust_kurtosis(F.count(x).cast("double"), F.kurtosis(x))


def skewness_z(n: Column, g: Column) -> Column:
    """D'Agostino (1970) transform of the population skewness ``g`` of ``n`` values."""
    y = g * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    y = F.when(y == 0, 1.0).otherwise(y)
    beta = (
        3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
        / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    )
    w2 = F.sqrt(2.0 * (beta - 1)) - 1.0
    delta = F.lit(1.0) / F.sqrt(F.log(w2) * 0.5)
    r = y / F.sqrt(F.lit(2.0) / (w2 - 1))
    return delta * F.log(r + F.sqrt(r * r + 1))


def kurtosis_z(n: Column, b: Column) -> Column:
    """Anscombe & Glynn (1983) transform of the population kurtosis ``b`` (3 for a normal)."""
    expected = (n - 1) * 3.0 / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b - expected) / F.sqrt(var)
    s = (
        6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
        * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = F.lit(8.0) / s * (F.lit(2.0) / s + F.sqrt(F.lit(4.0) / (s * s) + 1)) + 6.0
    d = x * F.sqrt(F.lit(2.0) / (a - 4)) + 1.0
    ratio = F.try_divide(F.lit(1.0) - F.lit(2.0) / a, F.abs(d))
    term = F.signum(d) * F.pow(ratio, F.lit(1.0 / 3.0))
    return (F.lit(1.0) - F.lit(2.0) / (a * 9.0) - term) / F.sqrt(F.lit(2.0) / (a * 9.0))


def k_squared(n: Column, g: Column, b: Column) -> Column:
    z1, z2 = skewness_z(n, g), kurtosis_z(n, b)
    return z1 * z1 + z2 * z2


def k_squared_p(statistic: Column) -> Column:
    """The chi-square tail with two degrees of freedom."""
    return F.exp(statistic * -0.5)
