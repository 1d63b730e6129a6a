"""Shapiro-Wilk W and its p-value after Royston (1995), for all groups of a table at once.

A group's weights depend on its size alone: the normal quantiles of its places, and two corrected weights at either end. So W
comes from sums over ranked rows (quantile squares, quantiles times values) and from the four outermost values; no group
is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

# Polynomial coefficients published by Royston, lowest power first.
LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -0.0006714)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)

# Wichura's rational approximations of the normal quantile (AS 241), lowest power first.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
# Hart's rational approximation of the normal tail, lowest power first.
HART = (
    (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911),
    (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184),
)


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def _ratio(pair: tuple, x: Column) -> Column:
    return _poly(pair[0], x) / _poly(pair[1], x)


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1, to double precision."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    tail = F.when(r <= 5.0, _ratio(TAIL, r - 1.6)).otherwise(_ratio(FAR_TAIL, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _ratio(CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, to double precision near the middle and a share of 1e-7 far out."""
    a = F.abs(z)
    front = F.exp(-a * a / 2.0)
    fraction = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
    upper = F.when(a > 37.0, 0.0).when(a < 7.07106781186547, front * _ratio(HART, a)).otherwise(front / (fraction * math.sqrt(2 * math.pi)))
    return F.when(z > 0, upper).otherwise(1.0 - upper)


def shapiro_wilk(rows: DataFrame, group: str, value: str, size: str, mean: str) -> DataFrame:
    """``(group, n, w, p)`` of every group; ``w`` is null and ``p`` 0 below three values or without spread.

    ``size`` and ``mean`` are the group's, on every row; values are not null. Groups are ranked by a window, so the
    caller keeps large ones away (the approximation holds up to 5,000 values).
    """
    n = F.col(size).cast("double")
    place = F.row_number().over(Window.partitionBy(group).orderBy(value))
    ranked = rows.select(F.col(group).alias("_group"), n.alias("n"), (F.col(value) - F.col(mean)).alias("c"), place.alias("i"))
    ranked = ranked.withColumn("m", normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    at = lambda k, x: F.max(F.when(F.col("i") == k, F.col(x)))
    sums = ranked.groupBy("_group").agg(
        F.first("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("c")).alias("mc"), F.sum(F.col("c") * F.col("c")).alias("cc"),
        F.max("m").alias("m1"), at(F.col("n") - 1, "m").alias("m2"), (F.max("c") - F.min("c")).alias("d1"), (at(F.col("n") - 1, "c") - at(2, "c")).alias("d2"),
    )
    # Each step is a column of its own, as the next one names it several times.
    n, mm, m1, m2, last, next_, w, y, ln, gamma, z = (F.col(c) for c in ("n", "mm", "m1", "m2", "last", "next", "w", "y", "ln", "gamma", "z"))
    steps = sums.withColumns({"u": 1.0 / F.sqrt(n), "root": F.sqrt(mm), "ln": F.log(n), "gamma": _poly(SMALL_GAMMA, n)})
    second = F.when(n > 5, F.try_divide(m2, F.col("root")) + _poly(NEXT, F.col("u"))).otherwise(0.0)
    steps = steps.withColumns({"last": F.try_divide(m1, F.col("root")) + _poly(LAST, F.col("u")), "next": second, "m2": F.when(n > 5, m2).otherwise(0.0)})
    phi = F.try_divide(mm - 2.0 * m1 * m1 - 2.0 * m2 * m2, 1.0 - 2.0 * last * last - 2.0 * next_ * next_)
    # The outermost quantiles leave the sum, their corrected weights enter it.
    middle = F.try_divide(F.col("mc") - m1 * F.col("d1") - m2 * F.coalesce("d2", F.lit(0.0)), F.sqrt(phi))
    total = F.when(n == 3, math.sqrt(0.5) * F.col("d1")).otherwise(middle + last * F.col("d1") + next_ * F.coalesce("d2", F.lit(0.0)))
    steps = steps.withColumn("total", total)
    steps = steps.withColumn("w", F.when((n >= 3) & (F.col("d1") > 0), F.least(F.try_divide(F.col("total") * F.col("total"), F.col("cc")), F.lit(1.0))))
    steps = steps.withColumn("y", F.when(w < 1.0, F.log1p(-w)))
    small = (-F.log(gamma - y) - _poly(SMALL_MEAN, n)) / F.exp(_poly(SMALL_LOG_SD, n))
    large = (y - _poly(LARGE_MEAN, ln)) / F.exp(_poly(LARGE_LOG_SD, ln))
    steps = steps.withColumn("z", F.when(n > 11, large).when(y < gamma, small))
    three = F.least(F.greatest(6.0 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))), F.lit(0.0)), F.lit(1.0))
    p = F.when(w.isNull(), 0.0).when(n == 3, three).when(w >= 1.0, 1.0).when(z.isNull(), 0.0).otherwise(normal_tail(z))
    return steps.select(F.col("_group").alias(group), n.cast("long").alias("n"), "w", p.alias("p"))
