"""Plain versions of statistics, value by value."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from tablewise.functions.tails import normal_sf

# Polynomial coefficients published by Royston, lowest power first.
_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_GAMMA = (-2.273, 0.459)
_SMALL_MEAN = (0.544, -0.39978, 0.025054, -0.0006714)
_SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    return sum(c * x**k for k, c in enumerate(coefficients))


def shapiro_wilk(sample: np.ndarray) -> tuple[float, float]:
    """Return (W, p); (nan, 0) for fewer than 3 values or a constant sample."""
    x = np.sort(np.asarray(sample, dtype=float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return float("nan"), 0.0
    if n == 3:
        weights = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        quantile = NormalDist().inv_cdf
        m = np.array([quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        total = float(m @ m)
        u = 1.0 / math.sqrt(n)
        last = m[-1] / math.sqrt(total) + _poly(_LAST, u)
        if n > 5:
            second = m[-2] / math.sqrt(total) + _poly(_NEXT, u)
            phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        else:
            phi = (total - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        weights = m / math.sqrt(phi)
        weights[0], weights[-1] = -last, last
        if n > 5:
            weights[1], weights[-2] = -second, second
    centred = x - x.mean()
    w = min(float(weights @ centred) ** 2 / float(centred @ centred), 1.0)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(max(p, 0.0), 1.0)
    if w >= 1.0:
        return w, 1.0
    if n <= 11:
        gamma = _poly(_SMALL_GAMMA, n)
        y = math.log1p(-w)
        if y >= gamma:
            return w, 0.0
        z = (-math.log(gamma - y) - _poly(_SMALL_MEAN, n)) / math.exp(_poly(_SMALL_LOG_SD, n))
    else:
        ln = math.log(n)
        z = (math.log1p(-w) - _poly(_LARGE_MEAN, ln)) / math.exp(_poly(_LARGE_LOG_SD, ln))
    return w, normal_sf(z)
