"""Normal and t distributions as column expressions.

Spark has no distribution functions. The normal CDF is Hart's rational approximation in
the form published by West (2005), accurate to double precision. The t tail is the continued
fraction of the incomplete beta function, folded over a fixed number of steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.numbers import ColumnLike, col

# Coefficients of the published approximation, highest power first.
_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
        112.079291497871, 221.213596169931, 220.206867912376]
_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
_SPLIT = 7.07106781186547
_SQRT_TAU = 2.506628274631


def z_value(probability: float) -> float:
    """Standard normal quantile, a constant of the plan."""
    return NormalDist().inv_cdf(probability)


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_cdf(c: ColumnLike) -> Column:
    x = col(c).cast("double")
    a = F.abs(x)
    density = F.exp(-a * a / 2)
    near = density * _polynomial(a, _TOP) / _polynomial(a, _BOTTOM)
    fraction = reduce(lambda acc, k: a + F.lit(float(k)) / acc, (4, 3, 2, 1), a + F.lit(0.65))
    tail = F.when(a > 37, 0.0).when(a < _SPLIT, near).otherwise(density / fraction / _SQRT_TAU)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def two_sided_normal(c: ColumnLike) -> Column:
    """P(|Z| >= |c|), computed from the lower tail so that small values keep digits."""
    return F.lit(2.0) * normal_cdf(-F.abs(col(c)))


# Acklam's rational approximation of the normal quantile, highest power first.
_CENTRE_TOP = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690,
               -30.66479806614716, 2.506628277459239]
_CENTRE_BOTTOM = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972,
                  -13.28068155288572, 1.0]
_SIDE_TOP = [-7.784894002430293e-03, -0.3223964580411365, -2.400758277161838, -2.549732539343734,
             4.374664141464968, 2.938163982698783]
_SIDE_BOTTOM = [7.784695709041462e-03, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
_SIDE = 0.02425


def normal_quantile(c: ColumnLike) -> Column:
    """The value below which a standard normal lies with probability ``c``, for 0 < c < 1.

    A rational approximation and one step of Halley's method on the distribution function.
    """
    def first(low: Column) -> Column:
        q, r = low - 0.5, F.sqrt(-2 * F.log(low))
        centre = q * _polynomial(q * q, _CENTRE_TOP) / _polynomial(q * q, _CENTRE_BOTTOM)
        side = _polynomial(r, _SIDE_TOP) / _polynomial(r, _SIDE_BOTTOM)
        return F.when(low < _SIDE, side).otherwise(centre)

    def better(x: Column, low: Column) -> Column:
        off = (normal_cdf(x) - low) * F.lit(math.sqrt(2 * math.pi)) * F.exp(x * x / 2)
        return _with(off, lambda o: x - o / (1 + x * o / 2))

    def lower(low: Column) -> Column:
        return _with(first(low), lambda x: better(x, low))

    p = col(c).cast("double")
    x = _with(F.least(p, 1 - p), lower)
    return F.when((p > 0) & (p < 1), F.when(p > 0.5, -x).otherwise(x))


def normal_points(p: np.ndarray) -> np.ndarray:
    """Normal quantiles of an array, to nine digits, for draws inside tasks."""
    low = np.minimum(p, 1 - p)
    q, r = low - 0.5, np.sqrt(-2 * np.log(low))
    centre = q * np.polyval(_CENTRE_TOP, q * q) / np.polyval(_CENTRE_BOTTOM, q * q)
    side = np.polyval(_SIDE_TOP, r) / np.polyval(_SIDE_BOTTOM, r)
    return np.where(p > 0.5, -1, 1) * np.where(low < _SIDE, side, centre)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


# Lanczos coefficients of the gamma function for g = 7.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
            -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
            1.5056327351493116e-7]
_FRACTION_STEPS = 120
_LARGE_DF = 4000.0  # from here on the tail is that of a transformed normal, right to 8 digits
_NEWTON_STEPS = 24
_TINY = 1e-300


def log_gamma(c: ColumnLike) -> Column:
    """Logarithm of the gamma function for positive arguments of at least 0.5."""
    x = col(c).cast("double") - 1
    total = F.lit(_LANCZOS[0])
    for k, value in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(value) / (x + F.lit(float(k)))
    t = x + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.log(t) - t + F.log(total)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, folded from the front."""
    def kept(value: Column) -> Column:
        return F.when(F.abs(value) > _TINY, value).otherwise(_TINY)

    def step(state: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1 = F.lit(1.0) / kept(1 + even * state["d"])
        c1 = kept(1 + even / state["c"])
        d2 = F.lit(1.0) / kept(1 + odd * d1)
        c2 = kept(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (state["v"] * d1 * c1 * d2 * c2).alias("v"))

    first = F.lit(1.0) / kept(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_FRACTION_STEPS)), start, step, lambda s: s["v"])


def t_p_value(t: ColumnLike, df: ColumnLike) -> Column:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom; NULL where df is not positive."""
    t, df = col(t).cast("double"), col(df).cast("double")
    square = t * t
    x = df / (df + square)
    a, b = df / 2, F.lit(0.5)
    front = F.exp(log_gamma(a + 0.5) - log_gamma(a) - F.lit(0.5 * math.log(math.pi))
                  + a * F.log(x) + b * F.log1p(-x))
    near = x < (a + 1) / (a + b + 2)
    beta = F.when(near, front * _beta_fraction(a, b, x) / a).otherwise(
        1 - front * _beta_fraction(b, a, 1 - x) / b)
    far = two_sided_normal((8 * df + 1) / (8 * df + 3) * F.sqrt(df * F.log1p(square / df)))
    return F.when((df > 0) & t.isNotNull() & ~F.isnan(t), F.when(x >= 1, 1.0).when(x <= 0, 0.0)
                  .when(df > _LARGE_DF, far).otherwise(beta))


def t_quantile(alpha: float, df: ColumnLike) -> Column:
    """Value that |T| exceeds with probability ``alpha``.

    Newton's steps on the two-sided tail, which is convex: from the normal quantile, below the
    answer, they rise to it without passing it.
    """
    df = col(df).cast("double")
    log_scale = log_gamma((df + 1) / 2) - log_gamma(df / 2) - F.log(df * F.lit(math.pi)) / 2

    def step(t: Column, _: Column) -> Column:
        density = F.exp(log_scale - (df + 1) / 2 * F.log1p(t * t / df))
        return t + (t_p_value(t, df) - F.lit(alpha)) / (2 * density)

    steps = F.sequence(F.lit(1), F.lit(_NEWTON_STEPS))
    return F.when(df > 0, F.aggregate(steps, F.lit(z_value(1 - alpha / 2)), step))
