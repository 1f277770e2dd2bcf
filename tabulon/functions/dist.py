"""Tail probabilities of the t, F, chi-square and normal distributions.

Continued fractions of the incomplete beta and gamma functions (Lentz's method). The column
functions run on result rows of tests, a handful per query.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY, EPS, STEPS = 1e-300, 1e-15, 10_000


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > TINY else TINY)
    value = d
    for m in range(1, STEPS):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > TINY else TINY)
            c = 1.0 + term / c
            c = c if abs(c) > TINY else TINY
            value *= c * d
        if abs(c * d - 1.0) < EPS:
            break
    return value


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * EPS:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1.0 / TINY, 1.0 / b
    value = d
    for i in range(1, STEPS):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > TINY else TINY)
        c = b + an / c
        c = c if abs(c) > TINY else TINY
        value *= c * d
        if abs(c * d - 1.0) < EPS:
            break
    return front * value


def t_p(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_p(x: float, k: float) -> float:
    return gamma_sf(k / 2.0, x / 2.0)


def normal_p(z: float) -> float:
    """Upper tail of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def t_quantile(share: float, df: float) -> float:
    """Two-sided critical value: P(|T| <= q) = share."""
    low, high = 0.0, 2.0
    while t_p(high, df) > 1.0 - share:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_p(mid, df) > 1.0 - share else (low, mid)
    return (low + high) / 2.0


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _column(fn, *args: Column) -> Column:
    @F.pandas_udf("double")
    def apply(*parts: pd.Series) -> pd.Series:
        return pd.Series(
            [None if any(pd.isna(v) for v in row) else fn(*map(float, row)) for row in zip(*parts)], dtype="float64"
        )

    return apply(*[a.cast("double") for a in args])


def t_p_column(t: Column, df: Column) -> Column:
    return _column(t_p, t, df)


# Published coefficients of the normal quantile, highest power first (Wichura 1988, AS 241).
MIDDLE_OVER = (
    2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125,
    1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080,
)
MIDDLE_UNDER = (
    5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077,
    687.18700749205790830, 42.313330701600911252, 1.0,
)
TAIL_OVER = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258,
    3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734,
)
TAIL_UNDER = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
    6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0,
)
FAR_OVER = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
    2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720,
)
FAR_UNDER = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
    1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0,
)


def _ratio(over: tuple, under: tuple, x: Column) -> Column:
    def polynomial(coefficients: tuple) -> Column:
        value = F.lit(coefficients[0])
        for c in coefficients[1:]:
            value = value * x + F.lit(c)
        return value

    return polynomial(over) / polynomial(under)


def normal_quantile_column(p: Column) -> Column:
    """The standard normal's quantile of a share in (0, 1) as a plain expression, to about 1e-15 of its size."""
    p = p.cast("double")
    q = p - 0.5
    depth = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(depth <= 5, _ratio(TAIL_OVER, TAIL_UNDER, depth - 1.6)).otherwise(_ratio(FAR_OVER, FAR_UNDER, depth - 5))
    return F.when(F.abs(q) <= 0.425, q * _ratio(MIDDLE_OVER, MIDDLE_UNDER, 0.180625 - q * q)).otherwise(F.signum(q) * outer)


def f_p_column(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_p, f, d1, d2)


def chi2_p_column(x: Column, k: Column) -> Column:
    return _column(chi2_p, x, k)


def t_quantile_column(share: Column, df: Column) -> Column:
    return _column(t_quantile, share, df)
